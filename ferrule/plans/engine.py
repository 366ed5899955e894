"""The whole path from queries to answers, for a batch of queries at once."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import tokenize
from ..functions.vectors import hash_embeddings
from ..operators import access, context, dense, fusion, lexical, plugins, reports, selection
from ..storage import discard, materialise

#: What each event says about the engine that answered; fixed for a version of this engine.
PIPELINE_VERSION = "ferrule_pipeline_v2"
ACCESS = ("scopes", "from_day", "to_day")


@dataclass
class Answered:
    """The stages' results, each a DataFrame keyed by query_id; ``status`` has a row a component, ``permission`` one row."""

    fused: DataFrame
    ranked: DataFrame
    diversified: DataFrame
    selected: DataFrame
    judged: DataFrame
    answers: DataFrame
    validation: DataFrame
    packets: DataFrame
    traces: DataFrame
    events: DataFrame
    status: DataFrame
    permission: DataFrame
    stage_latencies_ms: dict[str, int]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the tables that the results share; the results cannot be read any more."""
        for rows in self.held:
            discard(rows)


class ChunkIndex:
    """What the engine asks of an index, worked out anew from a chunk table that no index holds."""

    def __init__(self, chunks: DataFrame, config: EngineConfig, embedder=None):
        self._chunks, self._config, self._embedder, self.path, self.identity = chunks, config, embedder, "", ""

    def chunks(self) -> DataFrame:
        return self._chunks

    def pinned(self) -> ChunkIndex:
        return self

    def recall(self, queries: DataFrame, k: int, variant: str, seen) -> DataFrame:
        """As an index's: by BM25 among the chunks that pass ``seen``, beside the queries' own columns if they have some."""
        by_query = len(queries.columns) > 2
        rows = self._chunks.select("chunk_id", *ACCESS)
        among = rows if by_query else rows.where(seen)
        return lexical.bm25(queries, lexical.postings(self._chunks), lexical.corpus_statistics(self._chunks), k, variant, among=among, seen=seen if by_query else None)

    def vectors(self) -> DataFrame:
        rows = self._chunks.withColumnRenamed("chunk_id", "key")
        found = vectors_of(rows, "key", "text", "terms", self._config, self._embedder).withColumnRenamed("key", "chunk_id")
        return found.join(self._chunks.select("chunk_id", "doc_id", "scopes", "from_day", "to_day"), "chunk_id")


def vectors_of(rows: DataFrame, key: str, text: str, terms: str, config: EngineConfig, embedder=None) -> DataFrame:
    if embedder is None:
        return hash_embeddings(rows.select(key, terms), key, terms, config.dimensions)
    return plugins.embed(rows, key, text, embedder, config.dimensions)


class HybridEngine:
    """Hybrid retrieval over an ``IndexStore``, or over a chunk table as its ``chunks()`` gives it.

    An index has been split, tokenised and embedded when its documents changed; a batch of
    queries reads its postings, vectors and rows and embeds nothing but the queries.
    ``score_model`` maps the fused candidates to scores; ``reranker`` is a plain service
    ``(query, texts) -> scores``; ``llm`` one ``prompt -> text``.  What fails falls back.
    """

    def __init__(self, index, config: EngineConfig = EngineConfig(), score_model=None, model_name: str = "", embedder=None, reranker=None, llm=None, patience=plugins.Patience()):
        self.index = ChunkIndex(index, config, embedder) if isinstance(index, DataFrame) else index
        self.config, self.score_model, self.model_name, self.embedder = config, score_model, model_name, embedder
        self.reranker, self.llm, self.patience = reranker, llm, patience

    def run(self, queries: DataFrame, allowed=(), today: int | None = None, blocked_hint: bool = False) -> Answered:
        """``queries``: query_id, query.  ``today`` (yyyymmdd) is the day of the access checks, by default this one.

        Queries may carry ``scopes`` and ``as_of``: then each is answered from what its own asker
        sees on its own day, and ``permission`` has a row a query.

        What several results share is a dozen rows a query; those rows are written to shared
        storage until ``release``, so recall runs once however many results are read, and each
        stage's time is its own.
        """
        c, index, spark = self.config, self.index.pinned(), queries.sparkSession
        began = clock = time.perf_counter()
        spent: dict[str, int] = {}
        held: list[DataFrame] = []

        def stage(name: str, rows: DataFrame) -> DataFrame:
            nonlocal clock
            held.append(materialise(rows, name))
            now = time.perf_counter()
            spent[name], clock = int((now - clock) * 1000), now
            return held[-1]

        today = today or int(date.today().strftime("%Y%m%d"))
        allowed = access.effective_scopes(allowed, c)
        by_asker = bool({"scopes", "as_of"} & set(queries.columns))
        chunks, seen, who = index.chunks(), access.visible(allowed, today), []
        if by_asker:
            queries, who = access.with_askers(queries, allowed, today, c).select("query_id", "query", "allowed", "as_of"), ["allowed", "as_of"]
            queries = stage("askers", queries)
            permission = stage("access_filter", access.counts_by_asker(queries, chunks.select(*ACCESS)))
        else:
            permission = stage("access_filter", access.reason_counts(chunks.select(access.reason(allowed, today).alias("reason"))))
        # what no asker of the batch may see is left out here, what only some may see where a row meets its query
        mine = chunks if by_asker else chunks.where(seen)
        asked = queries.select("query_id", "query", tokenize("query").alias("terms"))
        asked = stage("embedding", vectors_of(asked, "query_id", "query", "terms", c, self.embedder))
        vectors = index.vectors() if by_asker else index.vectors().where(seen)
        with_who = asked.join(queries.select("query_id", *who), "query_id") if by_asker else asked
        near = dense.dense_topk(with_who, vectors.select(F.col("chunk_id").alias("key"), "vector", *ACCESS), c.dense_top_n).withColumnRenamed("key", "chunk_id")
        near = stage("dense_recall", near)
        words = index.recall(queries.select("query_id", "query", *who), c.lexical_top_n, c.lexical, access.visible_to() if by_asker else seen)
        words = stage("bm25_recall", words)
        fused = stage("rrf_fusion", fusion.rrf_fuse(near, words, c.rrf_k))

        rows = selection.hydrate(fused.select("chunk_id"), mine, "chunk_id")
        rows = stage("docstore_hydrate", rows)
        scores = None
        if self.reranker is not None:
            candidates = fused.select("query_id", "chunk_id").join(rows.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
            scores = stage("reranker", plugins.score_candidates(candidates, self.reranker, patience=self.patience))
        model = self.score_model if scores is None else lambda _: scores
        ranked = fusion.rerank_or_skip(fused, model, self.model_name, c.rerank_top_n)
        ranked = stage("rerank", ranked.withColumn("rrf_only", F.col("reason").startswith("rerank_skipped:")))
        with_vectors = ranked.join(vectors.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "vector"), "chunk_id")
        diversified = stage("mmr", selection.mmr(with_vectors, c.rerank_top_n, c.mmr_lambda, c.duplicate_threshold))
        kept = diversified.where("NOT dropped AND mmr_rank IS NOT NULL").select("query_id", "chunk_id", "mmr_rank", "mmr_score")
        facts = ranked.select("query_id", "chunk_id", "rerank_score", "bm25_rank", "rrf_only")
        found = kept.join(facts, ["query_id", "chunk_id"]).join(rows, "chunk_id")
        found = stage("candidates", found.join(queries.select("query_id", *who), "query_id") if by_asker else found)
        expanded = selection.expand(found, mine, c.parent_expansion_chars, *((access.visible_to, ACCESS) if by_asker else ()))
        cut = selection.truncate(
            expanded, rrf_only="rrf_only", min_score=c.min_rerank_score, gap=c.gap_threshold, max_k=c.final_max_k, budget=c.context_token_budget
        )
        selected = stage("truncate", context.evidence(cut.where("selected")))
        blocked = None
        if blocked_hint:
            hidden = chunks if by_asker else chunks.where(~access.scope_allowed(allowed))
            blocked = stage("blocked_matches", access.blocked_matches(queries, hidden))
        covered = context.coverage(queries, selected, "rrf_only")
        judged = context.sufficiency(
            covered, blocked, rrf_only="rrf_only", min_score=c.min_rerank_score, min_coverage=c.min_coverage, high_confidence=c.high_confidence
        )
        judged = stage("sufficiency", judged)
        packets = stage("context", context.context_packets(queries, judged, selected))
        extractive = context.extractive_answers(queries, judged, selected)
        answers = stage("answer", context.answer_with(packets, extractive, self.llm, self.patience) if self.llm else extractive)
        validation = stage("validation", context.validate_citations(answers, selected))

        # the probe of ``embed_or_hash`` belongs to whoever built the index; a query batch only reports what it used
        status = plugins.reranker_status(spark, self.model_name or ("reranker" if self.reranker or self.score_model else None), scores)
        policy = status.select("mode", "model", "score_policy", "fallback_used").first()
        status = status.select(*plugins.status_columns()).unionByName(plugins.llm_status(spark, self.llm, answers if self.llm else None))
        status = status.unionByName(plugins.embedding_status(spark, self.embedder))
        total = int((time.perf_counter() - began) * 1000)
        traces = self._traces(queries, near, words, ranked, diversified, selected, judged, packets, answers, validation, blocked, policy, spent, total)
        return Answered(fused, ranked, diversified, selected, judged, answers, validation, packets, traces, reports.monitoring_events(traces), status, permission, spent, held)

    def _traces(self, queries, near, words, ranked, diversified, selected, judged, packets, answers, validation, blocked, policy, spent, total) -> DataFrame:
        """A row a query: what each stage did, and the configuration that did it."""
        count = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
        rows = queries.select("query_id", "query")
        counts = [count(near, "dense_hits"), count(words, "bm25_hits"), count(ranked, "rerank_candidates"), count(diversified.where("dropped"), "dedup_dropped_count")]
        if blocked is not None:
            hint = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_id", "matched_terms", "overlap_ratio")))
            counts.append(blocked.groupBy("query_id").agg(F.count("*").alias("blocked_match_count"), hint.alias("blocked_matches")))
        counts.append(selected.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.max("rrf_only").alias("fell")))
        counts.append(judged.select("query_id", "enough", "reason", "coverage"))
        counts.append(packets.select("query_id", "token_total", "evidence"))
        counts.append(answers.select("query_id", "mode", "answer", "citations"))
        counts.append(validation.select("query_id", "citation_valid", "missing"))
        for part in counts:
            rows = rows.join(part, "query_id", "left")
        latencies = F.create_map(*[F.lit(x) for k, v in spent.items() for x in (k, v)]).cast("map<string,bigint>")
        said = {
            "trace_id": F.uuid(), "timestamp": F.current_timestamp(), "status": F.lit("ok"), "latency_ms": F.lit(total).cast("long"), "stage_latencies_ms": latencies,
            "pipeline_version": F.lit(PIPELINE_VERSION), "index_version": F.lit(self.index.path), "vector_backend": F.lit("parquet"),
            "embedding_model": F.lit(self.config.embedding_model), "embedding_identity": F.lit(self.index.identity), "selection_strategy": F.lit("mmr"),
            "reranker_mode": F.lit(policy.mode), "reranker_model": F.lit(policy.model), "reranker_score_policy": F.lit(policy.score_policy),
            "fallback_used": F.lit(bool(policy.fallback_used)) & F.coalesce("fell", F.lit(False)),
        }
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"doc_ids": F.coalesce("doc_ids", none), "missing": F.coalesce("missing", none)})
        rows = rows.fillna(0, [c for c in ("dense_hits", "bm25_hits", "rerank_candidates", "dedup_dropped_count", "blocked_match_count") if c in rows.columns])
        return rows.withColumns(said).drop("fell")
