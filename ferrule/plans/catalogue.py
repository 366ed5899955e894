"""Registered queries of the retrieval engine over the driver's tables.

Each entry applies an operator to whole tables and flattens its result; scores are whole
millionths.  ``catalogue_sql`` holds the DuckDB counterparts.
"""

from __future__ import annotations

import functools
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import services
from ..config import EngineConfig
from ..functions import sql as sql_functions
from ..functions import text as fx
from ..functions.vectors import cosine, dot, hash_embeddings, hashed_weights, norm
from ..operators import access, casebook, chunking, clustered, context, dense, fusion, lexical, plugins, reports, selection
from ..sources import store
from ..sources.documents import parse_frontmatter, read_eval, with_defaults
from ..storage import materialise, shared_dir, spread
from .catalogue_sql import SQL
from .engine import HybridEngine
from .fixtures import GATE_ROWS, GOLDEN_DOCS, GOLDEN_QUERIES, RULE_QUERIES, RULE_SENTENCES

#: Day of the access checks, and the scopes of the asker.
TODAY, SCOPES = 20260607, ("internal", "public")
IDENTITY = "local:local-hash-embedding"
#: Short benchmark items looked for in all documents at once.
BLOCK_ITEMS = 5_000

# Own literal fixtures: terms, dates and documents in Chinese and English.
TOKEN_LITERALS = ("跨境订单退款多久到账？", "SKU-A17 是否支持无理由退货？", "用户 可以 的", "refund Refund policy")
DAY_LITERALS = ("2026-06-07", "", "2026/01/31", "20251231", "soon", "2026-1-1")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return spread(_read(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _terms(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", fx.tokenize("text").alias("terms"))


def _queries(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _with_access(rows: DataFrame, k) -> DataFrame:
    """Rows with scopes and validity derived from a number, the same way as in the SQL."""
    scope = (
        F.when(k % 5 == 0, "public").when(k % 5 == 1, "internal").when(k % 5 == 2, "internal, partner_support").when(k % 5 == 3, "finance_restricted").otherwise("")
    )
    first, last = F.when(k % 7 == 0, "2027-01-01").otherwise(""), F.when(k % 11 == 0, "2026-01-31").otherwise("")
    return access.with_access_columns(rows.withColumns({"permission_scope": scope, "effective_from": first, "effective_to": last}))


def _access(spark, d) -> DataFrame:
    return _with_access(_docs(spark, d).select("doc_id", "text"), F.col("doc_id"))


def _with_askers(queries: DataFrame, k) -> DataFrame:
    """Queries whose askers and days differ: every fourth has the usual scopes, every third the usual day."""
    listed = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    scopes = F.when(k % 4 == 0, listed("public")).when(k % 4 == 1, listed("partner_support", "internal")).when(k % 4 == 2, listed("finance_restricted", " ")).otherwise(listed())
    day = F.when(k % 3 == 1, "2025-01-01").when(k % 3 == 2, "2028-01-01")
    return access.with_askers(queries.withColumns({"scopes": scopes, "as_of": day}), SCOPES, TODAY).drop("scopes")


def _scored(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("query_id", "doc_id", "rank", lexical.score_key().alias("score_key"), *extra)


# ------------------------------------------------------------------ text and vectors


def tokenize_terms(spark, d):
    rows = _terms(spark, d)
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha256"))


def _literal(k, texts):
    """The text of a row's number, in turn."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int"))


def tokenize_literals(spark, d):
    """Chinese and mixed texts before each document's source."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), F.concat(_literal(F.col("doc_id"), TOKEN_LITERALS), F.lit(" "), "source").alias("q"))
    return rows.select("id", F.array_join(fx.tokenize("q"), " ").alias("terms"))


def term_stats(spark, d):
    index = lexical.postings(_terms(spark, d), "doc_id")
    return index.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def corpus_stats(spark, d):
    return lexical.corpus_statistics(_terms(spark, d)).select("n_rows", F.round(F.col("mean_length") * 1e6).cast("long").alias("mean_length_key"))


def hash_embedding(spark, d):
    return hashed_weights(_terms(spark, d), "doc_id").select("doc_id", F.col("idx").cast("long").alias("idx"), F.round(F.col("weight") * 1e6).cast("long").alias("weight_key"))


def sparse_vector(spark, d):
    return lexical.sparse_postings(_terms(spark, d), "doc_id")


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", fx.content_hash("text", F.lit(IDENTITY), 1024).alias("content_hash"))


def normalize_text(spark, d):
    rough = F.concat(F.lit(" \t"), F.regexp_replace("text", "\n", "\r\n\r\n\r\n"), F.lit("\r\n "))
    rows = _docs(spark, d).select("doc_id", fx.normalize_text(rough).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def scalar_text(spark, d):
    rows = _docs(spark, d)
    listed = F.concat("source", F.lit("， "), "lang", F.lit(";"), "lang", F.lit(" x"))
    titled = F.concat(F.lit("  Über "), "source", F.lit(" / "), "lang", F.lit(" .. "))
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(fx.split_values(listed)), "|").alias("split"),
        fx.slugify(titled).alias("slug"),
        fx.path_slug(titled).alias("path_slug"),
        fx.clean_text(F.concat(F.lit("\t a \n"), "source", F.lit("  b "))).alias("clean"),
        fx.embedding_identity(F.concat(F.lit(" LOCAL"), "lang"), F.concat(F.lit(" "), "source")).alias("identity"),
        fx.token_count("text").cast("long").alias("token_count"),
    )


def sortable_day(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), F.concat(_literal(F.col("doc_id"), DAY_LITERALS), F.lit(" "), "lang").alias("v"))
    return rows.select("id", fx.sortable_day("v", 99991231).cast("long").alias("day"))


def _sql(spark, d, query: str) -> DataFrame:
    """A query that calls the session's SQL functions, over documents and their access texts."""
    sql_functions.register(spark)
    return spark.sql(query, documents=_docs(spark, d), guarded=_access(spark, d).select("doc_id", "permission_scope", "effective_from", "effective_to"))


def sql_terms(spark, d):
    query = "SELECT doc_id, size(terms) AS n_terms, sha2(array_join(terms, ' '), 256) AS terms_sha256 FROM (SELECT doc_id, terms_of(text) AS terms FROM {documents})"
    return _sql(spark, d, query).select("doc_id", F.col("n_terms").cast("long").alias("n_terms"), "terms_sha256")


def sql_access(spark, d):
    """Each document's reason, from the functions; the visible ones by the predicate."""
    scopes = "array('internal', 'public')"
    asked = f"permission_scope, effective_from, effective_to, {scopes}, {TODAY}"
    return _sql(spark, d, f"SELECT doc_id, access_reason({asked}) AS reason, visible_to({asked}) AS visible, array_join(split_scopes(permission_scope), ',') AS scopes FROM {{guarded}}")


def sql_chunks(spark, d):
    """Chunks by a table function, split inside the row."""
    query = "SELECT d.doc_id, c.chunk_no, c.chunk FROM (SELECT doc_id, normalized_text(text) AS t FROM {documents}) d, LATERAL chunks_of(d.t, 280, 60, '\n') c"
    rows = _sql(spark, d, query)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("text_sha256"))


# ------------------------------------------------------------------ access


def access_reasons(spark, d):
    return _access(spark, d).select("doc_id", access.reason(SCOPES, TODAY).alias("reason"))


def access_reasons_by_text(spark, d):
    return _access(spark, d).select("doc_id", access.reason_by_text(SCOPES, "2026-06-07").alias("reason"))


def access_counts(spark, d):
    return access.reason_counts(access_reasons(spark, d))


def visible_docs(spark, d):
    return _access(spark, d).where(access.visible(SCOPES, TODAY)).select("doc_id", F.array_join("scopes", ",").alias("scopes"), F.col("from_day").cast("long").alias("from_day"), F.col("to_day").cast("long").alias("to_day"))


def access_store_split(spark, d):
    return access.store_split(_access(spark, d), SCOPES, TODAY).select("doc_id", "part")


def access_remote_split(spark, d):
    return access.remote_split(_access(spark, d), SCOPES, TODAY).select("doc_id", "part")


def visible_by_asker(spark, d):
    """How many documents each query's asker sees and why not the others, and the sum of the ids of those seen."""
    queries, rows = _with_askers(_queries(spark, d), F.col("query_id")), _access(spark, d)
    counts = access.counts_by_asker(queries, rows)
    told = access.classes(rows).groupBy("access_class").agg(*[F.first(c).alias(c) for c in ("scopes", "from_day", "to_day")], F.sum("doc_id").alias("ids"))
    told = materialise(told, "classes")
    seen = access.grants(queries.withColumnRenamed("query_id", "asker"), told.drop("ids")).join(told.select("access_class", "ids"), "access_class")
    ids = seen.groupBy(F.col("asker").alias("query_id")).agg(F.sum("ids").alias("ids"))
    return counts.join(ids, "query_id", "left").fillna(0, ["ids"])


def blocked_matches(spark, d):
    hidden = _access(spark, d).where(~access.scope_allowed(SCOPES)).select(F.col("doc_id").alias("chunk_id"), "doc_id", fx.tokenize("text").alias("terms"))
    found = access.blocked_matches(_queries(spark, d), hidden)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "n_matched", F.round(F.col("overlap_ratio") * 1e4).cast("long").alias("ratio_key"), F.array_join("matched_terms", " ").alias("matched_terms"))


def blocked_recall(spark, d):
    hidden = _access(spark, d).where(access.permission_blocked(SCOPES, TODAY)).select("doc_id")
    rows = _terms(spark, d)
    return _scored(lexical.sparse_idf(_queries(spark, d), rows, 5, "doc_id", among=hidden))


# ------------------------------------------------------------------ recall and fusion


def bm25_topk(spark, d, k=12):
    rows = _terms(spark, d)
    return _scored(lexical.bm25(_queries(spark, d), lexical.postings(rows, "doc_id"), lexical.corpus_statistics(rows), k, "plain", "doc_id"))


def bm25_fts5_topk(spark, d):
    rows = _terms(spark, d)
    seen = _access(spark, d).where(access.visible(SCOPES, TODAY)).select("doc_id")
    found = lexical.bm25(_queries(spark, d), lexical.postings(rows, "doc_id"), lexical.corpus_statistics(rows), 12, "fts5", "doc_id", among=seen)
    return _scored(found)


def bm25_by_asker(spark, d):
    """Each query's best documents among those that its own asker sees on its own day."""
    rows, queries = _terms(spark, d), _with_askers(_queries(spark, d), F.col("query_id"))
    among = _access(spark, d).select("doc_id", "scopes", "from_day", "to_day")
    return _scored(lexical.bm25(queries, lexical.postings(rows, "doc_id"), lexical.corpus_statistics(rows), 12, "plain", "doc_id", among=among, seen=access.visible_to()))


def dense_by_asker(spark, d):
    asked, rows = _vectors(spark, d)
    asked = _with_askers(asked.withColumn("n", (F.col("query_id") / 100).cast("int")), F.col("n"))
    found = dense.dense_topk(asked, _with_access(rows, F.col("key")), 12)
    return found.select("query_id", F.col("key").alias("vec_id"), "rank", lexical.score_key().alias("score_key"))


def sparse_idf_topk(spark, d):
    return _scored(lexical.sparse_idf(_queries(spark, d), _terms(spark, d), 12, "doc_id"))


def _hash_route(spark, d, terms=None):
    terms = _terms(spark, d) if terms is None else terms
    rows = hash_embeddings(terms.withColumnRenamed("doc_id", "key"), "key", "terms", 1024)
    asked = hash_embeddings(_queries(spark, d).select("query_id", fx.tokenize("query").alias("terms")), "query_id", "terms", 1024)
    return dense.dense_topk(asked, rows, 12).withColumnRenamed("key", "doc_id")


def hash_dense_topk(spark, d):
    return _scored(_hash_route(spark, d))


def _vectors(spark, d):
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return rows.where(F.col("key") % 100 == 0).withColumnRenamed("key", "query_id"), rows


def dense_topk(spark, d):
    found = dense.dense_topk(*_vectors(spark, d), 12)
    return found.select("query_id", F.col("key").alias("vec_id"), "rank", lexical.score_key().alias("score_key"))


def _lists(spark, d) -> tuple[DataFrame, DataFrame, clustered.VectorLists]:
    asked, rows = _vectors(spark, d)
    return asked, rows, clustered.VectorLists.build(rows, _folder(spark, "lists"))


def clustered_exact(spark, d):
    """The lists asked for everything: the whole product from vectors in lists."""
    asked, _, held = _lists(spark, d)
    return held.search(asked, 12, exact=True).select("query_id", F.col("key").alias("vec_id"), "rank", lexical.score_key().alias("score_key"))


def clustered_recall(spark, d):
    """Of each query, how many of the true twelve its lists gave, and of the batch the lists a query read."""
    asked, rows, held = _lists(spark, d)
    true = materialise(dense.dense_topk(asked, rows, 12).select("query_id", "key"), "true")
    got = held.search(asked, 12).select("query_id", "key", F.lit(1).alias("hit"))
    told = true.join(got, ["query_id", "key"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return told.withColumns({"probes": F.lit(held.probes).cast("long"), "lists": F.lit(len(held.centroids)).cast("long")})


def cosine_topk_minscore(spark, d):
    found = dense.dense_topk(*_vectors(spark, d), 4, normalised=True, min_score=0.25)
    return found.select("query_id", F.col("key").alias("vec_id"), "rank", lexical.score_key().alias("score_key"))


def _lexical(spark, d, terms=None):
    rows = _terms(spark, d) if terms is None else terms
    return lexical.bm25(_queries(spark, d), lexical.postings(rows, "doc_id"), lexical.corpus_statistics(rows), 12, "plain", "doc_id")


def _written_terms(spark, d) -> DataFrame:
    """Documents' terms, written once for what reads them several times: both routes and their statistics."""
    return materialise(_terms(spark, d), "terms")


def _fused(spark, d, terms=None):
    """Two dozen rows a query at most, written once: what reads them knows how few they are."""
    terms = _written_terms(spark, d) if terms is None else terms
    return materialise(fusion.rrf_fuse(_hash_route(spark, d, terms), _lexical(spark, d, terms), key="doc_id"), "fused")


def rrf_fused(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", "dense_rank", "bm25_rank", lexical.score_key("rrf_score").alias("rrf_key"))


def rerank_skip(spark, d):
    found = fusion.skip_rerank(_fused(spark, d), key="doc_id")
    return found.select("query_id", "doc_id", "rank", lexical.score_key("rerank_score").alias("score_key"), "reason")


def _model(fused):
    """A stand-in for a model's scores that SQL can compute as well."""
    value = F.pmod(F.col("doc_id") * 7919 + F.col("query_id") * 104729, F.lit(1000)) / 1000.0
    return fused.select("query_id", "doc_id", value.alias("model_score"))


def _reranked(spark, d, terms=None):
    return fusion.rerank_or_skip(_fused(spark, d, terms), _model, "stand-in", key="doc_id")


def rerank_scores(spark, d):
    return _reranked(spark, d).select("query_id", "doc_id", "rank", lexical.score_key("rerank_score").alias("score_key"), "reason")


def rerank_response(spark, d):
    rows = _read(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("index"), F.length("text").alias("n"))
    got = rows.where("n % 3 <> 0").select("request_id", "index", (F.col("n") / 1000.0).alias("relevance_score"))
    found = fusion.sorted_results(fusion.parse_scores(got, rows))
    return found.select("request_id", "index", "rank", lexical.score_key().alias("score_key"))


# ------------------------------------------------------------------ selection


def _mmr(spark, d):
    asked, rows = _vectors(spark, d)
    near = dense.dense_topk(asked, rows, 12).withColumnRenamed("score", "rerank_score").join(rows, "key")
    return selection.mmr(near.withColumn("chunk_id", F.col("key").cast("string")), 8, 0.65, 0.3)


def mmr_selected(spark, d):
    return _mmr(spark, d).where("mmr_rank IS NOT NULL").select("query_id", "chunk_id", "mmr_rank", lexical.score_key("mmr_score").alias("mmr_key"))


def mmr_dropped(spark, d):
    return _mmr(spark, d).where("dropped").select("query_id", "chunk_id", "duplicate_of")


def _truncated(spark, d, terms=None):
    rows = _reranked(spark, d, terms).withColumn("expanded_tokens", (F.col("doc_id") % 300 + 20).cast("int"))
    return selection.truncate(rows, "rank")


def dynamic_truncate(spark, d):
    return _truncated(spark, d).select("query_id", "doc_id", "position", "running_tokens", "selected")


def hydrate(spark, d):
    ids = materialise(bm25_topk(spark, d), "found").select("doc_id")
    return selection.hydrate(ids, _docs(spark, d), "doc_id").select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))


# ------------------------------------------------------------------ chunking


def _line_chunks(spark, d):
    """Documents' chunks with a line as a paragraph, as ``chunk_id, parent_id, doc_id, chunk_no, text, token_count``."""
    sections = _docs(spark, d).select("doc_id", F.concat("source", F.lit(":"), "doc_id").alias("parent_id"), F.array("source").alias("title_path"), fx.normalize_text("text").alias("text"))
    return chunking.section_chunks(sections, delimiter="\n")


def section_split(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("title"), F.regexp_replace("text", "\n", "\n## ").alias("body"))
    return chunking.split_sections(docs).select("doc_id", F.col("section_no").cast("long").alias("section_no"), "parent_id", F.sha2("section_title", 256).alias("title_sha256"), F.sha2("text", 256).alias("text_sha256"))


def chunk_fold(spark, d):
    return _line_chunks(spark, d).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def chunk_rows(spark, d):
    return _line_chunks(spark, d).select("chunk_id", "parent_id", "doc_id", F.col("token_count").cast("long").alias("token_count"), F.size("terms").cast("long").alias("n_terms"))


def plain_chunks(spark, d):
    rows = chunking.plain_chunks(_docs(spark, d).select("source", fx.normalize_text("text").alias("text"), "doc_id"), "doc_id", "text", delimiter="\n")
    return rows.select("chunk_id", F.col("position").cast("long").alias("position"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def parent_expand(spark, d):
    chunks = materialise(_line_chunks(spark, d).select("chunk_id", "parent_id", "chunk_no", "text", "token_count"), "chunks")  # folded once, read three times
    last = chunks.groupBy("parent_id").agg(F.max_by(F.struct("chunk_id", "text", "token_count"), "chunk_no").alias("c")).select("parent_id", "c.*")
    found = selection.expand(last, chunks)
    return found.select("chunk_id", F.array_join("expanded_ids", ",").alias("expanded_ids"), F.col("expanded_tokens").cast("long").alias("expanded_tokens"), F.sha2("expanded_text", 256).alias("text_sha256"))


def siblings(spark, d):
    chunks = materialise(_line_chunks(spark, d).select("chunk_id", "parent_id", "text", "token_count"), "chunks")
    asked = chunks.select("parent_id").unionByName(_docs(spark, d).select(F.concat(F.lit("none:"), "doc_id").alias("parent_id")))
    found = selection.siblings(asked, chunks)
    return found.select("parent_id", F.size("siblings").cast("long").alias("n"), F.array_join(F.transform("siblings", lambda s: s["chunk_id"]), ",").alias("ids"))


# ------------------------------------------------------------------ index upkeep


def _versions(spark, d):
    """The corpus as stored, and as it is now: some texts changed, some gone, some new."""
    old = _docs(spark, d).select("doc_id", "text").withColumn("content_hash", fx.content_hash("text", F.lit(IDENTITY), 1024))
    k = F.col("doc_id")
    now = old.where(k % 13 != 0).withColumn("text", F.when(k % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = old.where(k % 17 == 0).withColumn("doc_id", k + 1_000_000_000)
    now = now.unionByName(new).withColumn("content_hash", fx.content_hash("text", F.lit(IDENTITY), 1024))
    return old, now


def sync_diff(spark, d):
    old, now = _versions(spark, d)
    return store.diff(now, old)


def upsert_merge(spark, d):
    old, now = _versions(spark, d)
    changed = now.join(store.diff(now, old).where("change IN ('added', 'changed')"), "doc_id", "left_semi")
    return store.upsert(old, changed).select("doc_id", "content_hash")


def delete_docs(spark, d):
    old, now = _versions(spark, d)
    return store.delete(old, store.diff(now, old).where("change = 'removed'")).select("doc_id", "content_hash")


def manifest_first(spark, d):
    rows = _line_chunks(spark, d).withColumns({"source_path": F.concat("parent_id", F.lit("/"), "chunk_no"), "content_hash": F.sha2("text", 256), "embedding_model": F.lit(IDENTITY)})
    return reports.first_per_document(rows).select("doc_id", "source_path", "content_hash")


# ------------------------------------------------------------------ context, answers, reports


def _selected(spark, d, terms=None):
    """Five rows a query at most, written once."""
    rows = materialise(_truncated(spark, d, terms).where("selected"), "truncated")
    docs = selection.hydrate(rows, _docs(spark, d), "doc_id").select("doc_id", "text", "source")
    found = context.evidence(rows.join(docs, "doc_id")).withColumn("terms", fx.tokenize("text"))
    return materialise(found, "selected")


def _judged(spark, d, selected=None, terms=None):
    terms = _written_terms(spark, d) if terms is None else terms
    selected = _selected(spark, d, terms) if selected is None else selected
    hidden = _with_access(terms, F.col("doc_id")).where(~access.scope_allowed(SCOPES)).select(F.col("doc_id").alias("chunk_id"), "doc_id", "terms")
    queries = _queries(spark, d)
    return context.sufficiency(context.coverage(queries, selected), access.blocked_matches(queries, hidden))


def sufficiency(spark, d):
    return _judged(spark, d).select("query_id", F.round(F.col("coverage") * 1e6).cast("long").alias("coverage_key"), "n_selected", "reason", "enough")


def sufficiency_rrf_only(spark, d):
    terms = _written_terms(spark, d)
    rows = fusion.skip_rerank(_fused(spark, d, terms), key="doc_id").where("rank <= 5").join(terms, "doc_id")
    judged = context.sufficiency(context.coverage(_queries(spark, d), rows, rrf_only=True), rrf_only=True)
    return judged.select("query_id", F.round(F.col("coverage") * 1e6).cast("long").alias("coverage_key"), "n_lexical", "reason", "enough")


def context_evidence(spark, d):
    return _selected(spark, d).select("query_id", "doc_id", "citation_id", "evidence_role", F.col("expanded_tokens").cast("long").alias("tokens"))


def extractive_answer(spark, d):
    terms = _written_terms(spark, d)
    selected = _selected(spark, d, terms)
    found = context.extractive_answers(_queries(spark, d), _judged(spark, d, selected, terms), selected)
    return found.select("query_id", "mode", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("citations", ",").alias("citations"))


def citation_validation(spark, d):
    said = _read(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("role")), " ").alias("roles"))
    answer = F.concat("roles", F.lit(" [E"), "n", F.lit("] and [E1] [E1] [x]"))
    answers = said.select("query_id", answer.alias("answer"), F.array().cast("array<string>").alias("citations"))
    cited = said.select("query_id", F.explode(F.array(F.lit("E1"), F.lit("E2"), F.lit("E4"))).alias("citation_id"))
    found = context.validate_citations(answers, cited)
    return found.select("query_id", F.array_join("used", ",").alias("used"), F.array_join("missing", ",").alias("missing"), "citation_valid")


def prompts(spark, d):
    found = context.prompts(_packets(spark, d)[2])
    return found.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def _found(spark, d, k):
    """The lexical route's best ``k`` with their documents; the few rows are written before the documents are read."""
    found = materialise(_lexical(spark, d).where(F.col("rank") <= k), "found")
    return found.join(_docs(spark, d), "doc_id")


def numbered_context(spark, d):
    rows = _found(spark, d, 3).select("query_id", F.col("rank").cast("int").alias("rank"), "source", F.col("doc_id").cast("int").alias("position"), "score", "text")
    return context.numbered_context(rows).select("query_id", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def result_summary(spark, d):
    found = _found(spark, d, 5).withColumns({"title_path": F.array("source", "lang"), "chunk_id": F.col("doc_id").cast("string")})
    return fusion.summarise(found).select("query_id", "rank", "chunk_id", "title_path", F.round(F.col("score") * 10_000).cast("long").alias("score_key"))


def casebook_render(spark, d):
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    talk = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    qa = F.concat(F.lit('{"knowledge":[{"customer_summary_question":"Case '), "conv_id", F.lit('","agent_summary_solution":" Done  twice "}]}'))
    k = F.col("conv_id")
    cases = rows.select(
        "conv_id",
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Area "), k % 4)).alias("issue_area"),
        F.when(k % 3 == 0, "").otherwise("Category  x").alias("issue_category"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("Sub "), k)).alias("issue_sub_category"),
        F.lit("Goods").alias("product_category"), F.lit(None).cast("string").alias("product_sub_category"), F.lit("low").alias("issue_complexity"),
        talk.alias("conversation"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("no json here")).otherwise(qa).alias("qa"),
    )
    docs = casebook.render_documents(casebook.numbered(cases, "conv_id"), "row_no")
    return docs.select("filename", "doc_id", "title", F.sha2("content", 256).alias("content_sha256"))


def relevant(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that hold an item word for word.

    ``docs``: doc_id, text.  ``items``: query_id, query.  A word inside an item (neither its
    first nor its last) is a whole word of every text that holds the item, so an item meets
    only texts with the rarest of these words, and those are confirmed.  Items of one or two
    words have none; they are looked for in every text, a block of items at a time.
    """
    pieces = F.split("query", " ")
    inner = F.array_distinct(F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != ""))
    items = materialise(items.where("query IS NOT NULL").withColumn("inner", inner), "items")
    long_ones = lexical.term_rows(items, "query_id", terms="inner").withColumnRenamed("term", "word")
    words = lexical.term_rows(docs.withColumn("words", F.array_distinct(F.split("text", " "))), "doc_id", terms="words").withColumnRenamed("term", "word")
    counts = words.join(long_ones.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = long_ones.join(counts, "word").groupBy("query_id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = materialise(words.join(materialise(rarest, "rarest"), "word").select("query_id", "doc_id").distinct(), "met")
    found = docs.join(met, "doc_id").join(items.select("query_id", "query"), "query_id").where(F.contains("text", "query")).select("query_id", "doc_id")
    short = items.where(F.size("inner") == 0).select("query_id", "query")
    n_blocks = -(-short.count() // BLOCK_ITEMS)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, "query_id"), (docs, "doc_id"))}
    for b in range(n_blocks):
        block = [(r.query_id, r["query"]) for r in short.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).collect()]

        def look(batches, block=block):
            for pdf in batches:
                hits = [(q, doc) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) if text is not None for q, piece in block if piece in text]
                yield pd.DataFrame(hits, columns=["query_id", "doc_id"])

        more = docs.select("doc_id", "text").mapInPandas(look, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}")
        found = found.unionByName(more)
    return found.distinct()


def _relevant(spark, d):
    return relevant(_docs(spark, d).select("doc_id", "text"), _queries(spark, d))


def retrieval_metrics(spark, d):
    found = reports.retrieval_metrics(materialise(bm25_topk(spark, d), "found"), materialise(_relevant(spark, d), "relevant"), 5)
    return found.select("n_queries", "n_hit", F.round(F.col("mrr") * 1e6).cast("long").alias("mrr_key"))


def eval_report(spark, d):
    terms = _written_terms(spark, d)
    selected = _selected(spark, d, terms)
    answers = context.extractive_answers(_queries(spark, d), _judged(spark, d, selected, terms), selected)
    expected = _relevant(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    cases = _queries(spark, d).join(expected, "query_id", "left").select(
        F.concat(F.lit("case"), "query_id").alias("case_id"), "query_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("expected_doc_id"),
        F.when(F.col("query_id") % 4 == 0, "False").otherwise("TRUE").alias("must_answer"), F.substring("query", 1, 3).alias("expected_terms"),
    )
    return reports.evaluate(cases, answers, selected).select("case_id", "passed")


def monitoring_event(spark, d):
    found = bm25_topk(spark, d, 5).groupBy("query_id").agg(F.count("*").alias("bm25_hits"), F.collect_list(F.col("doc_id").cast("string")).alias("doc_ids"))
    traces = _queries(spark, d).join(found, "query_id", "left").withColumns({"reason": F.when(F.col("query_id") % 3 == 0, "permission_denied").otherwise("pass"), "doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>"))})
    events = reports.monitoring_events(traces)
    return events.select("query_id", "status", "query_hash", F.col("query_chars").cast("long").alias("query_chars"), "permission_denied", "bm25_hits", F.col("selected_count").cast("long").alias("selected_count"), F.array_join("selected_doc_ids", ",").alias("selected_doc_ids"))


def monitoring_rollup(spark, d):
    events = _read(spark, d, "events")
    found = reports.roll_up(events, "ts", ["event_type"], "value")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("total_key"), F.round(F.col("most") * 1e6).cast("long").alias("most_key"))


def fallback_summary(spark, d):
    rows = _read(spark, d, "nation").select(F.col("n_name").alias("component"), (F.col("n_nationkey") % 3 == 0).alias("fallback_used"), F.lit("local").alias("mode"), F.lit(None).cast("string").alias("reason"), F.lit("").alias("error"), F.when(F.col("n_nationkey") % 2 == 0, 3).alias("attempts"))
    return reports.fallbacks(rows)


def rerank_fallback(spark, d):
    """A model that fails for every third query when the plan runs: those keep their fused order."""

    def model(query, texts):
        if int(query) % 3 == 0:
            raise OSError("model is down")
        return [(int(t) * 7919 + int(query) * 104729) % 1000 / 1000.0 for t in texts]

    fused = _fused(spark, d)
    asked = fused.select("query_id", "doc_id", F.col("query_id").cast("string").alias("query"), F.col("doc_id").cast("string").alias("text"))
    scores = plugins.score_candidates(asked, model, "doc_id", plugins.Patience(pause_s=0.0))
    found = fusion.rerank_or_skip(fused, lambda _: scores, "stand-in", key="doc_id")
    return found.select("query_id", "doc_id", "rank", lexical.score_key("rerank_score").alias("score_key"), "reason")


def vector_expressions(spark, d):
    """Inner product and cosine of each vector with its neighbour by id: whole, over the shorter length, and empty."""
    rows = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    short, none = F.slice("b", 1, 32), F.array().cast("array<float>")
    told = {"dot_key": dot(F.col("a"), F.col("b")), "short_key": dot(F.col("a"), short), "cosine_key": cosine(F.col("a"), F.col("b")), "norm_key": norm(short), "none_key": cosine(F.col("a"), none)}
    return pairs.select("vec_id", *[F.round(value * 1_000_000).cast("long").alias(name) for name, value in told.items()])


def scope_keys(spark, d):
    return _access(spark, d).select("doc_id", F.sha2(fx.scope_key(F.array_append("scopes", F.lit(" "))), 256).alias("key_sha256"))


def frontmatter(spark, d):
    """Closed, unclosed and absent frontmatter before the documents' texts."""
    k = F.col("doc_id")
    head = F.concat(F.lit("---\ntitle: first\nsource : "), "source", F.lit(" : x\nno colon\ndoc_id: d"), k, F.lit("\ntitle: "), "lang", F.lit("\n---\n\n"), "text", F.lit("\n"))
    raw = F.when(k % 3 == 0, head).when(k % 3 == 1, F.concat(F.lit("---\ntitle: open\n"), "text")).otherwise(F.col("text"))
    rows = _docs(spark, d).where("text IS NOT NULL").select(F.concat(F.lit("p/"), k).alias("source_path"), F.concat(F.lit("f"), k).alias("name"), raw.alias("raw_text"))
    found = parse_frontmatter(rows)
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return with_defaults(found).select("doc_id", "title", "source_path", "permission_scope", "effective_to", meta.alias("metadata"), F.sha2("body", 256).alias("body_sha256"))


def payloads(spark, d):
    chunks = _line_chunks(spark, d).join(_access(spark, d).select("doc_id", "scopes", "from_day", "to_day"), "doc_id")
    found = store.payloads(chunks)
    return found.select("chunk_id", "parent_id", "doc_id", F.array_join("title_path", ">").alias("title_path"), F.col("token_count").cast("long").alias("token_count"), "from_day", "to_day", F.array_join("permission_scopes", ",").alias("scopes"))


def sentence_points(spark, d):
    """Every rule's points: each benchmark item and each literal question with each literal sentence."""
    asked = _queries(spark, d).select((F.col("query_id") + 1_000).alias("q"), "query").unionByName(spark.createDataFrame(list(enumerate(RULE_QUERIES)), "q long, query string"))
    told = spark.createDataFrame(list(enumerate(RULE_SENTENCES)), "s long, sentence string")
    rows = asked.join(told).withColumn("terms", F.array_distinct(fx.tokenize("query")))
    return rows.select("q", "s", fx.sentence_score("sentence", "query", "terms").cast("long").alias("points"))


def out_of_domain(spark, d):
    asked = spark.createDataFrame([(-1 - k, q) for k, q in enumerate(RULE_QUERIES)], "query_id long, query string").unionByName(_queries(spark, d))
    return asked.select("query_id", fx.is_out_of_domain("query").alias("out_of_domain"))


def sufficiency_rules(spark, d):
    """Each outcome of the gate under both score policies, for each benchmark item."""
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(GATE_ROWS)], "k long, query string, coverage double, n_selected long, best_score double, n_lexical long, overlap_ratio double")
    rows = _queries(spark, d).select("query_id").crossJoin(F.broadcast(rows)).withColumn("query_id", F.col("query_id") * 100 + F.col("k")).drop("k")
    blocked, covered = rows.where("overlap_ratio IS NOT NULL").select("query_id", "overlap_ratio"), rows.drop("overlap_ratio")
    by_score = context.sufficiency(covered, blocked).select("query_id", F.col("reason").alias("by_score"))
    mixed = covered.withColumn("fell", F.lit(True))
    return by_score.join(context.sufficiency(mixed, blocked, rrf_only="fell").select("query_id", F.col("reason").alias("by_rank")), "query_id")


# ------------------------------------------------------------------ the stored index


def _folder(spark, name) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _new_index(spark, **more) -> store.IndexStore:
    return store.IndexStore(spark, _folder(spark, "index"), EngineConfig(paragraph_delimiter="\n", dimensions=64), **more)


def _corpora(spark, d) -> list[DataFrame]:
    """The corpus as it was, and as it is now (see ``_versions``), as an index takes it."""
    k = F.col("doc_id")
    return [
        rows.where("text IS NOT NULL").select(
            k, F.lit("t").alias("title"), F.col("text").alias("body"), F.col("text").alias("raw_text"), F.concat(F.lit("p/"), k).alias("source_path"), F.lit("v1").alias("version"),
            F.when(k % 5 == 0, "public").otherwise("closed").alias("permission_scope"), F.lit("").alias("effective_from"), F.lit("").alias("effective_to"),
        )
        for rows in _versions(spark, d)
    ]


def _stored(spark, d) -> store.IndexStore:
    """An index of the corpus as it was, synced to what it is now."""
    target = _new_index(spark)
    for docs in _corpora(spark, d):
        target.sync(docs)
    return target


def index_manifest(spark, d):
    return _stored(spark, d).manifest().select("doc_id", "source_path", "content_hash", "embedding_model")


def index_chunks(spark, d):
    """A filtered scan of the stored chunks: those that the public may see."""
    rows = _stored(spark, d).chunks().where(access.visible(["public"], TODAY))
    return rows.select("chunk_id", "parent_id", "doc_id", "token_count", F.col("n_terms").cast("long").alias("n_terms"), F.sha2("text", 256).alias("text_sha256"))


def index_postings(spark, d):
    return _stored(spark, d).postings().groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.sum("length").alias("lengths"))


def index_vectors(spark, d):
    """Of each chunk's vector, the number of places that hold something, and their weights by place."""
    rows = _stored(spark, d).vectors().select("chunk_id", F.posexplode("vector").alias("idx", "weight")).where("weight <> 0")
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight") * (F.col("idx") + 1)) * 1e3).cast("long").alias("weight_key"))


def index_counts(spark, d):
    target = _stored(spark, d)
    return target.statistics().select("n_rows", F.round(F.col("mean_length") * 1e6).cast("long").alias("mean_length_key"), F.lit(target.count()).alias("n_chunks"))


def index_recall(spark, d):
    """Lexical recall from stored postings and statistics."""
    found = _stored(spark, d).recall(_queries(spark, d), 5)
    return found.select("query_id", "chunk_id", "rank", lexical.score_key().alias("score_key"))


def sync_counts(spark, d):
    """What three syncs do: the first, one after changes, and one after none; and what a reset leaves."""
    target, (old, now) = _new_index(spark, buckets=4), _corpora(spark, d)
    done = [target.sync(docs) for docs in (old, now, now)]
    rows = [(k, x.added, x.changed, x.removed, target.exists()) for k, x in enumerate(done)]
    target.reset()
    return spark.createDataFrame([*rows, (len(rows), 0, 0, 0, target.exists())], "step long, added long, changed long, removed long, there boolean")


def sync_access(spark, d):
    """A second sync in which only scopes, validity and versions differ: what chunks and vectors say then, and how many documents it restated."""
    target, (docs, _), k = _new_index(spark, buckets=4), _corpora(spark, d), F.col("doc_id")
    target.sync(docs)
    later = docs.withColumns({
        "permission_scope": F.when(k % 4 == 0, "public, partner_support").otherwise(F.col("permission_scope")),
        "effective_to": F.when(k % 6 == 0, "2026-01-31").otherwise(""), "version": F.when(k % 10 == 0, "v2").otherwise("v1"),
    })
    done = target.sync(later)
    told = target.chunks().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.array_join("scopes", ","))), "|").alias("chunk_scopes"), F.max("to_day").alias("to_day"), F.max("version").alias("version"))
    vectors = target.vectors().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.array_join("scopes", ","))), "|").alias("vector_scopes"), F.min("to_day").alias("vector_to_day"))
    return told.join(vectors, "doc_id").withColumns({"restated": F.lit(done.restated).cast("long"), "changed": F.lit(done.added + done.changed + done.removed).cast("long")})


def mirror_manifest(spark, d):
    """Documents and numbers of chunks and vectors in an index's mirror after two syncs."""
    mirror = _new_index(spark)
    target = _new_index(spark, mirror=mirror)
    for docs in _corpora(spark, d):
        target.sync(docs)
    sizes = [rows.groupBy("doc_id").agg(F.count("*").alias(name)) for rows, name in ((mirror.chunks(), "n_chunks"), (mirror.vectors(), "n_vectors"))]
    found = mirror.manifest().select("doc_id", "content_hash")
    for part in sizes:
        found = found.join(part, "doc_id", "left")
    return found.fillna(0, ["n_chunks", "n_vectors"])


def eval_cases(spark, d):
    folder = _folder(spark, "cases")
    cases = _queries(spark, d).select(F.concat(F.lit("c"), "query_id").alias("case_id"), "query", F.col("query_id").alias("expected_doc_id"), F.lit("true").alias("must_answer"), F.lit("a, \"b\"").alias("expected_terms"))
    cases.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return read_eval(spark, folder).select("case_id", F.sha2("query", 256).alias("query_sha256"), "expected_doc_id", "must_answer", "expected_terms")


def index_of_a_model(spark, d):
    """A plain index is built once a model; another model's stands beside it, and a rebuild replaces only its own."""
    folder, built = _folder(spark, "plain"), []

    def build(model):
        built.append(model)
        return _docs(spark, d).select(F.concat(F.lit(f"{model}{len(built)}:"), "doc_id").alias("chunk_id"), "doc_id")

    for model, rebuild in (("m", False), ("n", False), ("m", False), ("m", True), ("n", False)):
        found = store.get_or_build(spark, folder, model, lambda model=model: build(model), rebuild)
    both = found.unionByName(store.get_or_build(spark, folder, "m", lambda: build("m")))
    return both.select("embedding_model", "chunk_id", F.lit(",".join(built)).alias("built"))


def event_log(spark, d):
    """Events appended twice, read back."""
    folder = _folder(spark, "events")
    events = reports.monitoring_events(_queries(spark, d))
    for _ in range(2):
        store.append_json(events, folder)
    return spark.read.json(folder).groupBy("query_id", "query_hash", "status").agg(F.count("*").alias("n"), F.max("query_chars").alias("query_chars"))


def embedder_vectors(spark, d):
    """A plugged-in embedder, called for a batch of texts at a time on the executors."""
    found = plugins.embed(_docs(spark, d), "doc_id", "text", lambda texts: [[len(t), t.count(" ")] for t in texts], 2)
    return found.select("doc_id", F.col("vector")[0].cast("long").alias("n_chars"), F.col("vector")[1].cast("long").alias("n_blanks"))


def _packets(spark, d):
    terms = _written_terms(spark, d)
    selected = _selected(spark, d, terms).withColumns({"chunk_id": F.col("doc_id").cast("string"), "parent_id": F.col("doc_id").cast("string"), "title_path": F.array("source"), "source_path": F.col("source"), "version": F.lit("v1"), "expanded_text": F.col("text")})
    judged = materialise(_judged(spark, d, selected, terms), "judged")
    return selected, judged, context.context_packets(_queries(spark, d), judged, selected)


def llm_answers(spark, d):
    """A model that fails for good on every third prompt; those answers, and refusals, stay extractive."""

    def model(prompt):
        if len(prompt) % 3 == 0:
            raise OSError("overloaded")
        return f"told in {len(prompt)} [E1]"

    selected, judged, packets = _packets(spark, d)
    extractive = context.extractive_answers(_queries(spark, d), judged, selected)
    found = context.answer_with(packets, extractive, model, plugins.Patience(pause_s=0.0))
    return found.select("query_id", "mode", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("citations", ",").alias("citations"), "attempts", "fallback_reason")


def component_status(spark, d):
    """Status rows of components that work, are not configured, or fall back."""

    def broken(*_):
        raise OSError("down")

    rows, swift, local = _docs(spark, d), plugins.Patience(pause_s=0.0), lambda: _new_index(spark)
    fails = F.col("query_id") % 3 == 0
    scores = _queries(spark, d).select("query_id", F.when(fails, "down").alias("failed"), F.when(fails, 3).otherwise(1).alias("attempts"))
    told = {
        "a": plugins.embed_or_hash(spark, rows, "doc_id", "text", None, 4)[1], "b": plugins.embed_or_hash(spark, rows, "doc_id", "text", broken, 4, swift)[1],
        "c": plugins.embed_or_hash(spark, rows, "doc_id", "text", lambda texts: [[0.0] * 4 for _ in texts], 4)[1],
        "d": plugins.reranker_status(spark, None), "e": plugins.reranker_status(spark, "m"), "f": plugins.reranker_status(spark, "m", scores),
        "g": plugins.open_store(spark, None, local)[1], "h": plugins.open_store(spark, broken, local, swift)[1], "i": plugins.open_store(spark, local, local)[1],
        "j": plugins.llm_status(spark, None), "k": plugins.llm_status(spark, len),
    }
    out = None
    for name, row in told.items():
        row = row.select(F.lit(name).alias("k"), *plugins.status_columns())
        out = row if out is None else out.unionByName(row)
    return out


def response_scores(spark, d):
    """Scores of a rerank answer as a list, and as results by index with some left out; the text of a chat answer."""

    def read(batches):
        for pdf in batches:
            rows = []
            for query_id, query in zip(pdf["query_id"], pdf["query"], strict=True):
                n = len(query) % 5 + 1
                listed = services.scores_of({"scores": [i / 4 for i in range(n)]}, n)
                by_place = services.scores_of({"results": [{"index": i, "relevance_score": i / 2} for i in range(n) if i % 2]}, n)
                text = services.text_of({"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": query[:n]}]})
                rows.append((query_id, round(sum(listed) * 100), round(sum(by_place) * 100), text))
            yield pd.DataFrame(rows, columns=["query_id", "listed", "by_place", "text"])

    return _queries(spark, d).mapInPandas(read, "query_id long, listed long, by_place long, text string")


def hybrid_golden(spark, d):
    """The whole engine on literal documents, for tests: five questions, one of them out of domain and one not permitted."""
    raw = spark.createDataFrame([(f"f{i}", f"f{i}", t) for i, t in enumerate(GOLDEN_DOCS)], "source_path string, name string, raw_text string")
    chunks = store.build_chunks(with_defaults(parse_frontmatter(raw)))
    queries = spark.createDataFrame(GOLDEN_QUERIES, "query_id string, query string")
    done = HybridEngine(chunks, EngineConfig(lexical="plain")).run(queries, SCOPES, TODAY, blocked_hint=True)
    out = done.answers.join(done.judged.select("query_id", "reason"), "query_id").join(done.validation.select("query_id", "citation_valid"), "query_id")
    return out.select("query_id", "mode", "reason", "answer", F.array_join("citations", ",").alias("citations"), "citation_valid")


_QUERIES = (
    tokenize_terms, tokenize_literals, term_stats, corpus_stats, hash_embedding, sparse_vector, content_hash, normalize_text, scalar_text, sortable_day, sql_terms, sql_access, sql_chunks,
    access_reasons, access_reasons_by_text, access_counts, visible_docs, access_store_split, access_remote_split, visible_by_asker, blocked_matches, blocked_recall,
    bm25_topk, bm25_fts5_topk, bm25_by_asker, sparse_idf_topk, hash_dense_topk, dense_topk, dense_by_asker, clustered_exact, clustered_recall, cosine_topk_minscore, rrf_fused, rerank_skip, rerank_scores, rerank_response,
    mmr_selected, mmr_dropped, dynamic_truncate, hydrate, section_split, chunk_fold, chunk_rows, plain_chunks, parent_expand, siblings,
    sync_diff, upsert_merge, delete_docs, manifest_first, sufficiency, sufficiency_rrf_only, context_evidence, extractive_answer, citation_validation,
    prompts, numbered_context, result_summary, casebook_render, retrieval_metrics, eval_report, monitoring_event, monitoring_rollup, fallback_summary,
    rerank_fallback, vector_expressions, scope_keys, frontmatter, payloads, sentence_points, out_of_domain, sufficiency_rules,
    index_manifest, index_chunks, index_postings, index_vectors, index_counts, index_recall, sync_counts, sync_access, mirror_manifest, eval_cases, index_of_a_model, event_log,
    embedder_vectors, llm_answers, component_status, response_scores,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(rrf_fused)(spark, sf_dir)


def _wide(query):
    """The query with ranks and counts as 64-bit integers, the type SQL gives them."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        rows = query(spark, sf_dir)
        return rows.withColumns({c: F.col(c).cast("long") for c, kind in rows.dtypes if kind == "int"})

    return run


def queries():
    return {q.__name__: _wide(q) for q in _QUERIES}


def oracle_sql():
    return dict(SQL)
