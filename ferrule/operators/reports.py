"""Evaluation against a golden set, monitoring events and component status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evaluate(cases: DataFrame, answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(case_id, query_id, passed): the expected document and term where an answer is due, else a refusal.

    ``cases``: case_id, query_id, expected_doc_id, must_answer, expected_terms (strings).
    """
    docs = cited.groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("docs"))
    rows = cases.join(answers.select("query_id", "mode", "answer"), "query_id", "left").join(docs, "query_id", "left")
    due = F.lower(F.coalesce("must_answer", F.lit(""))) == "true"
    expected = F.coalesce("expected_doc_id", F.lit(""))
    doc_ok = (expected == "") | F.coalesce(F.array_contains("docs", expected), F.lit(False))
    term_ok = F.contains(F.coalesce("answer", F.lit("")), F.coalesce("expected_terms", F.lit("")))
    refused = F.coalesce(F.col("mode") == "refusal", F.lit(True))
    return rows.select("case_id", "query_id", F.when(due, doc_ok & term_ok).otherwise(refused).alias("passed"))


def summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """One row over queries with relevant rows: n_queries, hits within ``k`` and the mean reciprocal rank.

    ``ranked``: query_id, key, rank.  ``relevant``: query_id, key.
    """
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = relevant.select("query_id").distinct().join(hits, "query_id", "left")
    return rows.agg(
        F.count("*").alias("n_queries"), F.count("first").alias("n_hit"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")
    )


_COUNTS = ("dense_hits", "bm25_hits", "rerank_candidates", "dedup_dropped_count", "blocked_match_count")


def monitoring_events(traces: DataFrame) -> DataFrame:
    """Flat events of traced queries; the query itself is kept as a short digest only.

    ``traces``: query_id, query, status, latency_ms, mode, enough, reason, citation_valid,
    missing, doc_ids, token_total, and the counts of the stages; what is absent is null or 0.
    """
    have = set(traces.columns)
    col = lambda name, kind, default=None: (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)
    array = lambda name: F.col(name) if name in have else F.array().cast("array<string>")
    docs = F.array_sort(F.array_distinct(F.filter(array("doc_ids").cast("array<string>"), lambda d: d != "")))
    counts = [F.coalesce(col(c, "long", 0), F.lit(0)).alias(c) for c in _COUNTS]
    text = F.coalesce("query", F.lit(""))
    constants = ("pipeline_version", "index_version", "vector_backend", "embedding_model", "embedding_identity", "selection_strategy",
                 "reranker_mode", "reranker_model", "reranker_score_policy")
    return traces.select(
        "query_id",
        col("trace_id", "string"),
        F.coalesce(col("timestamp", "timestamp"), F.current_timestamp()).alias("timestamp"),
        col("status", "string", "ok"),
        col("latency_ms", "long"),
        col("stage_latencies_ms", "map<string,bigint>"),
        *[col(c, "string") for c in constants],
        F.left(F.sha2(text, 256), F.lit(16)).alias("query_hash"),
        F.length(text).alias("query_chars"),
        col("mode", "string").alias("answer_mode"),
        col("enough", "boolean").alias("sufficiency_enough"),
        col("reason", "string").alias("sufficiency_reason"),
        F.coalesce(col("reason", "string") == "permission_denied", F.lit(False)).alias("permission_denied"),
        col("citation_valid", "boolean"),
        F.size(F.coalesce(array("missing"), F.array().cast("array<string>"))).alias("missing_citation_count"),
        *counts,
        F.size(docs).alias("selected_count"),
        docs.alias("selected_doc_ids"),
        F.coalesce(col("token_total", "long", 0), F.lit(0)).alias("context_token_total"),
        F.coalesce(col("fallback_used", "boolean", False), F.lit(False)).alias("reranker_fallback_used"),
    )


def roll_up(events: DataFrame, ts: str, group: list[str], value: str, width: str = "1 day") -> DataFrame:
    """Counts and mean, largest and summed ``value`` by time window and group; works on streams as well."""
    windowed = events.groupBy(F.window(ts, width).alias("w"), *group)
    sums = windowed.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return sums.select(F.col("w.start").alias("window_start"), *group, "n", "total", "most")


def fallbacks(status: DataFrame) -> DataFrame:
    """(component, mode, reason, error, attempts) of components that fell back; ``status``: one row a component."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return status.where(F.coalesce("fallback_used", F.lit(False))).select(
        "component", text("mode"), text("reason"), text("error"), F.coalesce("attempts", F.lit(0)).alias("attempts")
    )


def first_per_document(points: DataFrame) -> DataFrame:
    """A manifest from points: each document's first point by id says its path, hash and model."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    rows = points.withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("doc_id", "source_path", "content_hash", "embedding_model", F.lit("").alias("updated_at"))
