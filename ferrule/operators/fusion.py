"""Fusion of recall routes and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lexical import score_key, top_k


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = 60, key: str = "chunk_id") -> DataFrame:
    """Full outer join of both routes, scored by reciprocal ranks; both ranks and scores stay.

    ``place`` orders equal scores: dense order first, then what only the lexical route found.
    """
    left = dense.select("query_id", key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    right = lexical.select("query_id", key, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda rank: F.coalesce(1.0 / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return left.join(right, ["query_id", key], "full_outer").withColumn("rrf_score", part("dense_rank") + part("bm25_rank"))


def fused_order(key: str = "chunk_id") -> list[Column]:
    return [F.desc(score_key("rrf_score")), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.col(key)]


def skip_rerank(fused: DataFrame, why: str = "no_configured_model", top_n: int = 12, key: str = "chunk_id") -> DataFrame:
    """The best by reciprocal ranks stand as they are."""
    kept = top_k(fused, top_n, fused_order(key))
    return kept.withColumns({"rerank_score": F.col("rrf_score"), "reason": F.lit(f"rerank_skipped:{why}")})


def rerank(fused: DataFrame, scores: DataFrame, model: str, top_n: int = 12, key: str = "chunk_id") -> DataFrame:
    """Candidates by a model's scores (query_id, key, model_score); equal ones keep their fused order."""
    scored = fused.join(scores.select("query_id", key, "model_score"), ["query_id", key], "left")
    scored = scored.withColumn("rerank_score", F.coalesce("model_score", F.lit(0.0))).drop("model_score")
    kept = top_k(scored, top_n, [F.desc(score_key("rerank_score")), *fused_order(key)])
    return kept.withColumn("reason", F.lit(f"external_reranker:{model}"))


def rerank_or_skip(fused: DataFrame, score_model, model: str, top_n: int = 12, key: str = "chunk_id") -> DataFrame:
    """``rerank`` with ``score_model(fused) -> scores``; queries the model failed on keep their fused order.

    Scores may carry a ``failed`` column (see ``plugins.score_candidates``): one error of a
    query lets that query fall back, when the plan runs.  Without a model, or if it cannot be
    planned, all do.
    """
    if score_model is None:
        return skip_rerank(fused, "no_configured_model", top_n, key)
    try:
        scores = score_model(fused)
    except Exception:  # whatever a plugged-in model raises, recall results stand
        return skip_rerank(fused, "reranker_error", top_n, key)
    if "failed" not in scores.columns:
        return rerank(fused, scores, model, top_n, key)
    rows = fused.join(scores.select("query_id", key, "model_score", "failed"), ["query_id", key], "left")
    fell = F.max(F.col("failed").isNotNull()).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("fell", F.coalesce(fell, F.lit(False)))
    value = F.when(F.col("fell"), F.col("rrf_score")).otherwise(F.coalesce("model_score", F.lit(0.0)))
    kept = top_k(rows.withColumn("rerank_score", value), top_n, [F.desc(score_key("rerank_score")), *fused_order(key)])
    reason = F.when(F.col("fell"), "rerank_skipped:reranker_error").otherwise(f"external_reranker:{model}")
    return kept.withColumn("reason", reason).drop("fell", "failed", "model_score")


def parse_scores(response: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores in request order: (request_id, index, score); an index without a result scores 0.

    ``response``: request_id, index, score or relevance_score.  ``documents``: request_id, index.
    """
    value = [c for c in ("score", "relevance_score") if c in response.columns]
    got = response.select("request_id", "index", F.coalesce(*[F.col(c) for c in value]).cast("double").alias("score"))
    return documents.select("request_id", "index").join(got, ["request_id", "index"], "left").fillna(0.0, ["score"])


def sorted_results(scores: DataFrame) -> DataFrame:
    """Each request's results by score, with their ``rank``."""
    return top_k(scores, 2**31 - 1, [F.desc("score"), F.col("index")], by="request_id")


def summarise(results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A digest of ranked rows: four decimals, title path in one string."""
    return results.select("query_id", "rank", key, "doc_id", F.round("score", 4).alias("score"), F.array_join("title_path", " > ").alias("title_path"))
