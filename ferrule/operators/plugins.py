"""Services beside the engine (embedders, rerankers, language models, stores): patience, and rows that say which answered.

A service is any callable.  It is asked through a ``Patience``, which gives back an
``Outcome`` whether it worked or not, so a caller decides by a column or a field and never
by an exception.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions.text import tokenize
from ..functions.vectors import hash_embeddings

#: Texts sent to an embedder at once.
BATCH = 64

STATUS_SCHEMA = "component string, mode string, configured boolean, fallback_used boolean, reason string, error string, attempts int"


class Unavailable(Exception):
    """A service raises this where asking again is of no use; its text says why."""


@dataclass(frozen=True)
class Outcome:
    """What a service gave; ``error`` is None where it worked."""

    value: Any
    error: str | None
    attempts: int


@dataclass(frozen=True)
class Patience:
    """How often a service is asked, and how long the first pause is; pauses double."""

    # Defaults that results report.
    attempts: int = 3
    pause_s: float = 0.05

    def ask(self, service: Callable, *given) -> Outcome:
        error = ""
        for n in itertools.count(1):
            try:
                return Outcome(service(*given), None, n)
            except Exception as e:  # whatever a plugged-in service raises
                error = str(e) or type(e).__name__
                if n >= self.attempts or isinstance(e, Unavailable):
                    return Outcome(None, error, n)
            time.sleep(self.pause_s * (1 << (n - 1)))


def _status(spark: SparkSession, component: str, mode: str, reason: str, failed: Outcome | None = None, configured: bool = True) -> DataFrame:
    """A status row; a component with a ``failed`` outcome has fallen back."""
    error, attempts = (failed.error, failed.attempts) if failed else ("", 0)
    return spark.createDataFrame([(component, mode, configured, failed is not None, reason, error, attempts)], STATUS_SCHEMA)


def status_columns() -> list[str]:
    return [c.split()[0] for c in STATUS_SCHEMA.split(", ")]


# ------------------------------------------------------------------ embedders


def embedding_status(spark: SparkSession, embedder: Callable | None) -> DataFrame:
    """The status row of an embedder that was not probed."""
    if embedder is None:
        return _status(spark, "embedding", "hash_fallback", "not_configured", configured=False)
    return _status(spark, "embedding", "external", "configured_model")


def embed(rows: DataFrame, key: str, text: str, embedder: Callable, dims: int, patience: Patience = Patience()) -> DataFrame:
    """(key, vector) by ``embedder(texts) -> vectors``, called on the executors for ``BATCH`` texts at a time.

    Texts that fail for good fail the task, which Spark tries again on another executor.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def checked(texts):
        vectors = [np.asarray(v, float) for v in embedder(texts)]
        if [v.shape for v in vectors] != [(dims,)] * len(texts):
            raise ValueError(f"the embedder must give {len(texts)} vectors of {dims} places")
        return vectors

    def run(batches):
        for batch in batches:
            texts, vectors = [t or "" for t in batch.column(1).to_pylist()], []
            for lo in range(0, len(texts), BATCH):
                got = patience.ask(checked, texts[lo : lo + BATCH])
                if got.error is not None:
                    raise RuntimeError(f"embedder failed {got.attempts} times: {got.error}")
                vectors += got.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def embed_or_hash(spark: SparkSession, rows: DataFrame, key: str, text: str, embedder: Callable | None, dims: int, patience: Patience = Patience()) -> tuple[DataFrame, DataFrame]:
    """Vectors by the embedder if a probe succeeds, else hashed ones; and a status row."""
    probe = patience.ask(embedder, ["probe"]) if embedder else None
    if probe and probe.error is None:
        return embed(rows, key, text, embedder, dims, patience), embedding_status(spark, embedder)
    vectors = hash_embeddings(rows.select(key, tokenize(text).alias("terms")), key, "terms", dims)
    why = "embedding_error" if probe else "not_configured"
    return vectors, _status(spark, "embedding", "hash_fallback", why, probe, configured=probe is not None)


# ------------------------------------------------------------------ rerankers


def score_candidates(candidates: DataFrame, model: Callable, key: str = "chunk_id", patience: Patience = Patience()) -> DataFrame:
    """(query_id, key, model_score, failed, attempts) by ``model(query, texts) -> scores``, a call a query.

    ``candidates``: query_id, query, key, text; a dozen or two a query.  Where the model fails
    for good, or gives another number of scores than there are texts, the query's rows carry
    the error in ``failed`` and no score.
    """
    id_type, key_type = (candidates.schema[c].dataType.simpleString() for c in ("query_id", key))

    def checked(query, texts):
        scores = [float(s) for s in model(query, texts)]
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} documents")
        return scores

    def run(group):
        group = group.sort_values(key, kind="stable")
        got = patience.ask(checked, group["query"].iloc[0], group["text"].fillna("").tolist())
        return group[["query_id", key]].assign(model_score=got.value or [None] * len(group), failed=got.error, attempts=got.attempts)

    rows = candidates.select("query_id", "query", key, "text")
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {id_type}, {key} {key_type}, model_score double, failed string, attempts int")


def reranker_status(spark: SparkSession, model: str | None, scores: DataFrame | None = None) -> DataFrame:
    """A status row with ``model`` and ``score_policy``: a model's scores can be compared with a minimum, fused ranks cannot.

    ``scores`` as ``score_candidates`` gives them; one failed query counts as a failure.
    """
    last = None if scores is None else scores.agg(F.max("failed").alias("error"), F.max("attempts").alias("n")).first()
    failed = Outcome(None, last.error, last.n) if last and last.error is not None else None
    # Modes, reasons and policies that reports name.
    if not model:
        row, policy = _status(spark, "reranker", "skipped", "not_configured", configured=False), "rrf_only"
    elif failed:
        row, policy = _status(spark, "reranker", "skipped", "reranker_error", failed), "rrf_only"
    else:
        row, policy = _status(spark, "reranker", "external", "configured_model"), "external_rerank"
    return row.withColumns({"model": F.lit(model or ""), "score_policy": F.lit(policy)})


def checked_documents(request: DataFrame) -> DataFrame:
    """Documents of a rerank request (request_id, index, query, text); a blank query or text is an error."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("")) == ""
    failed = F.when(blank("query"), "query must not be blank").when(blank("text"), "document text must not be blank")
    return request.withColumn("text", F.when(failed.isNotNull(), F.raise_error(failed)).otherwise(F.col("text")))


def checked_response(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores (request_id, index, score) of requests that got exactly one a document; another number is an error."""
    sizes = [d.groupBy("request_id").agg(F.count("*").alias(n)) for d, n in ((documents, "n_documents"), (scores, "n_scores"))]
    told = sizes[0].join(sizes[1], "request_id", "left").fillna(0, ["n_scores"])
    odd = F.concat(F.lit("the model gave "), "n_scores", F.lit(" scores for "), "n_documents", F.lit(" documents"))
    fine = told.withColumn("ok", F.when(F.col("n_scores") != F.col("n_documents"), F.raise_error(odd).cast("boolean")).otherwise(F.lit(True)))
    return fine.where("ok").select("request_id").join(scores, "request_id")


# ------------------------------------------------------------------ language models and stores


def llm_status(spark: SparkSession, model: Callable | None, answers: DataFrame | None = None) -> DataFrame:
    """A status row; ``answers`` as ``context.answer_with`` gives them, where one that fell back counts as a failure."""
    if model is None:
        return _status(spark, "llm", "extractive", "not_configured", configured=False)
    last = answers.where("fallback_reason = 'llm_error'").agg(F.count("*").alias("n"), F.max("attempts").alias("attempts")).first() if answers else None
    failed = Outcome(None, f"{last.n} answers fell back", last.attempts) if last and last.n else None
    return _status(spark, "llm", "extractive" if failed else "external", "llm_error" if failed else "configured_model", failed)


def open_store(spark: SparkSession, primary: Callable | None, local: Callable, patience: Patience = Patience()) -> tuple[object, DataFrame]:
    """The store ``primary`` opens, or else ``local``'s; and a status row."""
    got = patience.ask(primary) if primary else None
    if got and got.error is None:
        return got.value, _status(spark, "vector_store", "primary", "configured_backend")
    return local(), _status(spark, "vector_store", "local", "store_error" if got else "not_configured", got, configured=got is not None)


def sync_or_fall_back(spark: SparkSession, target, local: Callable, docs: DataFrame, config: EngineConfig = EngineConfig(), patience: Patience = Patience()):
    """Sync ``target``; where it fails for good, sync ``local()`` instead.  (changes, store, status row)."""
    got = patience.ask(target.sync, docs)
    if got.error is None:
        return got.value, target, _status(spark, "vector_store", "primary", "configured_backend")
    other = local()
    return other.sync(docs), other, _status(spark, "vector_store", "local", "sync_error", got)


def stored_state(spark: SparkSession, target, reason: str = "rebuild_not_requested") -> DataFrame:
    """(path, embedding_identity, n_chunks, rebuilt, reason) of a store that no sync was asked of."""
    n = target.count() if target.exists() else 0
    return spark.createDataFrame([(target.path, target.identity, n, False, reason)], "path string, embedding_identity string, n_chunks long, rebuilt boolean, reason string")
