"""Dense recall: each query's nearest rows, by blocks of queries that visit all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .lexical import score_key, top_k

#: Bytes of queries' vectors shipped at once.
BLOCK_BYTES = 32_000_000
#: Bytes of rows' vectors multiplied at once: an Arrow batch may hold ten times as many.
ROW_BYTES = 8_000_000


def _matrix(vectors, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` places of each vector, and each whole vector's norm."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        x = flat.reshape(len(lengths), width).copy()
        return x, np.linalg.norm(x, axis=1)
    x, sizes, at = np.zeros((len(lengths), width)), np.zeros(len(lengths)), 0
    for i, n in enumerate(lengths):
        x[i, : min(n, width)] = flat[at : at + min(n, width)]
        sizes[i] = np.linalg.norm(flat[at : at + n])
        at += n
    return x, sizes


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Which places hold a row's ``k`` largest keys; of equal ones at the edge the first."""
    n = keys.shape[1]
    if n <= k:
        return np.ones(keys.shape, bool)
    edge = np.partition(keys, n - k, axis=1)[:, n - k, None]
    hit = keys >= edge
    for i in np.flatnonzero(hit.sum(1) > k):
        level = np.flatnonzero(keys[i] == edge[i])
        hit[i, level[k - int((keys[i] > edge[i]).sum()) :]] = False
    return hit


class _Askers:
    """The distinct askers of a block of queries, and which rows of a batch each of them sees."""

    def __init__(self, queries: pa.Table):
        rows = [(frozenset(a or ()), d) for a, d in zip(queries["allowed"].to_pylist(), queries["as_of"].to_pylist(), strict=True)]
        place = {asker: i for i, asker in enumerate(dict.fromkeys(rows))}
        self.of = np.array([place[asker] for asker in rows], np.int64)
        self.allowed, self.day = [a for a, _ in place], np.array([d for _, d in place], np.int64)

    def seen(self, batch: pa.RecordBatch) -> np.ndarray:
        """(askers, rows); rows share few sets of scopes, which are compared once."""
        sets: dict[tuple, int] = {}
        own = np.array([sets.setdefault(tuple(s or ()), len(sets)) for s in batch.column("scopes").to_pylist()], np.int64)
        meets = np.array([[not a.isdisjoint(s) for s in sets] for a in self.allowed], bool).reshape(len(self.allowed), len(sets))
        first, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("from_day", "to_day"))
        return meets[:, own] & (first <= self.day[:, None]) & (last >= self.day[:, None])


def dense_topk(
    queries: DataFrame, rows: DataFrame, k: int, *, normalised: bool = False, min_score: float | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` rows with the largest inner product, or cosine if ``normalised``.

    ``queries``: query_id, vector.  ``rows``: key, vector.  Ids may be of any type and keep
    it.  Queries are shipped in blocks of a bounded number of bytes; each task multiplies a
    batch of rows with a block and passes on its own best ``k`` of each query, ties to the
    smaller key, so what is shuffled is ``k`` rows a query and batch.  A pair with an empty
    vector scores 0; vectors of different lengths are compared over the shorter one.

    Where queries carry ``allowed`` and ``as_of``, rows carry ``scopes``, ``from_day`` and
    ``to_day``, and a query finds only rows that its asker sees.
    """
    by_asker = "allowed" in queries.columns
    who, what = (["allowed", "as_of"], ["scopes", "from_day", "to_day"]) if by_asker else ([], [])
    spark = queries.sparkSession
    q_type, key_type = queries.schema["query_id"].dataType, rows.schema["key"].dataType
    filled = F.coalesce(F.col("vector").cast("array<double>"), F.array().cast("array<double>")).alias("vector")
    asked, held = materialise(queries.select("query_id", filled, *who), "asked"), rows.select("key", filled, *what)
    found = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(found.width or 0, 1)
    blocks = max(1, -(-found.n * width * 8 // block_bytes))
    schema = T.StructType([T.StructField("query_id", q_type), T.StructField("key", key_type), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        q, sizes = _matrix(got["vector"].chunk(0), width) if got.num_rows else (np.zeros((0, width)), np.zeros(0))
        if normalised:
            q /= np.maximum(sizes, 1e-300)[:, None]
        shipped = spark.sparkContext.broadcast((got["query_id"].combine_chunks(), q, _Askers(got) if by_asker else None))

        def run(batches, shipped=shipped):
            ids, q, askers = shipped.value
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                order = pc.array_sort_indices(batch.column(0))  # so that the first of equal ones has the smaller key
                step, hits = max(1, ROW_BYTES // (8 * width)), []
                for start in range(0, batch.num_rows, step):
                    part = batch.take(order.slice(start, step))
                    x, sizes = _matrix(part.column(1), width)
                    if normalised:
                        x /= np.maximum(sizes, 1e-300)[:, None]
                    seen = askers.seen(part) if by_asker else None
                    for lo in range(0, len(q), 256):
                        near = q[lo : lo + 256] @ x.T
                        if by_asker:
                            near[~seen[askers.of[lo : lo + 256]]] = -np.inf
                        hit = _best(np.round(near * 1_000_000), k)
                        if by_asker:
                            hit &= near > -np.inf
                        if min_score is not None:
                            hit &= near >= min_score
                        i, j = np.nonzero(hit)
                        hits.append((lo + i, start + j, near[i, j]))
                i, j, score = (np.concatenate(c) for c in zip(*hits, strict=True))
                if batch.num_rows > step:  # a query's best of all parts
                    first = np.lexsort((j, -np.round(score * 1_000_000), i))
                    i, j, score = i[first], j[first], score[first]
                    own = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j, score = i[own], j[own], score[own]
                keys = batch.column(0).take(order.take(pa.array(j)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), keys, pa.array(score)], names=schema.names)

        found = held.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, [F.desc(score_key()), F.col("key")])
