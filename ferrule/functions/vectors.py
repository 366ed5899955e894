"""Vector expressions over arrays, and hashed embeddings as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length; 0 where either is empty or null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda t, v: t + v)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over both norms; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def list_lengths(lists: pa.Array) -> np.ndarray:
    """Of each list its number of items; 0 for null."""
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(lengths: np.ndarray, limit: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``limit`` items and ``rows`` rows at most; each holds one row at least."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, before + limit, "right")), lo + 1)
        hi = hi if rows is None else min(hi, lo + rows)
        yield lo, hi
        lo = hi


def _hashed(found: pa.ListArray, dims: int) -> np.ndarray:
    """Unit-length hashed embeddings of lists of terms; zeros for a list without terms.  Each distinct term is hashed once."""
    lengths = list_lengths(found)
    terms = found.flatten().dictionary_encode()
    digests = [hashlib.sha256(t.encode("utf-8")).digest() for t in terms.dictionary.to_pylist()]
    slot = np.array([int.from_bytes(d[:4], "big") % dims for d in digests], np.int64)
    sign = np.array([-1.0 if d[4] & 1 else 1.0 for d in digests])
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(np.arange(len(lengths)), lengths) * dims + slot[code]
    out = np.bincount(place, sign[code], len(lengths) * dims).reshape(len(lengths), dims)
    return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-300)[:, None]


#: Places of dense embeddings, and terms, that a kernel holds at once (one row's at least).
PLACES, TERMS = 1_000_000, 400_000


def _parts(batch: pa.RecordBatch, dims: int) -> Iterator[pa.RecordBatch]:
    for lo, hi in pieces(list_lengths(batch.column(1)), TERMS, max(1, PLACES // dims)):
        yield batch.slice(lo, hi - lo)


def hashed_weights(rows: DataFrame, key: str, terms: str = "terms", dims: int = 1024) -> DataFrame:
    """(key, idx, weight): unit-length hashed embeddings, a row a place that is not zero."""
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("idx", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, dims):
                x = _hashed(part.column(1), dims)
                i, j = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(j, pa.int32()), pa.array(x[i, j])], names=schema.names)

    return rows.select(key, terms).mapInArrow(run, schema)


def hash_embeddings(rows: DataFrame, key: str, terms: str, dims: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector, carry): unit-length hashed embeddings as arrays, for kernels that multiply matrices.

    Runs over Arrow batches: an array of ``dims`` places filled by an expression would be
    walked once a term.  Rows without terms get zeros.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())), *[rows.schema[c] for c in carry]])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, dims):
                x = _hashed(part.column(1), dims)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, *[part.column(2 + i) for i in range(len(carry))]], names=schema.names)

    return rows.select(key, terms, *carry).mapInArrow(run, schema)
