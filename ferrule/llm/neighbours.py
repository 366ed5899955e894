"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get an extra component that turns the order by inner product into the order by
angle; a rotation learned on a bounded sample (principal directions, then iterative
quantisation) makes binary codes, which are split into substrings, each with a table of
its own.  By pigeonhole, a code within the radius of a query's code is within the radius
shared out to some substring, so probing the tables finds every code within the radius;
those candidates are ranked by their original vectors in double precision.

The radius is calibrated on the sample, where neighbours are sparser and so further away
than among all rows.  A query for which the radius holds fewer than ``k`` candidates is
asked again with the full radius, so every query gets ``k`` neighbours if there are as many.

Every row is indexed.  The tables are built shard by shard on the executors; the stated
queries visit all shards, in blocks of a bounded number of bytes that are broadcast one after
the other.  Only each shard's best ``k`` of a query are shuffled.  A query enumerates the keys
within its share of the radius and looks them up; a radius so wide that the keys enumerated
would name most of a shard's rows anyway is met by comparing all its codes, which finds the
same rows.

Defined results: rows whose id is null, and vectors that are null, empty, zero or hold
null or non-finite components, take no part; vectors of different lengths are searched
apart; rows that repeat the query's id are the query's own; queries that repeat an id are
asked apart, equal ones once; rows that repeat an id are listed once, with the best of their
scores; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, materialise, table

BITS = 64
SUBSTRING = 16
SAMPLE_ROWS = 8_192
SAMPLE_QUERIES = 256
#: Share of the sample's true neighbours that lie within the radius.
COVERAGE = 0.97
#: Rows and bytes of vectors whose tables are held at once.
SHARD_ROWS, SHARD_BYTES = 65_536, 64_000_000
#: Bytes of queries' vectors broadcast at once.
QUERY_BYTES = 32_000_000
#: Queries that a shard answers at once where codes are compared.
SCAN_QUERIES = 32
#: Probing must spare at least this share of a shard's rows to be worth its lookups.
SPARED = 0.75


class Codes:
    """The learned rotation, the radius, and how vectors become codes."""

    def __init__(self, sample: np.ndarray, longest: float, k: int, seed: int = 13):
        self.longest = max(longest, 1e-300)
        r = np.random.default_rng(seed)
        x = self.lifted(sample)
        n_bits = min(BITS, x.shape[1])
        _, vectors = np.linalg.eigh(x.T @ x)
        down = vectors[:, ::-1][:, :n_bits]
        v = x @ down
        turn, _ = np.linalg.qr(r.standard_normal((n_bits, n_bits)))
        for _ in range(30):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.projection = down @ turn
        self.n_bits = n_bits
        self.radius = self._calibrated(sample, k)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))]

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, substrings) codes; a query's extra component is zero."""
        y = np.c_[x / self.longest, np.zeros(len(x))] if query else self.lifted(x)
        bits = (y @ self.projection) >= 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")

    def _calibrated(self, sample: np.ndarray, k: int) -> int:
        q = sample[:SAMPLE_QUERIES]
        if len(sample) < 2:
            return self.n_bits
        near = q @ sample.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
        codes, asked = self.encode(sample, False), self.encode(q, True)
        apart = np.bitwise_count(codes[best] ^ asked[:, None, :]).sum(2)
        return int(np.quantile(apart, COVERAGE, method="higher"))


def _errors(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All patterns of ``bits`` bits, fewest errors first, and how many have 0, 0 to 1, ... errors."""
    patterns = np.arange(1 << bits, dtype=np.uint16)
    weight = np.bitwise_count(patterns)
    return patterns[np.argsort(weight, kind="stable")], np.cumsum(np.bincount(weight, minlength=bits + 1))


_PATTERNS, _BALL = _errors(SUBSTRING)


class Shard:
    """Tables of substrings over some rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        keys = np.arange((1 << SUBSTRING) + 1)
        self.starts = [np.searchsorted(c[o], keys) for c, o in zip(codes.T, self.order, strict=True)]

    def shares(self, radius: int) -> list[int]:
        """Errors allowed in each substring: more errors in all of them than that exceed the radius."""
        share, rest = divmod(radius, len(self.order))
        return [share if j <= rest else share - 1 for j in range(len(self.order))]

    def probes(self, radius: int) -> bool:
        """Whether the enumerated keys name few enough rows."""
        named = sum(_BALL[min(a, SUBSTRING)] for a in self.shares(radius) if a >= 0)
        return named <= (1 - SPARED) * (1 << SUBSTRING)

    def probed(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``asked`` in at most ``radius`` bits, by looking up keys."""
        seen = np.zeros(len(self.ids), bool)
        for j, allowed in enumerate(self.shares(radius)):
            if allowed >= 0:
                keys = asked[j] ^ _PATTERNS[: _BALL[min(allowed, SUBSTRING)]]
                lo, hi = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1]
                held = hi > lo
                lo, sizes = lo[held], (hi - lo)[held]
                at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                seen[self.order[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ asked).sum(1) <= radius]

    def apart(self, asked: np.ndarray) -> np.ndarray:
        """(queries, rows) bits in which codes differ."""
        kind = "<u8" if self.codes.shape[1] % 4 == 0 else "<u2"
        out = np.zeros((len(asked), len(self.ids)), np.uint8)
        for theirs, own in zip(asked.view(kind).T, self.codes.view(kind).T, strict=True):
            out += np.bitwise_count(theirs[:, None] ^ own)
        return out

    def ranked(self, rows: np.ndarray, q: np.ndarray, k: int):
        """The ``k`` nearest of some rows, each id once, ties to the smaller id."""
        score = (self.x[rows] * q).sum(1)
        order = np.lexsort((self.ids[rows], -score))
        if self.repeats > 1:
            _, first = np.unique(self.ids[rows[order]], return_index=True)
            order = order[np.sort(first)]
        return self.ids[rows[order[:k]]], score[order[:k]]

    def nearest(self, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, radius: int, k: int):
        """Of each query, the ``k`` nearest rows among those within the radius: (ids, scores)."""
        n, wanted = len(self.ids), k * self.repeats
        if self.probes(radius):
            for i in range(len(ids)):
                rows = self.probed(asked[i], radius)
                yield self.ranked(rows[self.ids[rows] != ids[i]], q[i], k)
            return
        for lo in range(0, len(ids), SCAN_QUERIES):
            near = q[lo : lo + SCAN_QUERIES] @ self.x.T
            near[(self.apart(asked[lo : lo + SCAN_QUERIES]) > radius) | (self.ids == ids[lo : lo + SCAN_QUERIES, None])] = -np.inf
            # a product of matrices may differ in the last bits, so what is near the edge is scored again
            edge = np.partition(near, n - wanted, axis=1)[:, n - wanted] if n > wanted else np.full(len(near), -np.inf)
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0.0)))
            for i, row in enumerate(near):
                yield self.ranked(np.flatnonzero((row >= edge[i] - slack[i]) & (row > -np.inf)), q[lo + i], k)


_RESULT = T.StructType(
    [T.StructField("q", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]
)


def _search(rows: DataFrame, places: np.ndarray, ids: np.ndarray, q: np.ndarray, codes: Codes, radius: int, k: int) -> DataFrame:
    """Each shard's nearest rows of every query; ``places`` tell queries of one id apart."""
    shipped = rows.sparkSession.sparkContext.broadcast((places, ids, q))
    shard_rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * q.shape[1])))

    def run(batches):
        places, ids, q = shipped.value
        asked = codes.encode(q, True)
        waiting, n = [], 0

        def searched():
            own = np.concatenate([w[0] for w in waiting])
            x = np.concatenate([w[1] for w in waiting])
            shard = Shard(own, x, codes.encode(x, False))
            for lo in range(0, len(ids), 512):
                got = list(shard.nearest(ids[lo : lo + 512], q[lo : lo + 512], asked[lo : lo + 512], radius, k))
                sizes = [len(g[0]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(places[lo : lo + len(got)], sizes), pa.int64()),
                        pa.array(np.repeat(ids[lo : lo + len(got)], sizes), pa.int64()),
                        pa.array(np.concatenate([g[0] for g in got]), pa.int64()),
                        pa.array(np.concatenate([g[1] for g in got]), pa.float64()),
                    ],
                    names=_RESULT.names,
                )

        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for lo in range(0, batch.num_rows, shard_rows):
                waiting.append((batch.column(0).to_numpy()[lo : lo + shard_rows], vectors[lo : lo + shard_rows]))
                n += len(waiting[-1][0])
                if n >= shard_rows:
                    yield from searched()
                    waiting, n = [], 0
        if n:
            yield from searched()

    return rows.mapInArrow(run, _RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("q", "query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of some rows, brought to the driver as arrays."""
    got = rows.select("vec_id", "x").toArrow().combine_chunks()
    ids, x = got.column(0).to_numpy(), got.column(1).combine_chunks()
    return ids, x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def nearest_neighbours(vectors: DataFrame, is_query: F.Column, k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row with ``is_query``."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~odd & F.exists("x", lambda v: v != 0))
    clean = clean.where(F.size("x") > 0)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    kinds = clean.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest")).collect()
    results = []
    for kind in sorted(kinds):
        rows = clean.where(F.size("x") == kind.width)
        digest = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
        share = min(1.0, 1.2 * SAMPLE_ROWS / kind.n)
        sample = _vectors(rows.where(digest < int(share * (1 << 40))).orderBy(digest, "vec_id").limit(SAMPLE_ROWS))[1]
        codes = Codes(sample if len(sample) else np.ones((1, kind.width)), kind.longest, k)
        asking = materialise(rows.where(is_query).distinct(), "queries")
        n_blocks = max(1, -(-asking.count() * 8 * kind.width // query_bytes))
        for b in range(n_blocks):
            part = asking if n_blocks == 1 else asking.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks)) == b)
            ids, q = _vectors(part.orderBy("vec_id"))
            if not len(ids):
                continue
            places = np.arange(len(ids))
            found = materialise(_best(_search(rows, places, ids, q, codes, codes.radius, k), k), "neighbours")
            counts = found.groupBy("q").agg(F.count("*").alias("n")).toArrow()  # a row a query of the block
            have = dict(zip(counts["q"].to_pylist(), counts["n"].to_pylist(), strict=True))
            again = np.array([have.get(i, 0) < min(k, kind.n - 1) for i in places.tolist()])
            if again.any():
                asked_again = spark.createDataFrame(pa.table({"q": places[again]}))
                whole = _best(_search(rows, places[again], ids[again], q[again], codes, codes.n_bits, k), k)
                found = found.join(asked_again, "q", "left_anti").select(*whole.columns).unionByName(whole)
            results.append(found)
        discard(asking)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_neighbours(spark, sf_dir) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
