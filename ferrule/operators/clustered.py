"""Dense recall that reads a part of the rows: vectors in lists around centroids, with residual codes.

A bounded sample gives centroids; every row lies in the list of its nearest one, in files of
its list.  Beside its vector a row has a code, its difference from the centroid in eight bits a
place.  A query reads the codes of the lists whose centroids are nearest to it, and only of the
rows its asker sees; of its best rows by code the vectors are fetched and scored exactly.  How
many lists a query reads follows from the sample: as many as hold the wanted share of the
sample's true neighbours.  Asked for all lists, and for the vectors of all rows, it is exact.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .dense import BLOCK_BYTES, _Askers, _best, _matrix
from .lexical import score_key, top_k

#: Rows of the sample, lists at most, rows a list is meant to hold, rounds of the centroids.
SAMPLE_ROWS, MOST_LISTS, LIST_ROWS, ROUNDS = 16_384, 4_096, 4_096, 12
#: Share of the sample's neighbours that the lists read must hold, of so many queries, and candidates by code for each row wanted.
COVERAGE, SAMPLE_QUERIES, CANDIDATES = 0.97, 512, 8
_ACCESS = ("scopes", "from_day", "to_day")


def centroids_of(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``n`` centroids by Lloyd's rounds; one that loses all its rows starts anew at a row far from its own."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        far = 2 * (x @ c.T) - (c * c).sum(1)
        own = far.argmax(1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            c[empty] = x[np.argsort(far.max(1) - (x * x).sum(1), kind="stable")[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * (x @ c.T) - (c * c).sum(1)).argmax(1)


@dataclass(frozen=True)
class VectorLists:
    """Vectors in lists, in the folder ``path``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    schema: T.StructType

    @classmethod
    def build(cls, rows: DataFrame, path: str, k: int = 12, coverage: float = COVERAGE) -> VectorLists:
        """``rows``: key, vector, and access columns if askers are to differ.  Vectors of another length than most are cut or filled with zeros."""
        spark = rows.sparkSession
        given = rows.where("vector IS NOT NULL").withColumn("vector", F.col("vector").cast("array<double>"))
        shape = given.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
        n, width = (shape[0].n, max(1, shape[0].w)) if shape else (0, 1)
        share = min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1))
        digest = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
        got = given.where(digest < int(share * (1 << 40))).orderBy(digest, "key").limit(SAMPLE_ROWS).select("vector").toArrow().combine_chunks()
        x = _matrix(got["vector"].combine_chunks(), width)[0] if got.num_rows else np.zeros((1, width))
        lists = max(1, min(MOST_LISTS, -(-n // LIST_ROWS), len(x)) if n > LIST_ROWS else min(len(x), max(1, int(np.sqrt(n)) // 2)))
        c = centroids_of(x, lists)
        probes = cls._calibrated(x, c, k, coverage)
        sent = spark.sparkContext.broadcast(c)  # at most MOST_LISTS vectors
        held = [f for f in given.schema.fields if f.name in ("key", *_ACCESS)]
        schema = T.StructType([*held, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()), T.StructField("scale", T.FloatType())])

        def place(batches):
            c = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(batch.num_columns - 1), c.shape[1])[0]
                own = _nearest(x, c)
                rest = x - c[own]
                scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                columns = [*batch.columns[:-1], vectors, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(own.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "list"])

        whole = T.StructType([*schema.fields, T.StructField("list", T.IntegerType())])
        placed = given.select(*[f.name for f in held], "vector").mapInArrow(place, whole)
        # a list that holds a large share of the rows is written by several tasks
        parts = max(1, -(-n // (8 * LIST_ROWS)))
        placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", F.pmod(F.xxhash64("key"), F.lit(parts))).write.mode("error").partitionBy("list").parquet(f"{path}/rows")
        about = [(json.dumps({"probes": probes, "centroids": c.tolist(), "schema": json.loads(schema.json())}),)]
        spark.createDataFrame(about, "about string").coalesce(1).write.mode("error").json(f"{path}/about")
        return cls(spark, path, c, probes, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorLists:
        about = json.loads(spark.read.schema("about string").json(f"{path}/about").first().about)
        return cls(spark, path, np.array(about["centroids"]), about["probes"], T.StructType.fromJson(about["schema"]))

    @staticmethod
    def _calibrated(x: np.ndarray, c: np.ndarray, k: int, coverage: float) -> int:
        """Lists that a query must read so that they hold the share of the sample's best ``k``."""
        q = x[:SAMPLE_QUERIES]
        near = q @ x.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argsort(-near, axis=1)[:, : max(1, min(k, len(x) - 1))]
        place = np.empty((len(q), len(c)), np.int64)  # of each list among those of a query
        np.put_along_axis(place, np.argsort(-(q @ c.T), axis=1, kind="stable"), np.arange(len(c))[None, :], 1)
        return int(np.quantile(np.take_along_axis(place, _nearest(x, c)[best], 1), coverage, method="higher")) + 1

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("list", T.IntegerType())])
        found = self.spark.read.schema(whole).parquet(f"{self.path}/rows")
        return found if lists is None else found.where(F.col("list").isin([int(i) for i in lists]))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(query_id, key, score, rank): the ``k`` largest inner products found; with ``exact`` of all rows.

        ``queries``: query_id, vector, and ``allowed`` and ``as_of`` where askers differ.  They are
        shipped in blocks of bounded bytes; a block reads the lists that its queries probe.
        """
        by_asker = "allowed" in queries.columns
        width, lists = self.centroids.shape[1], len(self.centroids)
        probes = lists if exact else min(lists, probes or self.probes)
        wanted = k if exact else k * CANDIDATES
        asked = materialise(queries.select("query_id", F.coalesce(F.col("vector").cast("array<double>"), F.array().cast("array<double>")).alias("vector"), *(["allowed", "as_of"] if by_asker else [])), "asked")
        blocks = max(1, -(-asked.count() * width * 8 // block_bytes))
        kinds = [queries.schema["query_id"].dataType, self.schema["key"].dataType]
        schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("key", kinds[1]), T.StructField("score", T.DoubleType())])
        columns = ["key", "list", *(["vector"] if exact else ["code", "scale"]), *(_ACCESS if by_asker else ())]
        out = None
        for b in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            got = part.toArrow().combine_chunks()
            q = _matrix(got["vector"].combine_chunks(), width)[0] if got.num_rows else np.zeros((0, width))
            order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            reads = np.zeros((len(q), lists), bool)
            np.put_along_axis(reads, order, True, 1)
            sent = self.spark.sparkContext.broadcast((got["query_id"].combine_chunks() if got.num_rows else None, q, reads, self.centroids, _Askers(got) if by_asker and got.num_rows else None))
            named = None if probes == lists else np.flatnonzero(reads.any(0)).tolist()

            def run(batches, sent=sent):
                ids, q, reads, c, askers = sent.value
                for batch in batches:
                    if not batch.num_rows or not len(q):
                        continue
                    batch = batch.take(pa.compute.array_sort_indices(batch.column(0)))  # so that the first of equal ones has the smaller key
                    own = batch.column(1).to_numpy()
                    if exact:
                        x = _matrix(batch.column(2), c.shape[1])[0]
                    else:
                        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                        x = c[own] + code * batch.column(3).to_numpy()[:, None]
                    seen = askers.seen(batch) if askers else None
                    for lo in range(0, len(q), 256):
                        near = q[lo : lo + 256] @ x.T
                        near[~reads[lo : lo + 256][:, own]] = -np.inf
                        if seen is not None:
                            near[~seen[askers.of[lo : lo + 256]]] = -np.inf
                        i, j = np.nonzero(_best(np.round(near * 1_000_000), wanted) & (near > -np.inf))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + i)), batch.column(0).take(pa.array(j)), pa.array(near[i, j])], names=schema.names)

            found = self.rows(named).select(*columns).mapInArrow(run, schema)
            out = found if out is None else out.unionByName(found)
        best = top_k(out, wanted, [F.desc(score_key()), F.col("key")])
        if exact:
            return best
        best = materialise(best.select("query_id", "key"), "candidates")
        vectors = self.rows().select("key", "vector").join(best.select("key").distinct(), "key", "left_semi")
        met = best.join(vectors, "key").join(asked.select("query_id", F.col("vector").alias("q")), "query_id")
        score = F.aggregate(F.arrays_zip("q", "vector"), F.lit(0.0), lambda a, p: a + F.coalesce(p["q"], F.lit(0.0)) * F.coalesce(p["vector"], F.lit(0.0)))
        return top_k(met.select("query_id", "key", score.alias("score")), k, [F.desc(score_key()), F.col("key")])
