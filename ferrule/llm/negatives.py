"""Hard negatives: rows of another label that are nearly as near to an anchor as its positives.

Vectors are turned by an orthogonal rotation to principal directions, so that the first
components hold most of a product.  Of each anchor and row the product over the leading
components is known first; the rest is at most the product of both residual norms, plus slack
for rounding.  What that bound keeps from an anchor's best rows, or from the band under a
positive's score, is discarded; what is left gets more components, and what is left at the end
is decided by the product of the integer vectors alone.

Anchors are a stated set: they are shipped in blocks of bounded bytes, and all rows pass by
each block, first for the positives and then for the negatives.  A task keeps the best of an
anchor over all its rows, so what is shuffled is tasks times anchors times ``k``, however hot
a label or a vector is.  A pass over the rows multiplies each with a whole block, which takes
far longer than reading it: the number of passes does not decide the time.

Defined results: rows without an id, label or vector, and vectors with a null or non-finite
component, take no part; nor do those with a component so large that a product could leave 64
bits.  Vectors of different lengths do not meet.  Rows that repeat an id and have the same
score to an anchor count once; an anchor's own id is neither its positive nor its negative;
anchors that repeat an id are asked apart, equal ones once.  A positive score below zero has no
negatives.  An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of a positive's.
LOW, HIGH = 50, 95
#: Rows the rotation is learned from; it decides nothing but the speed.
SAMPLE_ROWS = 8_192
#: Bytes of anchors' vectors broadcast at once, anchors and rows multiplied at once, numbers gathered at once.
ANCHOR_BYTES, ANCHORS, ROWS, GATHERED = 16_000_000, 512, 2_048, 2_000_000
_NONE = np.iinfo(np.int64).min


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """The principal directions of some vectors, most telling first: an orthogonal matrix."""
    x = sample.astype(float)
    x /= max(1.0, np.abs(x).max(initial=0.0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1] if x.shape[1] else np.zeros((0, 0))


def cuts_of(width: int) -> list[int]:
    """How many leading components are looked at, step by step."""
    return sorted({-(-width // 4), -(-width // 2), width})


class Side:
    """Integer vectors with their rotated parts and what the parts leave out."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        y = x.astype(float) @ rotation
        cuts = cuts_of(x.shape[1])
        self.parts = [y[:, lo:hi] for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]
        self.norm = np.sqrt((y * y).sum(1))
        self.rest = [np.sqrt((y[:, c:] ** 2).sum(1)) for c in cuts]
        # rounding of a rotated component and of a sum of products, and how far the rotation is from orthogonal
        width = max(1, x.shape[1])
        off = np.abs(rotation @ rotation.T - np.eye(x.shape[1])).sum(1).max(initial=0.0)
        self.slack = 16 * width * width * np.finfo(float).eps + 2 * off

    def taken(self, rows) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.x, out.norm, out.slack = self.ids[rows], self.labels[rows], self.x[rows], self.norm[rows], self.slack
        out.parts, out.rest = [p[rows] for p in self.parts], [r[rows] for r in self.rest]
        return out


def reached(a: Side, x: Side, able: np.ndarray | None, least: np.ndarray, most: np.ndarray):
    """(anchor, row, score) of the able pairs whose integer product lies from ``least`` to ``most`` of the anchor.

    ``able`` masks pairs (None: all); bounds are a number an anchor.
    """
    least, most = least.astype(float), most.astype(float)
    near = a.parts[0] @ x.parts[0].T
    reach = np.outer(a.rest[0], x.rest[0]) + a.slack * np.outer(a.norm, x.norm) + 1e-3
    kept = (near + reach >= least[:, None]) & (near - reach <= most[:, None])
    if able is not None:
        kept &= able
    at, row = np.nonzero(kept)
    partial = near[at, row]
    step = max(1, GATHERED // max(1, a.x.shape[1]))
    found = []
    for lo in range(0, len(at), step):
        i, j, p = at[lo : lo + step], row[lo : lo + step], partial[lo : lo + step]
        for k in range(1, len(a.parts)):
            p = p + np.einsum("ij,ij->i", a.parts[k][i], x.parts[k][j])
            reach = a.rest[k][i] * x.rest[k][j] + a.slack * a.norm[i] * x.norm[j] + 1e-3
            ok = (p + reach >= least[i]) & (p - reach <= most[i])
            i, j, p = i[ok], j[ok], p[ok]
        found.append((i, j, np.einsum("ij,ij->i", a.x[i], x.x[j])))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


class Best:
    """The ``k`` best (score, id) of a number of lists: higher scores first, then smaller ids, equal ones once."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE)
        self.id = np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.score[at, -1]
        at, score, ids = at[ok], score[ok], ids[ok]
        if not len(at):
            return
        k = self.score.shape[1]
        lists = np.unique(at)
        held = self.score[lists] != _NONE
        at = np.r_[at, np.repeat(lists, held.sum(1))]
        score, ids = np.r_[score, self.score[lists][held]], np.r_[ids, self.id[lists][held]]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        at, score, ids = at[new], score[new], ids[new]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < k
        at, place = at[first], place[first]
        self.score[at, place], self.id[at, place] = score[first], ids[first]

    def rows(self):
        """(list, score, id) of all that is held."""
        at, place = np.nonzero(self.score != _NONE)
        return at, self.score[at, place], self.id[at, place]


def _chunks(n: int):
    """Index ranges of rows, small ones first: the first rows raise the bounds of all later ones."""
    lo, size = 0, 64
    while lo < n:
        yield lo, min(n, lo + size)
        lo, size = lo + size, min(ROWS, size * 4)


def _same_label(anchors: Side, x: Side, best: Best) -> None:
    """Adds rows with an anchor's label to its best; anchors lie in the order of their labels."""
    order = np.argsort(x.labels, kind="stable")
    labels, starts = np.unique(x.labels[order], return_index=True)
    for label, rows in zip(labels, np.split(order, starts[1:]), strict=True):
        first, last = np.searchsorted(anchors.labels, label), np.searchsorted(anchors.labels, label, side="right")
        for lo in range(first, last, ANCHORS):
            held = np.arange(lo, min(last, lo + ANCHORS))
            a, part = anchors.taken(held), x.taken(rows)
            edge = np.where(best.score[held, -1] == _NONE, -np.inf, best.score[held, -1])
            at, row, score = reached(a, part, a.ids[:, None] != part.ids, edge, np.full(len(held), np.inf))
            best.add(held[at], score, part.ids[row])


def _other_label(anchors: Side, x: Side, best: Best, low: np.ndarray, high: np.ndarray) -> None:
    """Adds rows of other labels to the lists of the positives into whose band their score falls."""
    n_bands = low.shape[1]
    for lo in range(0, len(anchors.ids), ANCHORS):
        held = np.arange(lo, min(len(anchors.ids), lo + ANCHORS))
        lists = held[:, None] * n_bands + np.arange(n_bands)
        edge = np.maximum(low[held], best.score[lists, -1].astype(float))
        a = anchors.taken(held)
        able = (a.labels[:, None] != x.labels) & (a.ids[:, None] != x.ids)
        at, row, score = reached(a, x, able, edge.min(1), np.where(edge <= high[held], high[held], -np.inf).max(1))
        for band in range(n_bands):
            ok = (score >= edge[at, band]) & (score <= high[held][at, band])
            best.add(lists[at[ok], band], score[ok], x.ids[row[ok]])


def _pass(rows: DataFrame, shipped: tuple, rotation: np.ndarray, k: int) -> DataFrame:
    """(a, band, score, vec_id): each task's best of each anchor, or of each of its positives.

    ``shipped``: keys, ids, labels and vectors of anchors in the order of their labels, then
    None, or lower and upper scores of their positives' bands.
    """
    sent = rows.sparkSession.sparkContext.broadcast((*shipped, rotation))

    def run(batches):
        keys, ids, labels, vectors, low, high, turn = sent.value
        anchors = Side(ids, labels, vectors, turn)
        n_bands = 1 if low is None else low.shape[1]
        best = Best(len(keys) * n_bands, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, theirs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for lo, hi in _chunks(batch.num_rows):
                part = Side(own[lo:hi], theirs[lo:hi], x[lo:hi], turn)
                if low is None:
                    _same_label(anchors, part, best)
                else:
                    _other_label(anchors, part, best, low, high)
        at, score, found = best.rows()
        for lo in range(0, len(at), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at[part] // n_bands]), pa.array((at[part] % n_bands).astype(np.int32)), pa.array(score[part]), pa.array(found[part])],
                names=["a", "band", "score", "vec_id"],
            )

    return rows.select("vec_id", "label", "x").mapInArrow(run, "a long, band int, score long, vec_id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each list over all tasks, with their rank from 1."""
    order = Window.partitionBy("a", "band").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrays(rows: DataFrame, width: int):
    """Keys, ids, labels and vectors of a block of anchors, brought to the driver in the order of their labels."""
    got = rows.select("a", "vec_id", "label", "x").orderBy("label", "a").toArrow().combine_chunks()
    keys, ids, labels = (got.column(i).to_numpy() for i in range(3))
    x = got.column(3).combine_chunks()
    return keys, ids, labels, x.flatten().to_numpy().reshape(len(keys), width)


def _bands(found: DataFrame, keys: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of the negatives of each anchor's positives; none where there is no positive."""
    got = found.select("a", "rank", "score").toArrow()  # at most k rows an anchor of the block
    order = np.argsort(keys)
    at = order[np.searchsorted(keys, got.column("a").to_numpy(), sorter=order)]
    place, score = got.column("rank").to_numpy() - 1, got.column("score").to_numpy()
    least, most = np.full((len(keys), k), np.inf), np.full((len(keys), k), -np.inf)
    least[at, place], most[at, place] = -((-low * score) // 100), (high * score) // 100
    return least, most


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row with ``is_anchor``.

    ``vectors``: vec_id, label, embedding.  Each component x counts as floor(256 * x).
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), is_anchor.alias("asked"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    given = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~odd)
    results = []
    for width, n in sorted(map(tuple, given.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).collect())):
        largest = isqrt((2**63 - 1) // (128 * max(1, width)))
        within = F.coalesce(F.greatest(F.abs(F.array_min("x")), F.abs(F.array_max("x"))) < largest / 256, F.lit(True))
        rows = given.where((F.size("x") == width) & within)
        rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(256 * v)))
        digest = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 40))
        sample = rows.withColumn("a", digest).where(F.col("a") < int(min(1.0, 1.2 * SAMPLE_ROWS / n) * (1 << 40)))
        rotation = rotation_of(_arrays(sample.orderBy("a").limit(SAMPLE_ROWS), width)[3])
        anchors = rows.where("asked").select("vec_id", "label", "x").distinct()
        anchors = materialise(anchors.withColumn("a", F.monotonically_increasing_id()), "anchors")
        n_blocks = max(1, -(-anchors.count() * 8 * max(1, width) // anchor_bytes))
        for b in range(n_blocks):
            block = _arrays(anchors.where(F.pmod(F.xxhash64("a"), F.lit(n_blocks)) == b), width)
            if not len(block[0]):
                continue
            near = materialise(_first(_pass(rows, (*block, None, None), rotation, positives), positives), "positives")
            bands = _bands(near, block[0], positives, low, high)
            found = _first(_pass(rows, (*block, *bands), rotation, negatives), negatives)
            pairs = near.select("a", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            found = found.select("a", "band", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            found = found.join(pairs, ["a", "band"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
            results.append(materialise(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
            discard(near)
        discard(anchors)
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
