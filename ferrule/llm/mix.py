"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source shuffles its documents by a digest of their content and queues them up to
three times.  A copy's virtual finish time is the source's words up to the middle of the
copy divided by the source's target, so all sources reach their targets at the same
virtual time.  The copies of all sources, ordered by virtual time, are cut where the
total budget is reached.

No window ever holds a source: running totals come from totals of (source, digest bucket)
cells plus a running total within a cell; the cut is found the same way over ranges of
virtual time.  Cell counts follow the number of rows, so a cell stays near ``CELL_ROWS``
rows however hot the source.

Defined results: a null text has size 0; documents of size 0, and sources without words,
are returned with ``taken`` 0; a null source is a source of its own, last in order;
repeated rows are queued one by one (equal rows are interchangeable); an empty table
gives an empty result; columns of the input other than doc_id, text and source are left
out unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows that a cell of running totals holds on average.
CELL_ROWS = 2_000
#: Cells of a source at most.
MOST_CELLS = 1 << 16
#: Ranges that a unit of virtual time is divided into, and each of those again.
FIRST_RANGES = 4096
#: A list of sources up to this long is broadcast; a longer one is joined by shuffling.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than blank and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, n_rows, source_size) with ``target``: the budget shared by weight, capped at ``repeats`` sizes.

    Water filling in closed form: in order of cap over weight, a source is capped when
    that ratio is at most the level that the rest of the budget would give it
    and those after it; the level of the first that is not capped (the highest of those)
    is everyone's.  One row a source, so the windows are as small as the list of sources.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")))
        .select("source", "n_rows", "source_size", "target", "budget")
    )


def mix(
    documents: DataFrame,
    weights=WEIGHTS,
    share: float = 1.0,
    repeats: int = MAX_REPEATS,
    seed: str = "mix",
    keep: tuple[str, ...] = ("doc_id",),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``keep`` and size, source_size, target and taken of every document.

    Texts are read once; what follows works on a few dozen bytes a document.
    """
    text = F.col("text").cast("string")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    docs = materialise(
        documents.select(
            *[F.col(c) for c in keep],
            F.col("source").cast("string").alias("__source"),
            word_count(text).alias("size"),
            F.md5(named.cast("binary")).alias("__digest"),
        ),
        "mix-sizes",
    )
    sizes = docs.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    sources = materialise(source_targets(sizes, weights, share, repeats), "mix-sources").withColumnRenamed("source", "__s")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = docs.join(sources, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")

    # Running totals of a source in digest order: totals of the cells before, then within the cell.
    n_cells = F.least(F.greatest(F.ceil(F.col("n_rows") / cell_rows), F.lit(1)), F.lit(MOST_CELLS)).cast("long")
    head = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__cell", F.floor(head * n_cells / F.lit(2.0**32)).cast("long"))
    key = ["__source", "__cell"]
    totals = rows.groupBy(*key).agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__source").alias("__os"), F.col("__cell").alias("__oc"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy(*key).orderBy("__digest").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(offsets, F.col("__source").eqNullSafe(F.col("__os")) & (F.col("__cell") == F.col("__oc"))).select(
        *keep, "size", "source_size", "target", "budget",
        (F.col("__offset") + F.sum("size").over(within) - F.col("size") / 2).alias("__middle"),
    )
    queued = materialise(queued, "mix-queued")
    discard(docs)
    discard(sources)

    live = (F.col("size") > 0) & (F.col("target") > 0)
    finishes = F.array(*[(F.col("__middle") + F.col("source_size") * i) / F.col("target") for i in range(repeats)])
    cut = _cut(queued.where(live).select("size", "budget", F.explode(finishes).alias("__finish")))
    n_taken = F.aggregate(finishes, F.lit(0), lambda n, f: n + F.when(f <= cut, 1).otherwise(0))
    taken = F.when(live, F.col("size") * n_taken).otherwise(F.lit(0)).cast("long").alias("taken")
    return queued.select(*keep, "size", "source_size", "target", taken)


def _cut(copies: DataFrame) -> float:
    """The finish time of the last copy that begins within the budget, in order of finish time.

    Words are totalled over ranges of finish time; the range in which the budget is
    reached is divided again, and last the distinct times within 2**-24 are put in order.
    """
    finish = F.col("__finish") * FIRST_RANGES
    spent = 0
    for ranges in (FIRST_RANGES * 4, FIRST_RANGES, None):
        at = F.least(F.floor(finish), F.lit(ranges - 1)).cast("long") if ranges else F.col("__finish")
        order = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        found = (
            copies.groupBy(at.alias("at"))
            .agg(F.sum("size").alias("sum"), F.max("budget").alias("budget"))
            .withColumn("before", F.coalesce(F.sum("sum").over(order), F.lit(0)) + spent)
            .where("before < budget")
            .agg(F.max_by("before", "at").alias("before"), F.max("at").alias("at"))
            .first()
        )
        if found.at is None:
            return 0.0
        if ranges:
            copies = copies.where(at == found.at)
            finish = (finish - found.at) * FIRST_RANGES
            spent = found.before
    return float(found.at)


def op6_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
s AS (
  SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, encode(source))),
t AS (
  SELECT *, CASE WHEN ratio <= level THEN cap
                 ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT size, budget, (middle + source_size * i) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS i) WHERE size > 0 AND target > 0),
f AS (SELECT finish, sum(size) AS size, max(budget) AS budget FROM c GROUP BY finish),
g AS (SELECT finish, budget, coalesce(sum(size) OVER (ORDER BY finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
x AS (SELECT max(finish) AS cut FROM g WHERE before < budget)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 AND target > 0 THEN
         size * CAST(((middle / target) <= cut)::INT + (((middle + source_size) / target) <= cut)::INT + (((middle + source_size * 2) / target) <= cut)::INT AS BIGINT)
       ELSE 0 END AS taken
FROM q, x
"""
