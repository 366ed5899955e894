"""From raw documents to a training mix: each stage's decisions take effect on the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read
again before the next stage runs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontaminate, language, mix, neardup, pii
from ferrule.llm.common import discard, materialise, table


def _packed(docs: DataFrame) -> DataFrame:
    """``text`` and what a stage reads, with the other columns in a struct no added column can clash with."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row")
    return docs.select(row, "text", *[c for c in ("doc_id", "lang") if c in others])


def _unpacked(rows: DataFrame, columns: list[str], text=None) -> DataFrame:
    """The columns of documents again, in their order."""
    text = F.col("text") if text is None else text
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and texts that are in none of the languages learned.

    A null text has no letter and goes; short and ambiguous texts stay; rows that repeat an id
    are judged one by one; an empty table stays empty.
    """
    found = language.identify(_packed(docs), language.train(docs), keep=["__row", "text"])
    return _unpacked(found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("foreign")), docs.columns)


def _one_row_a_copy(docs: DataFrame) -> DataFrame:
    """One row of each id and text; rows without an id go where a row with one has their text, else one a text stays.  Null texts stay."""
    digest = F.unhex(F.sha2("text", 256))
    seen = materialise(docs.where("text IS NOT NULL").groupBy(F.col("doc_id").alias("__id"), digest.alias("__digest")).agg(F.count("*").alias("__n")), "copies")
    more = seen.where("__n > 1 OR __id IS NULL")
    if more.isEmpty():
        discard(seen)
        return docs
    named = seen.where("__id IS NOT NULL").select("__digest").distinct().withColumn("__named", F.lit(True))
    more = more.join(named, "__digest", "left").withColumn("__held", F.col("__id").isNull() & F.col("__named").isNotNull()).where("__held OR __n > 1")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__doc"), digest.alias("__text"))
    rows = rows.join(more, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left")
    single = rows.where("__digest IS NULL").select("__row")
    one = rows.where("NOT __held").groupBy("__id", "__digest").agg(F.min("__row").alias("__row")).select("__row")
    out = materialise(single.unionByName(one).select("__row.*"), "copies")
    discard(seen)
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, one row of it; rows without an id stay, one a text that no document has."""
    docs = _one_row_a_copy(docs)
    dropped = neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    dropped = materialise(dropped, "dropped")  # of a known size: a short list does not shuffle the documents
    return docs.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat an id are judged one by one; an
    empty table, or an empty benchmark, takes nothing away.
    """
    found = decontaminate.find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["__row", "text"])
    return _unpacked(found.where(decontaminate.n_hit() == 0), docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text.

    Every row stays; a null text stays null, and its ``n_chars`` is null.
    """
    found = pii.scan(_packed(docs), keep=["__row"], redacted=True)
    out = _unpacked(found, docs.columns, F.col("redacted_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document that takes part, with the words it gives, repeats counted.

    Texts without words give none and take no part; a null source is a source of its own; rows
    that repeat an id take part one by one; an empty table gives an empty mix.
    """
    return mix.mix(docs, keep=("doc_id", "source")).where("taken > 0")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the tagger cannot be written in SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
