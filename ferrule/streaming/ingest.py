"""Streams beside the batch engine: documents into the index, events into roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import roll_up
from ..sources.documents import parse_frontmatter, with_defaults
from ..sources.store import IndexStore


def stream_corpus(spark: SparkSession, path: str) -> DataFrame:
    """New markdown files of a folder as corpus rows."""
    rows = (
        spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw_text"))
    )
    return with_defaults(parse_frontmatter(rows.withColumn("name", F.regexp_replace("file_name", r"\.md$", "")).drop("file_name")))


def _plain(path) -> F.Column:
    """A path with one slash behind its scheme: listings and file metadata write it differently."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def missing(index: IndexStore, folder: str) -> DataFrame:
    """(doc_id) of the index whose file is no longer in the folder; files are listed, not read."""
    there = index.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder).select(_plain(F.col("path")).alias("path"))
    held = index.manifest().select("doc_id", _plain(F.col("source_path")).alias("path"))
    return held.join(there, "path", "left_anti").select("doc_id")


def keep_indexed(docs: DataFrame, store: IndexStore, checkpoint: str, folder: str | None = None) -> StreamingQuery:
    """Each micro-batch is merged into the index; documents of earlier batches stay.

    The manifest is the state: a batch that brings nothing new, or is run again after a failure,
    writes no version.  With ``folder``, documents whose file has gone from there leave with it.
    A document that is twice in a batch counts as its last file says.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "source_path").alias("d")).select("d.*")
        store.merge(last.select(*batch.columns), missing(store, folder) if folder and store.exists() else None)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_roll_up(events: DataFrame, ts: str, group: list[str], value: str, width: str, late: str) -> DataFrame:
    """Windowed sums of an event stream; rows later than ``late`` behind the newest are dropped by the watermark."""
    return roll_up(events.withWatermark(ts, late), ts, group, value, width)
