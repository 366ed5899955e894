"""Tables written between steps, on storage that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table a core is worth dealing rows out for: a smaller table lies in fewer splits than there are cores.
SPLIT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary folder, once, and
    remembers it in its own configuration; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ferrule.shared.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        found = f"file://{tempfile.mkdtemp(prefix='ferrule-')}"
        spark.conf.set("ferrule.shared.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def discard(df: DataFrame) -> None:
    """Delete the files that ``materialise`` wrote for ``df``."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in name:
            remove(spark, name)


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt out to all cores; a table of many splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
