"""What several operators share: tables and bounded slices of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import discard, materialise, shared_dir, spread

__all__ = ["discard", "map_texts", "materialise", "shared_dir", "slices", "table"]

#: A slice of texts handed to a numpy kernel holds about this many bytes (one text at least).
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; a small one is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to about ``limit``; each holds one item at least."""
    start = total = 0
    end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def map_texts(
    df: DataFrame,
    column: str,
    make: Callable[[list], dict[str, list]],
    added: list[tuple[str, T.DataType]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from the texts of ``column``, a bounded slice at a time.

    ``make`` gets the texts of a slice (None for null) and returns a list for each
    added column.  ``keep`` names the columns passed on (all by default); columns of
    the input with the name of an added one are left out.
    """
    names = {n for n, _ in added}
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    free = "__text"
    while free in passed:
        free += "_"
    source = df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{column}`").cast("string").alias(free))
    schema = T.StructType([source.schema[c] for c in passed] + [T.StructField(n, t) for n, t in added])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(passed))
            lengths = pc.binary_length(texts).fill_null(0).to_pylist()
            for lo, hi in slices(lengths):
                part = batch.slice(lo, hi - lo)
                made = make(part.column(len(passed)).to_pylist())
                arrays = [part.column(i).cast(kinds.field(i).type) for i in range(len(passed))]
                arrays += [pa.array(made[n], kinds.field(len(passed) + i).type) for i, (n, _) in enumerate(added)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return source.mapInArrow(run, schema)
