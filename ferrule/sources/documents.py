"""Sources: markdown folders, frontmatter, casebook rows, evaluation sets, stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip

EVAL_SCHEMA = "case_id string, query string, expected_doc_id string, must_answer string, expected_terms string"
CASE_SCHEMA = ", ".join(
    f"{c} string" for c in ("issue_area", "issue_category", "issue_sub_category", "product_category", "product_sub_category", "issue_complexity", "conversation", "qa")
)


def relative_to(path: Column, base: str) -> Column:
    """A path below ``base`` without it; any other path as it is."""
    root = base.rstrip("/") + "/"
    bare = F.regexp_replace(path, "^file:(//)?(?=/)", "")
    return F.when(bare.startswith(root), F.substr(bare, F.lit(len(root) + 1))).otherwise(bare)


def read_markdown(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """(source_path, name, raw_text): a row a ``*.md`` file of the folder, not of folders in it."""
    rows = (
        spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw_text"))
    )
    rows = rows.select("source_path", F.regexp_replace("file_name", r"\.md$", "").alias("name"), "raw_text")
    if required and rows.isEmpty():
        raise FileNotFoundError(f"no markdown files in {path}")
    return rows


def parse_frontmatter(docs: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Adds ``metadata`` (map) and ``body``: the ``key: value`` lines between two ``---`` lines at the very start.

    A later line of the same key wins; lines without a colon are passed over; a text
    without a closed block is body as a whole.
    """
    text = F.col(raw)
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    closed = F.regexp_like(text, F.lit(r"(?s)\A---\n.*?\n---")) & (block != "")
    pairs = F.transform(
        F.filter(F.split(block, "\n"), lambda line: line.contains(":")),
        lambda line: F.struct(
            F.trim(F.regexp_extract(line, "^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value")
        ),
    )
    later = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"])
    metadata = F.map_from_entries(F.filter(pairs, later))
    empty = F.create_map().cast("map<string,string>")
    rest = strip(F.regexp_replace(text, r"(?s)\A---\n.*?\n---", ""))
    return docs.withColumns(
        {"metadata": F.when(closed, metadata).otherwise(empty), "body": F.when(closed, rest).otherwise(text)}
    )


def with_defaults(docs: DataFrame) -> DataFrame:
    """Columns of a corpus row; a default stands in only where a key is absent, not where it is blank."""
    get = lambda key, default: F.coalesce(F.try_element_at("metadata", F.lit(key)), default)
    return docs.select(
        get("doc_id", F.col("name")).alias("doc_id"),
        get("title", F.col("name")).alias("title"),
        get("source_path", F.col("source_path")).alias("source_path"),
        get("permission_scope", F.lit("internal")).alias("permission_scope"),
        get("effective_from", F.lit("")).alias("effective_from"),
        get("effective_to", F.lit("")).alias("effective_to"),
        get("version", F.lit("")).alias("version"),
        "metadata",
        "raw_text",
        "body",
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(parse_frontmatter(read_markdown(spark, path)))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of a markdown folder, normalised; an empty folder is an error."""
    return read_markdown(spark, path, required=True).select(F.concat("name", F.lit(".md")).alias("source"), normalize_text("raw_text").alias("text"))


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a CSV file; quoted values may hold commas, doubled quotes and line feeds."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(EVAL_SCHEMA).csv(path)


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Dataset rows from JSON lines or Parquet; ``limit`` is the import's own parameter."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(CASE_SCHEMA).json(path)
    return rows if limit is None else rows.limit(limit)


def read_index(spark: SparkSession, path: str, embedding_model: str) -> DataFrame | None:
    """Stored chunks of an embedding model; None where there are none."""
    rows = spark.read.parquet(path).where(F.col("embedding_model") == embedding_model)
    return None if rows.isEmpty() else rows

