"""Support cases rendered as markdown documents, a fixed number of cases each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, slugify, strip
from ..storage import materialise

FIELDS = ("issue_area", "issue_category", "issue_sub_category", "product_category", "product_sub_category", "issue_complexity", "conversation")

# Wording of the rendered documents.
LABELS = ("Issue area", "Issue category", "Issue sub-category", "Product category", "Product sub-category", "Issue complexity")
NO_QA = "- No normalized QA item was provided; use the conversation transcript as source evidence."
NOTES = (
    "This case should be indexed as support knowledge. Keep the issue taxonomy in metadata-aware payload fields, use the normalized"
    " question for recall tests, and keep the conversation as supporting evidence for citation checks. If a generated answer uses this"
    " case, it should cite the case section rather than inventing a policy."
)
INTRO = (
    "This document is generated from an open e-commerce customer support QA dataset. It is intentionally longer than a toy policy file so"
    " retrieval, BM25, RRF, rerank, deduplication, dynamic truncation, citation validation, and monitoring traces have enough evidence to"
    " operate on."
)
FRONTMATTER = (
    ("business_domain", "customer_support"), ("doc_type", "open_dataset_casebook"), ("version", "dataset_sample_v1"),
    ("effective_from", "2026-06-01"), ("effective_to", ""), ("permission_scope", "internal"), ("owner", "support_ops_team"),
)
TITLE, ID_PREFIX, DEFAULT_AREA, ORIGINAL_QA = "BrownBox Customer Support Cases", "brownbox_support", "Customer Support", "Original QA"

_ITEM = "struct<customer_summary_question:string,agent_summary_solution:string>"


def qa_items(raw: Column) -> Column:
    """Questions and solutions of a JSON text; text that is no JSON is one item by itself."""
    parsed = F.from_json(raw, f"struct<knowledge:array<{_ITEM}>>")["knowledge"]
    stripped = F.transform(
        F.filter(parsed, lambda i: i.isNotNull()),
        lambda i: F.struct(
            strip(F.coalesce(i["customer_summary_question"], F.lit(""))).alias("customer_summary_question"),
            strip(F.coalesce(i["agent_summary_solution"], F.lit(""))).alias("agent_summary_solution"),
        ),
    )
    none = F.array().cast(f"array<{_ITEM}>")
    whole = F.array(F.struct(F.lit(ORIGINAL_QA).alias("customer_summary_question"), raw.alias("agent_summary_solution")))
    blank = F.coalesce(strip(raw), F.lit("")) == ""
    return F.when(blank, none).when(F.try_parse_json(raw).isNull(), whole).otherwise(F.coalesce(stripped, none))


def render_case(number: Column) -> Column:
    """A case as markdown, from columns named in ``FIELDS`` and ``qa``."""
    clean = {f: clean_text(f) for f in FIELDS}
    present = lambda f: F.when(clean[f] != "", clean[f])
    heading = F.coalesce(present("issue_sub_category"), present("issue_category"), clean["issue_area"])
    lines = F.flatten(
        F.transform(
            qa_items(F.col("qa")),
            lambda item, i: F.filter(
                F.array(
                    F.when(
                        clean_text(item["customer_summary_question"]) != "",
                        F.concat(F.lit("- Q"), (i + 1).cast("string"), F.lit(": "), clean_text(item["customer_summary_question"])),
                    ),
                    F.when(
                        clean_text(item["agent_summary_solution"]) != "",
                        F.concat(F.lit("  Resolution: "), clean_text(item["agent_summary_solution"])),
                    ),
                ),
                lambda line: line.isNotNull(),
            ),
        )
    )
    facts = [F.concat(F.lit(f"- {label}: "), clean[f]) for label, f in zip(LABELS, FIELDS, strict=False)]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## Case "), number.cast("string"), F.lit(": "), heading), F.lit(""), *facts, F.lit(""),
        F.lit("### Normalized knowledge"), F.lit(""), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_QA), F.lit(""),
        F.lit("### Source conversation"), F.lit(""), clean["conversation"], F.lit(""), F.lit("### RAG notes"), F.lit(""), F.lit(NOTES),
    )


def render_documents(rows: DataFrame, order: str, rows_per_doc: int = 12, dataset: str = "", licence: str = "MIT") -> DataFrame:
    """(filename, doc_id, title, content): every ``rows_per_doc`` rows in order make a document, the last may be short.

    ``order`` counts the rows from 0 without gaps, so a row's document is known without a
    sort over all rows; rows of one document meet in one small group.
    """
    at = F.floor(F.col(order) / rows_per_doc).cast("long")
    placed = rows.withColumns({"doc_no": at + 1, "case_no": (F.col(order) % rows_per_doc + 1).cast("int")})
    area = F.when(clean_text("issue_area") != "", clean_text("issue_area")).otherwise(DEFAULT_AREA)
    cases = placed.select("doc_no", "case_no", area.alias("area"), render_case(F.col("case_no")).alias("case"))
    docs = cases.groupBy("doc_no").agg(F.min_by("area", "case_no").alias("area"), F.array_sort(F.collect_list(F.struct("case_no", "case"))).alias("cases"))
    number = F.format_string("%03d", "doc_no")
    doc_id = F.concat(F.lit(f"{ID_PREFIX}_"), number, F.lit("_"), slugify("area"))
    title = F.concat(F.lit(f"{TITLE} "), number, F.lit(": "), F.col("area"))
    head = [F.lit("---"), F.concat(F.lit("doc_id: "), doc_id), F.concat(F.lit("title: "), title)]
    head += [F.lit(f"{k}: {v}") for k, v in (*FRONTMATTER, ("dataset_source", dataset), ("dataset_license", licence))]
    body = F.array_join(F.transform("cases", lambda c: c["case"]), "\n")
    content = F.concat_ws("\n", *head, F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.lit(INTRO), F.lit(""), body, F.lit(""))
    return docs.select(F.concat(doc_id, F.lit(".md")).alias("filename"), doc_id.alias("doc_id"), title.alias("title"), content.alias("content"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``row_no`` from 0 in order, by counting ordered partitions instead of one sort in one task.

    The partitions are written once with their numbers: dealt a second time, for their sizes
    alone, Spark may cut them elsewhere.
    """
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "numbered")
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").withColumn("row_no", F.col("__offset") + F.col("__at")).drop("__part", "__at", "__offset")
