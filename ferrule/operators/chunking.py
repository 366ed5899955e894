"""Documents to sections to overlapping chunks, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip, token_count, tokenize

_SENTENCE_END = "(?<=[。！？!?])"


def split_sections(docs: DataFrame, doc_id="doc_id", title="title", body="body", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, section_no, parent_id, section_title, title_path, text, carry): a section a ``## `` heading.

    What stands before the first heading is a section under the document's title.  Sections
    are cut inside the row, so nothing is shuffled.
    """
    name = F.coalesce(F.col(title).cast("string"), F.col(doc_id).cast("string"))
    rows = docs.where(F.col(body) != "").select(
        F.col(doc_id).alias("doc_id"), name.alias("title"), F.posexplode_outer(F.split(F.col(body), r"\n(?=## )")).alias("section_no", "piece"), *carry
    )  # outer: an inner explode would split every body a second time to test its size
    heading = strip(F.regexp_extract("piece", r"^## ([^\n]*)", 1))
    section = F.when(F.col("piece").startswith("## "), heading).otherwise(F.col("title"))
    return rows.select(
        "doc_id",
        "section_no",
        F.format_string("%s:sec_%02d", F.col("doc_id").cast("string"), F.col("section_no")).alias("parent_id"),
        section.alias("section_title"),
        F.array("title", section).alias("title_path"),
        normalize_text("piece").alias("text"),
        *carry,
    )


def pack(pieces: Column, chars: int, overlap: int) -> Column:
    """Greedy packing of paragraphs into chunks of about ``chars``, each begun with the tail of the last.

    The open chunk grows while it fits; a paragraph that does not fit closes it.  A first
    paragraph that is too long by itself is cut once, and its rest stays open.
    """
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc, piece):
        joined = F.when(acc["open"] != "", strip(F.concat(acc["open"], F.lit("\n\n"), piece))).otherwise(piece)
        tail = F.substring(acc["open"], -overlap, overlap)
        return (
            F.when(F.length(joined) <= chars, F.struct(joined.alias("open"), acc["done"].alias("done")))
            .when(
                acc["open"] != "",
                F.struct(
                    strip(F.concat(F.when(F.length(acc["open"]) <= overlap, acc["open"]).otherwise(tail), F.lit("\n\n"), piece)).alias("open"),
                    F.array_append(acc["done"], acc["open"]).alias("done"),
                ),
            )
            .otherwise(
                F.struct(
                    F.substr(piece, F.lit(chars - overlap + 1)).alias("open"),
                    F.array_append(acc["done"], F.substring(piece, 1, chars)).alias("done"),
                )
            )
        )

    finish = lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
    return F.aggregate(pieces, state, step, finish)


def paragraphs(text: Column, delimiter: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, delimiter), strip), lambda p: p != "")


def sentence_pack(paragraph: Column, chars: int) -> Column:
    """Sentences of a long paragraph, run together while they fit; a long sentence stays whole."""
    pieces = F.filter(F.transform(F.split(paragraph, _SENTENCE_END), strip), lambda s: s != "")
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc, piece):
        fits = F.length(acc["open"]) + F.length(piece) <= chars
        closed = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        return F.when(fits, F.struct(F.concat(acc["open"], piece).alias("open"), acc["done"].alias("done"))).otherwise(
            F.struct(piece.alias("open"), closed.alias("done"))
        )

    finish = lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
    packed = F.aggregate(pieces, state, step, finish)
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(F.substring(paragraph, 1, chars)))


def plain_chunks(docs: DataFrame, source: str, text: str, chars: int = 240, overlap: int = 60, delimiter="\n\n") -> DataFrame:
    """(chunk_id, source, position, text) of whole documents; long paragraphs are packed by sentence first."""
    found = paragraphs(F.col(text), delimiter)
    spread = F.flatten(F.transform(found, lambda p: F.when(F.length(p) > chars, sentence_pack(p, chars)).otherwise(F.array(p))))
    rows = docs.select(F.col(source).cast("string").alias("source"), F.posexplode_outer(pack(spread, chars, overlap)).alias("position", "text"))
    rows = rows.where("position IS NOT NULL")
    return rows.select(F.concat("source", F.lit("#chunk-"), F.col("position")).alias("chunk_id"), "source", "position", "text")


def section_chunks(sections: DataFrame, chars: int = 280, overlap: int = 60, delimiter="\n\n", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, parent_id, doc_id, chunk_no, title_path, text, token_count, terms, carry) of sections."""
    rows = sections.select(
        "doc_id", "parent_id", "title_path", F.posexplode_outer(pack(paragraphs(F.col("text"), delimiter), chars, overlap)).alias("chunk_no", "text"), *carry
    ).where("chunk_no IS NOT NULL")
    titled = F.concat(F.array_join("title_path", " "), F.lit(" "), F.col("text"))
    return rows.select(
        F.format_string("%s:chunk_%02d", "parent_id", "chunk_no").alias("chunk_id"),
        "parent_id", "doc_id", "chunk_no", "title_path", "text",
        token_count("text").alias("token_count"), tokenize(titled).alias("terms"), *carry,
    )

