"""The engine's text, access and chunking rules as SQL functions of a session.

``register(spark)`` makes temporary SQL functions, which Catalyst replaces by their bodies: a
query that calls them is planned as one that spells the rule out, with pushed filters and
generated code.  Table functions stand in a ``LATERAL`` join and split inside the row; their
arguments are columns or built-in functions of columns.

    SELECT d.doc_id, c.chunk_no, c.chunk
    FROM documents d, LATERAL chunks_of(d.text, 280, 60, '\\n') c
    WHERE visible_to(d.permission_scope, d.effective_from, d.effective_to, array('public'), 20260607)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import STOPWORDS

_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)


def _strip(x: str) -> str:
    """For the inside of a lambda, where a function made in SQL cannot be called."""
    return f"regexp_replace({x}, r'(?U)^\\s+|\\s+$', '')"


_JOINED = f"if(acc.open <> '', {_strip("concat(acc.open, '\\n\\n', piece)")}, piece)"



def _packed(pieces: str) -> str:
    return f"""aggregate({pieces}, named_struct('open', '', 'done', CAST(array() AS ARRAY<STRING>)),
              (acc, piece) -> CASE WHEN length({_JOINED}) <= chars THEN named_struct('open', {_JOINED}, 'done', acc.done)
                WHEN acc.open <> '' THEN named_struct('open', {_strip("concat(if(length(acc.open) <= overlap, acc.open, substring(acc.open, -overlap, overlap)), '\\n\\n', piece)")}, 'done', array_append(acc.done, acc.open))
                ELSE named_struct('open', substring(piece, chars - overlap + 1), 'done', array_append(acc.done, substring(piece, 1, chars))) END,
              acc -> if(acc.open <> '', array_append(acc.done, acc.open), acc.done))"""


#: Name and parameters, result, and body of each function.  A body may call the functions before it.
FUNCTIONS = (
    ("strip_text(x STRING)", "STRING", _strip("x")),
    ("normalized_text(x STRING)", "STRING", r"strip_text(regexp_replace(regexp_replace(x, '\r\n?', '\n'), '\n{3,}', '\n\n'))"),
    ("token_count(x STRING)", "INT", "CAST(greatest(1, floor(length(x) / 2)) AS INT)"),
    ("split_scopes(x STRING)", "ARRAY<STRING>", r"array_distinct(filter(split(coalesce(x, ''), r'(?U)[,，;；\s]+'), v -> v <> ''))"),
    (
        "sortable_day(x STRING, otherwise INT)", "INT",
        "CASE WHEN length(regexp_replace(coalesce(x, ''), '[^0-9]', '')) >= 8 THEN CAST(substring(regexp_replace(x, '[^0-9]', ''), 1, 8) AS INT) ELSE otherwise END",
    ),
    ("scope_allowed(scopes ARRAY<STRING>, allowed ARRAY<STRING>)", "BOOLEAN", "coalesce(arrays_overlap(scopes, allowed), false)"),
    (
        "access_reason(scope STRING, valid_from STRING, valid_to STRING, allowed ARRAY<STRING>, as_of INT)", "STRING",
        "CASE WHEN NOT scope_allowed(split_scopes(scope), allowed) THEN 'permission_scope' WHEN sortable_day(valid_from, 0) > as_of THEN 'not_yet_effective'"
        " WHEN sortable_day(valid_to, 99991231) < as_of THEN 'expired' END",
    ),
    ("visible_to(scope STRING, valid_from STRING, valid_to STRING, allowed ARRAY<STRING>, as_of INT)", "BOOLEAN", "access_reason(scope, valid_from, valid_to, allowed, as_of) IS NULL"),
    (
        "terms_of(x STRING)", "ARRAY<STRING>",
        r"""CASE WHEN x RLIKE r'[\x{4e00}-\x{9fff}]' THEN flatten(transform(
              filter(regexp_extract_all(lower(x), r'([a-z0-9_/\-]+|[\x{4e00}-\x{9fff}]{2,})', 1), t -> t NOT IN ("""
        + _WORDS
        + r""")),
              t -> CASE WHEN t RLIKE r'^[\x{4e00}-\x{9fff}]{4,}$' THEN concat(array(t), transform(sequence(1, length(t) - 1), i -> substring(t, i, 2))) ELSE array(t) END))
            ELSE regexp_extract_all(lower(x), r'([a-z0-9_/\-]+|[\x{4e00}-\x{9fff}]{2,})', 1) END""",
    ),
    (
        "packed(pieces ARRAY<STRING>, chars INT, overlap INT)", "ARRAY<STRING>",
        _packed("pieces"),
    ),
)

#: Name and parameters, columns, and query of each table function.
TABLE_FUNCTIONS = (
    (
        "sections_of(x STRING)", "section_no INT, section STRING",
        r"SELECT pos, col FROM posexplode(CASE WHEN x <> '' THEN split(x, r'\n(?=## )') END)",
    ),
    (
        "chunks_of(x STRING, chars INT, overlap INT, delimiter STRING)", "chunk_no INT, chunk STRING",
        f"SELECT pos, col FROM posexplode({_packed(f"filter(transform(split(x, delimiter), p -> {_strip('p')}), p -> p <> '')")})",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions in the session, or make them anew; their names."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, columns, query in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {query}")
    return [head.partition("(")[0] for head, *_ in (*FUNCTIONS, *TABLE_FUNCTIONS)]
