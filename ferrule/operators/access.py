"""Access control: scopes and validity as predicates and as one reason column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.text import scope_key, sortable_day, split_values, tokenize
from ..storage import materialise
from .lexical import term_rows

FIRST_DAY, LAST_DAY = 0, 99991231


def with_access_columns(df: DataFrame, scope="permission_scope", start="effective_from", end="effective_to") -> DataFrame:
    """Adds ``scopes`` (array) and ``from_day`` and ``to_day`` (yyyymmdd), derived from text columns."""
    return df.withColumns(
        {"scopes": split_values(F.col(scope)), "from_day": sortable_day(start, FIRST_DAY), "to_day": sortable_day(end, LAST_DAY)}
    )


def effective_scopes(allowed: Iterable[str], config: EngineConfig = EngineConfig()) -> list[str]:
    found = sorted({s for s in allowed if s.strip()})
    return found or (list(config.default_scopes) if config.empty_scopes_mean_default else [])


def scope_allowed(allowed: Iterable[str], scopes: str = "scopes") -> Column:
    """Whether a row's scopes meet the allowed ones; never for rows without scopes."""
    names = list(allowed)
    if not names:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.col(scopes), F.array(*[F.lit(s) for s in names])), F.lit(False))


def is_effective(today: int) -> Column:
    return (F.col("from_day") <= today) & (F.col("to_day") >= today)


def visible(allowed: Iterable[str], today: int) -> Column:
    return scope_allowed(allowed) & is_effective(today)


def permission_blocked(allowed: Iterable[str], today: int) -> Column:
    """In force, but not for these scopes."""
    return is_effective(today) & ~scope_allowed(allowed)


def not_yet_effective(allowed: Iterable[str], today: int) -> Column:
    return scope_allowed(allowed) & (F.col("from_day") > today)


def expired(allowed: Iterable[str], today: int) -> Column:
    return scope_allowed(allowed) & (F.col("to_day") < today)


def reason(allowed: Iterable[str], today: int) -> Column:
    """Why a row is rejected: scope before time, not yet effective before expired; null if visible."""
    return (
        F.when(~scope_allowed(allowed), "permission_scope")
        .when(F.col("from_day") > today, "not_yet_effective")
        .when(F.col("to_day") < today, "expired")
    )


def reason_by_text(allowed: Iterable[str], today: str, start="effective_from", end="effective_to") -> Column:
    """As ``reason``, with dates compared as the strings they are; empty ones bound nothing."""
    later = (F.coalesce(F.col(start), F.lit("")) != "") & (F.col(start) > today)
    past = (F.coalesce(F.col(end), F.lit("")) != "") & (F.col(end) < today)
    return F.when(~scope_allowed(allowed), "permission_scope").when(later, "not_yet_effective").when(past, "expired")


def reason_counts(rows: DataFrame, column: str = "reason") -> DataFrame:
    """One row: visible and rejected by each reason."""
    counted = lambda r: F.count_if(F.col(column).eqNullSafe(F.lit(r)))
    return rows.agg(
        F.count_if(F.col(column).isNull()).alias("visible"),
        counted("permission_scope").alias("permission_scope"),
        counted("not_yet_effective").alias("not_yet_effective"),
        counted("expired").alias("expired"),
    )


def store_split(rows: DataFrame, allowed: Iterable[str], today: int) -> DataFrame:
    """(row, part): visible; blocked whatever its dates; not_yet_effective before expired."""
    why = reason(allowed, today)
    return rows.withColumn("part", F.coalesce(F.when(why == "permission_scope", "blocked").otherwise(why), F.lit("visible")))


def remote_split(rows: DataFrame, allowed: Iterable[str], today: int) -> DataFrame:
    """(row, part) where blocked rows must be in force, and a row that is neither begun nor valid has two parts."""
    allowed = list(allowed)
    parts = F.array_compact(
        F.array(
            F.when(visible(allowed, today), F.lit("visible")),
            F.when(permission_blocked(allowed, today), F.lit("blocked")),
            F.when(not_yet_effective(allowed, today), F.lit("not_yet_effective")),
            F.when(expired(allowed, today), F.lit("expired")),
        )
    )
    return rows.select("*", F.explode(parts).alias("part"))


# ------------------------------------------------------------------ a batch of askers
# Queries may carry ``allowed`` (scopes) and ``as_of`` (yyyymmdd): who asks, and for which day.

#: Places of a day's number, and of a node's level above them.
_DAY_BITS = 27


def with_askers(queries: DataFrame, allowed: Iterable[str], today: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``queries`` with ``allowed`` and ``as_of``: from their columns ``scopes`` and ``as_of`` where these are given.

    A null or blank set of scopes, and a null day, stand for ``allowed`` and ``today``.
    """
    usual = F.array(*[F.lit(s) for s in effective_scopes(allowed, config)]).cast("array<string>")
    day = F.lit(today).cast("int")
    if "scopes" in queries.columns:
        own = F.array_sort(F.array_distinct(F.filter("scopes", lambda s: F.trim(s) != "")))
        given = own if not config.empty_scopes_mean_default else F.when(F.size(own) > 0, own)
        usual = F.coalesce(given, usual)
    if "as_of" in queries.columns:
        kind = queries.schema["as_of"].dataType.simpleString()
        own = F.col("as_of").cast("int") if kind in ("int", "bigint") else F.when(F.col("as_of").isNotNull(), sortable_day(F.col("as_of").cast("string"), today))
        day = F.coalesce(own, day)
    return queries.withColumns({"allowed": usual, "as_of": day})


def scopes_meet(scopes="scopes", allowed="allowed") -> Column:
    """Whether a row's scopes meet its asker's; never for rows or askers without scopes."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.arrays_overlap(column(scopes), column(allowed)), F.lit(False))


def visible_to(scopes="scopes", from_day="from_day", to_day="to_day") -> Column:
    """Whether a row beside its asker's ``allowed`` and ``as_of`` is visible: for what a join by other keys has brought together."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return scopes_meet(scopes) & (column(from_day) <= F.col("as_of")) & (column(to_day) >= F.col("as_of"))


def _node(level: Column, place: Column) -> Column:
    return F.shiftleft(level.cast("long"), _DAY_BITS + 1).bitwiseOR(place.cast("long"))


def days_of_point(day: Column) -> Column:
    """The nodes above a day in a binary tree over all days, the day itself first."""
    half = lambda level: F.floor(day / F.pow(F.lit(2.0), level))
    return F.transform(F.sequence(F.lit(0), F.lit(_DAY_BITS)), lambda level: _node(level, half(level)))


def days_of_span(start: Column, end: Column) -> Column:
    """The fewest nodes that hold the days from ``start`` to ``end`` and no others; none for a span that ends before it starts.

    A day lies in the span just when one of its nodes is one of these, so an equal join on
    nodes is an exact join of days with spans: at most two nodes a level.
    """
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.lit((1 << _DAY_BITS) - 1)) + 1

    def level_nodes(level):
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(lo / size), F.floor(hi / size)
        return F.array_compact(F.array(F.when((a < b) & (a % 2 == 1), _node(level, a)), F.when((a < b) & (b % 2 == 1), _node(level, b - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_DAY_BITS)), level_nodes))


def classes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``access_class``: rows of one class are visible to the same askers."""
    told = F.concat_ws("\x1e", scope_key("scopes"), F.col("from_day"), F.col("to_day"))
    return rows.withColumn("access_class", F.sha2(told, 256))


def grants(askers: DataFrame, kinds: DataFrame) -> DataFrame:
    """(asker, access_class): which classes of rows which askers see.

    ``askers``: asker, allowed, as_of.  ``kinds``: access_class, scopes, from_day, to_day, a
    row each.  Scopes are an inverted index: they meet by equality, together with the nodes
    of days, so no asker is compared with every class.
    """
    who = askers.select("asker", F.explode("allowed").alias("scope"), "as_of").select("asker", "scope", F.explode(days_of_point(F.col("as_of"))).alias("node"))
    what = kinds.select("access_class", F.explode("scopes").alias("scope"), "from_day", "to_day")
    what = what.select("access_class", "scope", F.explode(days_of_span(F.col("from_day"), F.col("to_day"))).alias("node"))
    return who.join(what, ["scope", "node"]).select("asker", "access_class").distinct()


def _askers(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, asker) and (asker, allowed, as_of): queries of one asker and day share a row."""
    named = queries.select("query_id", "allowed", "as_of", F.sha2(F.concat_ws("\x1e", scope_key("allowed"), F.col("as_of")), 256).alias("asker"))
    return named.select("query_id", "asker"), named.select("asker", "allowed", "as_of").dropDuplicates(["asker"])


def visible_pairs(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(query_id, key): the rows that each query's asker sees.

    ``queries``: query_id, allowed, as_of.  ``rows``: key, scopes, from_day, to_day.  Askers and
    rows are classed first, so the join of scopes and days runs over distinct ones.
    """
    asked, askers = _askers(queries)
    held = classes(rows)
    kinds = held.select("access_class", "scopes", "from_day", "to_day").dropDuplicates(["access_class"])
    seen = materialise(grants(askers, kinds), "grants")
    return held.select(key, "access_class").join(seen, "access_class").join(asked, "asker").select("query_id", key)


def counts_by_asker(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, visible, permission_scope, not_yet_effective, expired): how many rows each query's asker sees, and why not the others."""
    asked, askers = _askers(queries)
    kinds = classes(rows).groupBy("access_class").agg(
        F.first("scopes").alias("scopes"), F.first("from_day").alias("from_day"), F.first("to_day").alias("to_day"), F.count("*").alias("n")
    )
    kinds = materialise(kinds, "classes")
    met = askers.select("asker", F.explode("allowed").alias("scope")).join(kinds.select("access_class", F.explode("scopes").alias("scope")), "scope")
    met = met.select("asker", "access_class").distinct().join(kinds, "access_class").join(askers.select("asker", "as_of"), "asker")
    later, past = F.col("from_day") > F.col("as_of"), F.col("to_day") < F.col("as_of")
    total = lambda what: F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0))
    told = met.groupBy("asker").agg(total(~later & ~past).alias("visible"), total(later).alias("not_yet_effective"), total(~later & past).alias("expired"), F.sum("n").alias("allowed_n"))
    every = kinds.agg(F.sum("n")).first()[0] or 0
    out = asked.join(told, "asker", "left").fillna(0, ["visible", "not_yet_effective", "expired", "allowed_n"])
    return out.select("query_id", "visible", (F.lit(every) - F.col("allowed_n")).alias("permission_scope"), "not_yet_effective", "expired")


# ------------------------------------------------------------------ what a query may not see


def blocked_matches(queries: DataFrame, blocked: DataFrame, limit: int = 5) -> DataFrame:
    """The blocked rows that share a query's terms: a quarter of them, or a telling one.

    ``queries``: query_id, query.  ``blocked``: chunk_id, doc_id, terms.  Rows meet over
    their terms, so a query only touches rows that share one.  Where queries carry ``allowed``,
    ``blocked`` holds all rows with their ``scopes``, and each query's own are left out.
    """
    by_asker = ["allowed"] if "allowed" in queries.columns else []
    terms = F.array_distinct(tokenize("query"))
    asked = materialise(queries.select("query_id", terms.alias("asked"), F.size(terms).alias("n_terms"), *by_asker), "asked")
    wanted = term_rows(asked, "query_id", "n_terms", *by_asker, terms="asked")
    held = term_rows(blocked.withColumn("terms", F.array_distinct("terms")), "chunk_id", "doc_id", *(["scopes"] if by_asker else []))
    telling = F.col("term").rlike(r"\d|[-_/]") | (F.length("term") >= 4)
    met = wanted.join(held, "term")
    if by_asker:
        met = met.where(~scopes_meet())
    met = met.groupBy("query_id", "chunk_id", "doc_id").agg(
        F.count("*").alias("n_matched"), F.max(telling).alias("telling"), F.first("n_terms").alias("n_terms")
    )
    met = met.where((F.col("n_matched") / F.col("n_terms") >= 0.25) | F.col("telling"))
    met = met.withColumn("overlap_ratio", F.round(F.col("n_matched") / F.col("n_terms"), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap_ratio"), F.desc("n_matched"), "doc_id", "chunk_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("telling", "n_terms")
    best = materialise(best, "blocked")  # the terms that matched are looked up for these few only
    texts = blocked.join(best.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "terms")
    found = best.join(texts, "chunk_id").join(asked.select("query_id", "asked"), "query_id")
    return found.withColumn("matched_terms", F.array_sort(F.array_intersect("asked", "terms"))).drop("asked", "terms")
