"""Selection of evidence: diversity, truncation, expansion by siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MMR_EXTRA = "mmr_rank int, mmr_score double, max_similarity double, duplicate_of string, dropped boolean"


def mmr(ranked: DataFrame, limit: int = 12, weight: float = 0.72, duplicate: float = 0.92, key: str = "chunk_id") -> DataFrame:
    """Greedy choice of relevant rows that are unlike those chosen; near copies are dropped.

    ``ranked``: query_id, key, rank, rerank_score, vector; a query has a dozen or two
    candidates.  Every candidate comes back with ``mmr_rank`` if chosen, or ``dropped`` and
    ``duplicate_of`` if it is a near copy.  The choice is a fold whose next step hangs on
    all before, so it runs as a grouped function over one small group a query.
    """
    out = f"query_id {ranked.schema['query_id'].dataType.simpleString()}, {key} string, rank int, rerank_score double, {_MMR_EXTRA}"

    def choose(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(group)
        width = max((len(v) for v in group["vector"] if v is not None), default=0)
        x = np.zeros((n, width))
        for i, v in enumerate(group["vector"]):
            if v is not None:
                x[i, : len(v)] = v
        alike = x @ x.T
        score = group["rerank_score"].to_numpy(float)
        top = np.abs(score).max() if n else 0.0
        relevance = score / top if top else np.ones(n)
        place = np.full(n, -1)
        value, near = np.zeros(n), np.zeros(n)
        copy_of: list = [None] * n
        left = list(range(n))
        chosen: list[int] = []
        while left and len(chosen) < limit:
            if chosen:
                to_chosen = alike[np.ix_(left, chosen)]
                near[left] = to_chosen.max(1)
                for i, row in zip(list(left), to_chosen, strict=True):
                    if row.max() >= duplicate:
                        copy_of[i] = group[key][chosen[int(row.argmax())]]
                left = [i for i in left if copy_of[i] is None]
                if not left:
                    break
            gain = weight * relevance[left] - (1 - weight) * (near[left] if chosen else 0.0)
            best = left.pop(int(gain.argmax()))
            value[best] = gain.max()
            place[best] = len(chosen) + 1
            chosen.append(best)
        return pd.DataFrame(
            {
                "query_id": group["query_id"], key: group[key], "rank": group["rank"], "rerank_score": score,
                "mmr_rank": pd.array([p if p > 0 else None for p in place], "Int32"),
                "mmr_score": [v if p > 0 else None for v, p in zip(value, place, strict=True)],
                "max_similarity": near, "duplicate_of": copy_of, "dropped": [c is not None for c in copy_of],
            }
        )

    return ranked.select("query_id", key, "rank", "rerank_score", "vector").groupBy("query_id").applyInPandas(choose, out)


def by_parent(chunks: DataFrame, *more: str) -> DataFrame:
    """(parent_id, siblings): a parent's chunks in order of their ids."""
    member = F.struct("chunk_id", "text", "token_count", *more)
    return chunks.groupBy("parent_id").agg(F.array_sort(F.collect_list(member)).alias("siblings"))


def siblings(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The siblings of each asked parent; an empty array for a parent without chunks."""
    found = parents.select("parent_id").distinct().join(by_parent(chunks), "parent_id", "left")
    return found.withColumn("siblings", F.coalesce("siblings", F.array().cast(found.schema["siblings"].dataType)))


def hydrate(ids: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The stored rows of the asked ids, each once; unknown ids are absent."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi")


def expand(selected: DataFrame, chunks: DataFrame, max_chars: int = 1200, seen=None, of_chunk: tuple[str, ...] = ()) -> DataFrame:
    """Adds expanded_text, expanded_ids and expanded_tokens: the row's text with siblings that still fit.

    Siblings join in order of their ids while the whole stays within ``max_chars``; one that
    does not fit is passed over, and the row itself always stays.  With ``seen``, a test of a
    sibling's columns ``of_chunk``, siblings that fail it are not there.
    """
    asked = chunks.join(selected.select("parent_id").distinct(), "parent_id", "left_semi")
    rows = selected.join(by_parent(asked, *of_chunk), "parent_id", "left")
    if seen is not None:
        own = F.filter("siblings", lambda s: seen(*[s[c] for c in of_chunk]) | (s["chunk_id"] == F.col("chunk_id")))
        rows = rows.withColumn("siblings", F.transform(own, lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["text"].alias("text"), s["token_count"].alias("token_count"))))
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("ids"), empty.alias("texts"), F.lit(0).alias("size"), F.lit(0).alias("tokens"))

    def step(acc, s):
        gap = F.when(F.size(acc["ids"]) > 0, F.lit(2)).otherwise(F.lit(0))
        grown = acc["size"] + gap + F.length(s["text"])
        joins = (s["chunk_id"] == F.col("chunk_id")) | (grown <= max_chars)
        with_it = F.struct(
            F.array_append(acc["ids"], s["chunk_id"]).alias("ids"),
            F.array_append(acc["texts"], s["text"]).alias("texts"),
            grown.alias("size"),
            (acc["tokens"] + s["token_count"]).alias("tokens"),
        )
        return F.when(joins, with_it).otherwise(acc)

    alone = F.array(F.struct("chunk_id", "text", "token_count"))
    folded = F.aggregate(F.coalesce("siblings", alone), state, step)
    return rows.withColumns(
        {"expanded_text": F.array_join(folded["texts"], "\n\n"), "expanded_ids": folded["ids"], "expanded_tokens": folded["tokens"]}
    ).drop("siblings")


def truncate(
    candidates: DataFrame, order: str = "mmr_rank", *, rrf_only: bool | str = False, min_score: float = 0.12, gap: float = 0.28, max_k: int = 5, budget: int = 900
) -> DataFrame:
    """Candidates with ``position`` and ``selected``: minimum score, first large gap, number and token budget.

    ``candidates``: query_id, ``order``, rerank_score, expanded_tokens.  With ``rrf_only`` (for
    all, or the name of a column that says so) scores are ranks in disguise, so neither minimum
    nor gap applies.
    """
    ranks = F.coalesce(F.col(rrf_only), F.lit(False)) if isinstance(rrf_only, str) else F.lit(rrf_only)
    line = Window.partitionBy("query_id").orderBy(order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = candidates.where(ranks | (F.col("rerank_score") >= min_score))
    rows = rows.withColumn("position", F.row_number().over(line))
    wide = ~ranks & F.coalesce(F.lag("rerank_score").over(line) - F.col("rerank_score") >= gap, F.lit(False))
    rows = rows.withColumn("wide", wide)
    rows = rows.withColumn("behind_gap", F.max(F.col("wide").cast("int")).over(upto) > 0).drop("wide")
    rows = rows.withColumn("running_tokens", F.sum("expanded_tokens").over(upto))
    fits = ~F.col("behind_gap") & (F.col("position") <= max_k) & (F.col("running_tokens") <= budget)
    return rows.withColumn("selected", fits).drop("behind_gap")
