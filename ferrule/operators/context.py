"""From selected evidence to an answer: sufficiency, cited context, extraction, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import citation_ids, is_out_of_domain, sentence_score, split_sentences, tokenize
from .lexical import term_rows
from .plugins import Patience

# Texts that reach the reader.
PERMISSION_ANSWER = "当前权限不足，不能可靠回答这个问题。"
REFUSAL_ANSWER = "资料不足，不能可靠回答这个问题。"
POLICY = ("只能使用本上下文包中的资料回答", "资料不足时必须拒答", "关键事实必须就近引用资料编号")
EXCEPTION_WORDS = "不支持|不能|除非"
PROMPT_QUESTION, PROMPT_EVIDENCE, PROMPT_RULES = "用户问题：", "证据包：", "回答要求："
PROMPT_SYSTEM = "你是严谨的企业知识库 RAG 问答助手，只能基于给定证据回答，并且必须保留引用编号。"
PROMPT_RULE_LINES = (
    "1. 只能基于证据包回答，不要使用外部常识补全。",
    "2. 资料不足时直接说资料不足，不能可靠回答。",
    "3. 每个关键事实后面必须带引用，如 [E1]。",
    "4. 如果证据互相冲突，要说明冲突并分别引用。",
)


def coverage(queries: DataFrame, selected: DataFrame, rrf_only: bool | str = False) -> DataFrame:
    """(query_id, n_selected, best_score, coverage): share of a query's distinct terms that its evidence holds.

    ``selected``: query_id, rerank_score, bm25_rank, terms.  With ``rrf_only`` (for all, or the
    name of a column that says so, which the result keeps) only evidence that the lexical route
    found counts.
    """
    asked = term_rows(queries.select("query_id", F.array_distinct(tokenize("query")).alias("terms")), "query_id")
    ranks = F.coalesce(F.col(rrf_only), F.lit(False)) if isinstance(rrf_only, str) else F.lit(rrf_only)
    held = term_rows(selected.where(~ranks | F.col("bm25_rank").isNotNull()), "query_id").distinct()
    n_terms = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    met = asked.join(held, ["query_id", "term"]).groupBy("query_id").agg(F.count("*").alias("n_met"))
    lexical = F.count_if(F.col("bm25_rank").isNotNull()).alias("n_lexical")
    kept = [F.max(ranks).alias(rrf_only)] if isinstance(rrf_only, str) else []
    best = selected.groupBy("query_id").agg(F.count("*").alias("n_selected"), F.max("rerank_score").alias("best_score"), lexical, *kept)
    rows = queries.select("query_id", "query")
    for part in (n_terms, met, best):
        rows = rows.join(part, "query_id", "left")
    return rows.fillna(0, ["n_terms", "n_met", "n_selected", "n_lexical"]).withColumn(
        "coverage", F.col("n_met") / F.greatest(F.lit(1), F.col("n_terms"))
    )


def sufficiency(covered: DataFrame, blocked: DataFrame | None = None, *, rrf_only: bool | str = False, min_score=0.12, min_coverage=0.18, high_confidence=0.35) -> DataFrame:
    """Adds ``reason`` and ``enough`` to the rows of ``coverage``; the first rule that applies decides.

    ``blocked``: query_id and overlap_ratio of what the asker may not see.
    """
    if blocked is None:
        rows = covered.withColumns({"n_blocked": F.lit(0), "blocked_ratio": F.lit(0.0)})
    else:
        best = blocked.groupBy("query_id").agg(F.count("*").alias("n_blocked"), F.max("overlap_ratio").alias("blocked_ratio"))
        rows = covered.join(best, "query_id", "left").fillna(0, ["n_blocked", "blocked_ratio"])
    share, score = F.col("coverage"), F.coalesce("best_score", F.lit(0.0))
    ranks = F.coalesce(F.col(rrf_only), F.lit(False)) if isinstance(rrf_only, str) else F.lit(rrf_only)
    by_rank = F.when(share >= min_coverage, "pass").when(F.col("n_lexical") == 0, "rrf_only_missing_lexical_signal")
    good = (score >= min_score) & ((share >= min_coverage) | (score >= high_confidence))
    by_policy = F.when(ranks, by_rank.otherwise("low_query_evidence_overlap")).otherwise(F.when(good, "pass").otherwise("low_query_evidence_overlap"))
    reason = (
        F.when(is_out_of_domain("query"), "out_of_domain_query")
        .when((F.col("n_selected") == 0) & (F.col("n_blocked") > 0), "permission_denied")
        .when(F.col("n_selected") == 0, "no_selected_evidence")
        .when((F.col("blocked_ratio") >= 0.45) & (F.col("blocked_ratio") >= share + 0.15), "permission_denied")
        .otherwise(by_policy)
    )
    return rows.withColumn("reason", reason).withColumn("enough", F.col("reason") == "pass")


def evidence(selected: DataFrame, position: str = "position") -> DataFrame:
    """Adds ``citation_id`` and ``evidence_role`` to selected rows (text is the chunk's own)."""
    role = (
        F.when(F.col(position) == 1, "primary").when(F.col("text").rlike(EXCEPTION_WORDS), "exception").otherwise("supporting")
    )
    return selected.withColumns({"citation_id": F.concat(F.lit("E"), F.col(position).cast("string")), "evidence_role": role})


def context_packets(queries: DataFrame, judged: DataFrame, cited: DataFrame) -> DataFrame:
    """One row a query: the query, policy, sufficiency, tokens in all, and the evidence in order."""
    fields = [c for c in (
        "position", "citation_id", "chunk_id", "parent_id", "doc_id", "title_path", "source_path", "version", "effective_from",
        "rerank_score", "mmr_score", "evidence_role", "expanded_ids", "expanded_text",
    ) if c in cited.columns]
    packed = cited.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"), F.sum("expanded_tokens").alias("token_total")
    )
    verdict = judged.select("query_id", F.struct("enough", "reason", "coverage", "best_score").alias("sufficiency"))
    policy = F.array(*[F.lit(p) for p in POLICY])
    rows = queries.select("query_id", "query").join(verdict, "query_id").join(packed, "query_id", "left")
    return rows.withColumns({"policy": policy, "token_total": F.coalesce("token_total", F.lit(0))})


def extractive_answers(queries: DataFrame, judged: DataFrame, cited: DataFrame, max_claims: int = 2) -> DataFrame:
    """(query_id, mode, answer, citations): each piece of evidence's best sentence, the first two; or a refusal."""
    text = F.col("expanded_text") if "expanded_text" in cited.columns else F.col("text")
    asked = queries.select("query_id", "query", F.array_distinct(tokenize("query")).alias("query_terms"))
    rows = cited.select("query_id", "position", "citation_id", F.posexplode_outer(split_sentences(text)).alias("at", "sentence")).where("at IS NOT NULL")
    rows = rows.join(asked, "query_id").withColumn("points", sentence_score("sentence", "query", "query_terms"))
    best = Window.partitionBy("query_id", "position").orderBy(F.desc("points"), "at")
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1 AND points > -1")
    line = Window.partitionBy("query_id").orderBy("position")
    rows = rows.withColumn("n", F.row_number().over(line)).where(F.col("n") <= max_claims)
    claim = F.struct("n", F.concat("sentence", F.lit(" ["), "citation_id", F.lit("]")).alias("claim"), "citation_id")
    claims = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    out = judged.select("query_id", "enough", "reason").join(claims, "query_id", "left")
    found = F.coalesce(F.transform("claims", lambda c: c["claim"]), F.array().cast("array<string>"))
    ids = F.coalesce(F.transform("claims", lambda c: c["citation_id"]), F.array().cast("array<string>"))
    answer = (
        F.when(F.col("enough") & (F.size(found) > 0), F.array_join(found, "\n"))
        .when(F.col("reason") == "permission_denied", PERMISSION_ANSWER)
        .otherwise(REFUSAL_ANSWER)
    )
    return out.select(
        "query_id",
        F.when(F.col("enough"), "extractive").otherwise("refusal").alias("mode"),
        answer.alias("answer"),
        F.when(F.col("enough"), ids).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


def validate_citations(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, used, missing, citation_valid): whether all citations name evidence there is.

    An answer without a list of citations is read for them.
    """
    available = cited.groupBy("query_id").agg(F.collect_set("citation_id").alias("available"))
    rows = answers.join(available, "query_id", "left")
    listed = F.array_sort(F.array_distinct("citations"))
    used = F.when(F.size("citations") > 0, listed).otherwise(citation_ids("answer"))
    missing = F.array_sort(F.array_except(used, F.coalesce("available", F.array().cast("array<string>"))))
    return rows.select("query_id", used.alias("used"), missing.alias("missing"), (F.size(missing) == 0).alias("citation_valid"))


def prompts(packets: DataFrame) -> DataFrame:
    """(query_id, prompt): the question, the evidence and the rules, for a language model."""
    block = lambda e: F.concat_ws(
        "\n",
        F.concat(F.lit("["), e["citation_id"], F.lit("]")),
        F.concat(F.lit("doc_id: "), e["doc_id"].cast("string")),
        F.concat(F.lit("title_path: "), F.array_join(e["title_path"], " > ")),
        F.concat(F.lit("source_path: "), F.coalesce(e["source_path"], F.lit(""))),
        F.concat(F.lit("version: "), F.coalesce(e["version"], F.lit(""))),
        F.concat(F.lit("role: "), e["evidence_role"]),
        F.lit("text:"),
        e["expanded_text"],
    )
    blocks = F.array_join(F.transform(F.coalesce("evidence", F.array().cast(packets.schema["evidence"].dataType)), block), "\n\n---\n\n")
    parts = [F.lit(PROMPT_QUESTION), F.col("query"), F.lit(""), F.lit(PROMPT_EVIDENCE), blocks, F.lit(""), F.lit(PROMPT_RULES)]
    return packets.select("query_id", F.concat_ws("\n\n", *parts, *[F.lit(r) for r in PROMPT_RULE_LINES]).alias("prompt"))


def answer_with(packets: DataFrame, fallback: DataFrame, model=None, patience: Patience = Patience()) -> DataFrame:
    """Answers by ``model(prompt) -> text`` where the context is enough, else the extractive ones.

    The model runs once a row, in batches on the executors; what it fails on for good falls
    back, and rows without enough context never reach it.
    """
    base = fallback.select("query_id", "mode", "answer", "citations")
    if model is None:
        return base.withColumns({"attempts": F.lit(0), "fallback_reason": F.lit("llm_not_configured")})
    asked = packets.where("sufficiency.enough").select("query_id").join(prompts(packets), "query_id")
    id_type = packets.schema["query_id"].dataType.simpleString()

    def call(batches):
        for pdf in batches:
            got = [patience.ask(model, prompt) for prompt in pdf["prompt"]]
            yield pdf[["query_id"]].assign(text=[g.value for g in got], attempts=[g.attempts for g in got])

    told = asked.mapInPandas(call, f"query_id {id_type}, text string, attempts int")
    rows = base.join(told, "query_id", "left")
    good = F.col("text").isNotNull()
    return rows.select(
        "query_id",
        F.when(good, "llm").otherwise(F.col("mode")).alias("mode"),
        F.when(good, F.col("text")).otherwise(F.col("answer")).alias("answer"),
        F.when(good, citation_ids("text")).otherwise(F.col("citations")).alias("citations"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(~good & F.col("attempts").isNotNull(), "llm_error").alias("fallback_reason"),
    )


def numbered_context(results: DataFrame) -> DataFrame:
    """(query_id, context): ranked rows as numbered blocks with source, position and score."""
    head = F.format_string("[%d] source=%s chunk=%d score=%.4f\n%s", "rank", "source", "position", "score", "text")
    blocks = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("block")))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))

