"""Command line: ask, eval, index, import.

``python -m ferrule.cli ask --index DIR --docs DIR --query TEXT``
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import services
from .config import EngineConfig
from .operators import casebook, reports
from .operators.context import PROMPT_SYSTEM
from .plans.engine import Answered, HybridEngine
from .sources import documents, remote, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ferrule", description=__doc__)
    tasks = out.add_subparsers(dest="task", required=True)
    for name, text in (("ask", "answer a question"), ("eval", "run an evaluation set"), ("index", "bring the index in line with the documents")):
        task = tasks.add_parser(name, help=text)
        task.add_argument("--index", required=True)
        task.add_argument("--docs", required=name == "index", help="markdown folder to index")
        task.add_argument("--rebuild-index", action="store_true")
        task.add_argument("--embedder-url", help="service that embeds; its key is in FERRULE_EMBEDDER_KEY")
        task.add_argument("--embedder-model", default="")
        task.add_argument("--dimensions", type=int, default=EngineConfig.dimensions)
        if name != "index":
            task.add_argument("--scopes", default="internal,public", help="scopes of the asker, separated by commas")
            task.add_argument("--today", type=int, help="day of the access checks, yyyymmdd; this day by default")
            task.add_argument("--blocked-hint", action="store_true")
            task.add_argument("--reranker-url")
            task.add_argument("--reranker-model", default="")
            task.add_argument("--chat-url", help="language model; its key is in FERRULE_CHAT_KEY")
            task.add_argument("--chat-model", default="")
            task.add_argument("--events", help="folder that monitoring events are appended to")
            task.add_argument("--traces", help="folder that traces are appended to")
    tasks.choices["ask"].add_argument("--query", required=True)
    tasks.choices["ask"].add_argument("--trace-only", action="store_true", help="print the trace in place of the answer")
    tasks.choices["eval"].add_argument("--cases", required=True, help="CSV file of cases")
    cases = tasks.add_parser("import", help="write dataset rows as markdown documents")
    cases.add_argument("--output-dir", required=True)
    cases.add_argument("--path", help="local copy of the rows")
    cases.add_argument("--url", default="", help="REST rows, where there is no local copy")
    cases.add_argument("--dataset", default="")
    cases.add_argument("--limit", type=int, default=remote.LIMIT)
    cases.add_argument("--rows-per-doc", type=int, default=12)
    return out


def _index(spark: SparkSession, args, config: EngineConfig, embedder) -> store.IndexStore:
    found = store.IndexStore.of_identity(spark, args.index, config, embedder=embedder)
    if args.docs and (args.rebuild_index or not found.exists()):
        found.sync(documents.read_corpus(spark, args.docs), rebuild=args.rebuild_index)
    return found


def _models(args) -> tuple[EngineConfig, dict]:
    """The configuration and the services that the arguments name."""
    told, made = vars(args), {}
    config = EngineConfig(dimensions=args.dimensions)
    if args.embedder_url:
        config = EngineConfig(dimensions=args.dimensions, embedding_provider="http", embedding_model=args.embedder_model)
        made["embedder"] = services.HttpEmbedder(args.embedder_url, args.embedder_model, os.environ.get("FERRULE_EMBEDDER_KEY", ""), args.dimensions)
    if told.get("reranker_url"):
        made["reranker"] = services.HttpReranker(args.reranker_url, args.reranker_model)
    if told.get("chat_url"):
        made["llm"] = services.HttpChat(args.chat_url, args.chat_model, os.environ.get("FERRULE_CHAT_KEY", ""), PROMPT_SYSTEM)
    return config, made


def _answered(spark: SparkSession, args, queries: DataFrame) -> Answered:
    config, made = _models(args)
    index = _index(spark, args, config, made.get("embedder"))
    model = args.reranker_model if args.reranker_url else ""
    scopes = {s.strip() for s in args.scopes.replace(";", ",").split(",") if s.strip()}
    done = HybridEngine(index, config, model_name=model, **made).run(queries, scopes, args.today, args.blocked_hint)
    for folder, rows in ((args.events, done.events), (args.traces, done.traces)):
        if folder:
            store.append_json(rows, folder)
    return done


def printed(row) -> str:
    """An answer as a reader sees it."""
    lines = [row.answer, "", f"mode: {row.mode}   sufficiency: {row.reason}   citations valid: {row.citation_valid}"]
    lines += [f"[{e.citation_id}] {e.doc_id} {' > '.join(e.title_path)} ({e.evidence_role})" for e in row.evidence or ()]
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ferrule").getOrCreate()
    if args.task == "import":
        rows = remote.read_dataset(spark, args.path, args.url, args.limit, **({"dataset": args.dataset, "config": "default", "split": "train"} if args.dataset else {}))
        docs = casebook.render_documents(casebook.numbered(rows.withColumn("place", F.monotonically_increasing_id()), "place"), "row_no", args.rows_per_doc)
        store.write_markdown(docs, args.output_dir)
        print(f"wrote markdown documents to {args.output_dir}")
        return 0
    if args.task == "index":
        config, made = _models(args)
        index = store.IndexStore.of_identity(spark, args.index, config, embedder=made.get("embedder"))
        done = index.sync(documents.read_corpus(spark, args.docs), rebuild=args.rebuild_index)
        print(f"{index.path}: {done.added} added, {done.changed} changed, {done.removed} removed, {index.count()} chunks")
        return 0
    if args.task == "ask":
        done = _answered(spark, args, spark.createDataFrame([("q", args.query)], "query_id string, query string"))
        row = done.traces.first()
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str) if args.trace_only else printed(row))
        done.release()
        return 0
    cases = documents.read_eval(spark, args.cases).withColumnRenamed("case_id", "query_id")
    done = _answered(spark, args, cases.select("query_id", "query"))
    told = cases.selectExpr("query_id AS case_id", "query_id", "expected_doc_id", "must_answer", "expected_terms")
    rows = reports.evaluate(told, done.answers, done.selected).join(cases.select("query_id", "query"), "query_id").orderBy("case_id").collect()  # an evaluation set is read by people
    for r in rows:
        print("PASS" if r.passed else "FAIL", r.case_id, r["query"])
    print(f"{sum(r.passed for r in rows)}/{len(rows)} passed")
    done.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
