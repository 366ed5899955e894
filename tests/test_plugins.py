"""Plug-in models, their fallbacks, and the sinks beside the store."""

import pytest
from pyspark.sql import functions as F

from ferrule.config import EngineConfig
from ferrule.operators import context, fusion, plugins, reports
from ferrule.plans.engine import HybridEngine
from ferrule.sources import documents, store


def corpus(spark):
    raw = [(f"f{i}", f"d{i}", f"# D{i}\n\n{t}\n") for i, t in enumerate(["refund takes days", "shipping is slow", "points expire"])]
    return documents.with_defaults(documents.parse_frontmatter(spark.createDataFrame(raw, "source_path string, name string, raw_text string")))


def by_length(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_embedder_and_fallback(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bcd"), (3, None)], "key long, text string")
    vectors, status = plugins.embed_or_hash(spark, rows, "key", "text", by_length, 2)
    assert {r.key: r.vector for r in vectors.collect()} == {1: [1.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}
    assert status.first().mode == "external"

    def broken(_):
        raise OSError("down")

    vectors, status = plugins.embed_or_hash(spark, rows, "key", "text", broken, 16)
    assert vectors.count() == 3 and (status.first().fallback_used, status.first().attempts, status.first().error) == (True, 3, "down")
    assert [r.component for r in reports.fallbacks(status).collect()] == ["embedding"]
    assert plugins.embed_or_hash(spark, rows, "key", "text", None, 16)[1].first().configured is False


def test_engine_with_embedder(spark):
    chunks = store.build_chunks(corpus(spark))
    queries = spark.createDataFrame([("q", "refund days")], "query_id string, query string")
    done = HybridEngine(chunks, EngineConfig(dimensions=2, lexical="plain"), embedder=by_length).run(queries)
    assert "refund" in done.answers.first().answer and done.fused.where("dense_rank IS NOT NULL").count() == 3


def test_patience():
    calls, swift = [], plugins.Patience(pause_s=0)

    def third_time():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "yes"

    assert swift.ask(third_time) == plugins.Outcome("yes", None, 3)
    assert swift.ask(lambda: 1 / 0) == plugins.Outcome(None, "division by zero", 3)

    def off():
        calls.append(2)
        raise plugins.Unavailable("switched off")

    assert swift.ask(off) == plugins.Outcome(None, "switched off", 1) and calls.count(2) == 1


def test_reranker_that_fails_when_the_plan_runs(spark):
    fused = spark.createDataFrame(
        [(q, c, 1, None, 1 / (60 + n)) for q in ("a", "b") for n, c in enumerate(("x", "y", "z"), 1)], "query_id string, chunk_id string, dense_rank int, bm25_rank int, rrf_score double"
    )
    rows = fused.withColumns({"query": F.concat(F.lit("ask "), "query_id"), "text": F.col("chunk_id")})

    def model(query, texts):
        if query == "ask b":
            raise OSError("model is down")
        return [{"x": 0.1, "y": 0.9, "z": 0.5}[t] for t in texts]

    scores = plugins.score_candidates(rows, model, patience=plugins.Patience(pause_s=0))
    assert {(r.query_id, r.failed, r.attempts) for r in scores.collect()} == {("a", None, 1), ("b", "model is down", 3)}
    got = {q: [(r.chunk_id, r.reason) for r in fusion.rerank_or_skip(fused, lambda f: scores, "m").where(F.col("query_id") == q).orderBy("rank").collect()] for q in ("a", "b")}
    assert got["a"] == [(c, "external_reranker:m") for c in "yzx"]
    assert got["b"] == [(c, "rerank_skipped:reranker_error") for c in "xyz"]
    status = plugins.reranker_status(spark, "m", scores).first()
    assert (status.fallback_used, status.error, status.attempts, status.score_policy) == (True, "model is down", 3, "rrf_only")
    short = plugins.score_candidates(rows, lambda q, t: [1.0], patience=plugins.Patience(attempts=1))
    assert {r.failed for r in short.collect()} == {"1 scores for 3 documents"}


def test_model_answers_and_fallback(spark):
    queries = spark.createDataFrame([("a", "refund days"), ("b", "unknown thing")], "query_id string, query string")
    engine = HybridEngine(store.build_chunks(corpus(spark)), EngineConfig(lexical="plain"))
    done = engine.run(queries)
    told = {r.query_id: r for r in context.answer_with(done.packets, done.answers, lambda prompt: "it takes days [E1]").collect()}
    assert (told["a"].mode, told["a"].citations, told["a"].attempts) == ("llm", ["E1"], 1)
    assert told["b"].mode == "refusal" and told["b"].attempts == 0

    def broken(prompt):
        raise OSError

    again = {r.query_id: r for r in context.answer_with(done.packets, done.answers, broken).collect()}
    assert (again["a"].mode, again["a"].fallback_reason, again["a"].attempts) == ("extractive", "llm_error", 3)


def test_status_rows(spark):
    assert plugins.reranker_status(spark, None).first().score_policy == "rrf_only"
    assert plugins.reranker_status(spark, "m").first().score_policy == "external_rerank"
    assert plugins.llm_status(spark, None).first().mode == "extractive"
    assert plugins.llm_status(spark, len).first().reason == "configured_model"


def test_rerank_requests_are_checked(spark):
    good = spark.createDataFrame([(1, 0, "q", "t")], "request_id long, index int, query string, text string")
    assert plugins.checked_documents(good).count() == 1
    for row in ((1, 0, " ", "t"), (1, 0, "q", None)):
        with pytest.raises(Exception, match="must not be blank"):
            plugins.checked_documents(spark.createDataFrame([row], good.schema)).collect()


def test_rerank_responses_are_checked(spark):
    documents = spark.createDataFrame([(1, 0), (1, 1)], "request_id long, index int")
    scores = documents.withColumn("score", F.lit(0.5))
    assert plugins.checked_response(scores, documents).count() == 2
    with pytest.raises(Exception, match="1 scores for 2 documents"):
        plugins.checked_response(scores.where("index = 0"), documents).collect()


def test_store_fallbacks_and_mirror(spark, tmp_path):
    local = lambda: store.IndexStore(spark, str(tmp_path / "local"), buckets=2)

    def closed():
        raise OSError("closed")

    opened, status = plugins.open_store(spark, closed, local, plugins.Patience(attempts=1))
    assert status.first().fallback_used and plugins.stored_state(spark, opened).first().n_chunks == 0

    class Failing:
        def sync(self, docs):
            raise OSError("full")

    report, used, status = plugins.sync_or_fall_back(spark, Failing(), local, corpus(spark))
    assert report.added == 3 and used.count() == 3 and status.first().reason == "sync_error"
    mirror = store.IndexStore(spark, str(tmp_path / "mirror"), buckets=2)
    both = store.IndexStore(spark, str(tmp_path / "both"), buckets=2, mirror=mirror)
    both.sync(corpus(spark))
    assert mirror.count() == both.count() == 3
    both.reset()
    assert not both.exists() and not mirror.exists()


def test_plain_index_and_sinks(spark, tmp_path):
    path, built = str(tmp_path / "index"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("c", "text")], "chunk_id string, text string")

    for model in ("m", "m", "other"):
        assert store.get_or_build(spark, path, model, build).count() == 1
    assert len(built) == 2
    store.get_or_build(spark, path, "m", build, rebuild=True)
    assert len(built) == 3 and documents.read_index(spark, path, "other") is not None and documents.read_index(spark, path, "none") is None
    rows = spark.range(2).withColumn("s", F.array(F.lit("b"), F.lit("a")))
    store.append_json(rows, str(tmp_path / "events"))
    store.append_json(rows, str(tmp_path / "events"))
    store.append_traces(rows, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "events")).count() == 4 and spark.read.json(str(tmp_path / "traces")).count() == 2
    store.write_markdown(spark.createDataFrame([("a.md", "# A\nb")], "filename string, content string"), str(tmp_path / "md"))
    assert "# A" in "".join(p.read_text() for p in (tmp_path / "md").rglob("part-*"))
    chunks = store.build_chunks(corpus(spark))
    assert "text" not in store.payloads(chunks).columns and store.payloads(chunks).first().permission_scopes == ["internal"]
    (tmp_path / "eval.csv").write_text("case_id,query,expected_doc_id,must_answer,expected_terms\n1,q,d,true,t\n", encoding="utf-8")
    assert documents.read_eval(spark, str(tmp_path / "eval.csv")).first().expected_doc_id == "d"
