"""Operators of the engine on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.config import EngineConfig
from ferrule.functions import vectors
from ferrule.operators import access, casebook, chunking, context, dense, fusion, lexical, plugins, reports, selection
from ferrule.plans import catalogue
from ferrule.plans.catalogue_sql import GOLDEN_SQL
from ferrule.plans.engine import HybridEngine
from ferrule.sources import documents, store


def chunks_of(spark, rows):
    schema = "chunk_id string, parent_id string, doc_id string, text string, token_count int, terms array<string>, permission_scope string, effective_from string, effective_to string"
    return access.with_access_columns(spark.createDataFrame(rows, schema))


def chunk(cid, scope="internal", to="", terms=("test",), tokens=8, parent=None):
    return (cid, parent or f"{cid}:parent", f"{cid}:doc", f"{cid} test text", tokens, list(terms), scope, "2026-01-01", to)


def test_access_reasons_and_splits(spark):
    rows = chunks_of(spark, [chunk("a"), chunk("s", "support_only"), chunk("e", to="2026-01-31"), chunk("p", "public; other"), chunk("n", "")])
    found = {r.chunk_id: r.reason for r in rows.select("chunk_id", access.reason(["internal", "public"], 20260607).alias("reason")).collect()}
    assert found == {"a": None, "s": "permission_scope", "e": "expired", "p": None, "n": "permission_scope"}
    assert access.effective_scopes([]) == ["internal", "public"]
    assert not access.effective_scopes([], EngineConfig(empty_scopes_mean_default=False))
    both = chunks_of(spark, [("x", "x", "x", "", 1, [], "internal", "2027-01-01", "2026-01-01")])
    assert {r.part for r in access.remote_split(both, ["internal"], 20260607).collect()} == {"not_yet_effective", "expired"}
    assert [r.part for r in access.store_split(both, ["internal"], 20260607).collect()] == ["not_yet_effective"]
    assert access.reason_counts(rows.select(access.reason(["internal"], 20260607).alias("reason"))).first().asDict() == {
        "visible": 1, "permission_scope": 3, "not_yet_effective": 0, "expired": 1}


def test_bm25_values(spark):
    rows = spark.createDataFrame(
        [("d1", ["refund", "policy"]), ("d2", ["refund", "refund", "timeline", "days"]), ("d3", ["shipping", "policy", "days"])], "chunk_id string, terms array<string>"
    )
    queries = spark.createDataFrame([(1, "refund"), (2, "refund refund"), (3, "refund policy"), (4, "nothing")], "query_id int, query string")
    found = lexical.bm25(queries, lexical.postings(rows), lexical.corpus_statistics(rows), 12).orderBy("query_id", "rank").collect()
    scores = {}
    for r in found:
        scores.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert [c for c, _ in scores[1]] == ["d2", "d1"]
    assert [s for _, s in scores[1]] == pytest.approx([0.6064562958, 0.5529454462])
    assert [s for _, s in scores[2]] == pytest.approx([2 * 0.6064562958, 2 * 0.5529454462])
    assert scores[3] == [("d1", pytest.approx(1.1058908923)), ("d2", pytest.approx(0.6064562958)), ("d3", pytest.approx(0.4700036292))]
    assert 4 not in scores


def test_dense_order_and_ragged_vectors(spark):
    rows = spark.createDataFrame([("m", [1.0, 0.0]), ("o", [0.0, 1.0]), ("s", [0.5]), ("z", [])], "key string, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    found = [(r.key, r.score) for r in dense.dense_topk(queries, rows, 3).orderBy("rank").collect()]
    assert found == [("m", 1.0), ("s", 0.5), ("o", 0.0)]
    assert [r.key for r in dense.dense_topk(queries, rows, 3, normalised=True, min_score=0.9).orderBy("rank").collect()] == ["m", "s"]


def test_rrf_and_rerank(spark):
    a = spark.createDataFrame([("q", "first", 1, 0.9), ("q", "second", 2, 0.8)], "query_id string, chunk_id string, rank int, score double")
    b = spark.createDataFrame([("q", "first", 1, 3.0), ("q", "third", 2, 2.0)], "query_id string, chunk_id string, rank int, score double")
    fused = fusion.rrf_fuse(a, b)
    assert {r.chunk_id: r.rrf_score for r in fused.collect()} == pytest.approx({"first": 2 / 61, "second": 1 / 62, "third": 1 / 62})
    skipped = fusion.rerank_or_skip(fused, None, "").orderBy("rank").collect()
    assert [(r.chunk_id, r.reason) for r in skipped] == [(c, "rerank_skipped:no_configured_model") for c in ("first", "second", "third")]
    model = lambda f: f.select("query_id", "chunk_id", F.when(F.col("chunk_id") == "second", 0.95).otherwise(0.2).alias("model_score"))
    assert [r.chunk_id for r in fusion.rerank_or_skip(fused, model, "m").orderBy("rank").collect()] == ["second", "first", "third"]

    def broken(_):
        raise RuntimeError

    assert {r.reason for r in fusion.rerank_or_skip(fused, broken, "m").collect()} == {"rerank_skipped:reranker_error"}


def test_mmr_drops_near_copies(spark):
    rows = spark.createDataFrame(
        [("q", "primary", 1, 0.9, [1.0, 0.0]), ("q", "duplicate", 2, 0.85, [0.99, 0.01]), ("q", "diverse", 3, 0.7, [0.0, 1.0])],
        "query_id string, chunk_id string, rank int, rerank_score double, vector array<double>",
    )
    found = {r.chunk_id: r for r in selection.mmr(rows, 2, 0.65).collect()}
    assert (found["primary"].mmr_rank, found["diverse"].mmr_rank) == (1, 2)
    assert found["primary"].mmr_score == pytest.approx(0.65) and found["diverse"].mmr_score == pytest.approx(0.5056, abs=1e-4)
    assert found["duplicate"].dropped and found["duplicate"].duplicate_of == "primary"
    assert found["duplicate"].max_similarity == pytest.approx(0.99)


def test_expand_and_truncate(spark):
    rows = []
    for p in (1, 2, 3):
        rows.append(chunk(f"p{p}-anchor", parent=f"p{p}", tokens=100))
        rows.append(chunk(f"p{p}-sibling", parent=f"p{p}", tokens=350))
    chunks = chunks_of(spark, rows)
    anchors = chunks.where("chunk_id LIKE '%anchor'").withColumns({"query_id": F.lit("q"), "rerank_score": F.lit(0.9), "mmr_rank": F.regexp_extract("chunk_id", r"p(\d)", 1).cast("int")})
    grown = selection.expand(anchors, chunks)
    cut = selection.truncate(grown, budget=899).where("selected").collect()
    assert [(r.chunk_id, r.expanded_tokens, r.expanded_ids) for r in cut] == [("p1-anchor", 450, ["p1-anchor", "p1-sibling"])]
    ids = spark.createDataFrame([("p1",), ("none",)], "parent_id string")
    assert {r.parent_id: len(r.siblings) for r in selection.siblings(ids, chunks).collect()} == {"p1": 2, "none": 0}
    wanted = spark.createDataFrame([("p1-anchor",), ("p1-anchor",), ("missing",)], "chunk_id string")
    assert [r.chunk_id for r in selection.hydrate(wanted, chunks).collect()] == ["p1-anchor"]


def test_truncate_gap_and_minimum(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, 10), ("q", 2, 0.8, 10), ("q", 3, 0.4, 10), ("q", 4, 0.05, 10)], "query_id string, mmr_rank int, rerank_score double, expanded_tokens int")
    assert [r.mmr_rank for r in selection.truncate(rows).where("selected").orderBy("mmr_rank").collect()] == [1, 2]
    assert selection.truncate(rows, rrf_only=True).where("selected").count() == 4


def test_chunk_folding(spark):
    pack = lambda paras: spark.range(1).select(chunking.pack(F.array(*[F.lit(p) for p in paras]), 280, 60).alias("v")).first().v
    assert [len(c) for c in pack(["a" * 300])] == [280, 80]
    long, tail = pack(["b" * 200, "c" * 200])
    assert long == "b" * 200 and tail == "b" * 60 + "\n\n" + "c" * 200
    docs = spark.createDataFrame([("d", "T", "lead\n\n## One\nx\n### sub\n\n## Two\n"), ("e", "E", "## Only\ny")], "doc_id string, title string, body string")
    found = {r.parent_id: (r.title_path, r.text) for r in chunking.split_sections(docs).collect()}
    assert found["d:sec_00"] == (["T", "T"], "lead") and found["d:sec_01"] == (["T", "One"], "## One\nx\n### sub")
    assert found["d:sec_02"][0] == ["T", "Two"] and found["e:sec_00"][0] == ["E", "Only"] and len(found) == 4
    plain = spark.createDataFrame([("s", "一二三。四五六！七八九")], "source string, text string")
    assert [r.text for r in chunking.plain_chunks(plain, "source", "text", 8, 2).orderBy("position").collect()] == ["一二三。四五六！", "六！\n\n七八九"]


def test_frontmatter_and_folder(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\ndoc_id: x\ntitle: a: b\nno colon\ntitle: last\npermission_scope:\n---\n\n# Body\n", encoding="utf-8")
    (tmp_path / "a.md").write_text("---\nnever closed\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("x", encoding="utf-8")
    found = {r.doc_id: r for r in documents.read_corpus(spark, str(tmp_path)).collect()}
    assert set(found) == {"x", "a"}
    assert (found["x"].title, found["x"].permission_scope, found["x"].body) == ("last", "", "# Body")
    assert (found["a"].title, found["a"].permission_scope) == ("a", "internal") and found["a"].body.startswith("---")
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        documents.read_plain(spark, str(tmp_path / "none"))


def test_incremental_sync(spark, tmp_path):
    raw, index = tmp_path / "raw", tmp_path / "index"
    raw.mkdir()
    for name in ("doc_a", "doc_b"):
        (raw / f"{name}.md").write_text(f"# {name}\n\ntext of {name}\n", encoding="utf-8")
    target = store.IndexStore(spark, str(index), buckets=4)
    said = lambda done: sorted((r.doc_id, r.change) for r in done.changes.collect())
    assert said(target.sync(documents.read_corpus(spark, str(raw)))) == [("doc_a", "added"), ("doc_b", "added")]
    assert said(target.sync(documents.read_corpus(spark, str(raw)))) == []
    (raw / "doc_b.md").write_text("# doc_b\n\nother words\n", encoding="utf-8")
    assert said(target.sync(documents.read_corpus(spark, str(raw)))) == [("doc_b", "changed")]
    assert {r.text for r in target.chunks().collect()} == {"# doc_a\n\ntext of doc_a", "# doc_b\n\nother words"}
    (raw / "doc_a.md").unlink()
    assert said(target.sync(documents.read_corpus(spark, str(raw)))) == [("doc_a", "removed")]
    assert [r.doc_id for r in target.manifest().collect()] == ["doc_b"] and target.count() == 1
    assert {r.term for r in target.postings().collect()} >= {"other", "words"}


def test_sufficiency_outcomes(spark):
    queries = spark.createDataFrame([("a", "积分可以提现吗？"), ("b", "今天北京天气怎么样？"), ("c", "refund")], "query_id string, query string")
    selected = spark.createDataFrame([("a", 0.03, 1, ["积分", "提现"])], "query_id string, rerank_score double, bm25_rank int, terms array<string>")
    covered = context.coverage(queries, selected, rrf_only=True)
    assert {r.query_id: r.coverage for r in covered.collect()}["a"] == pytest.approx(2 / 7)
    assert {r.query_id: r.reason for r in context.sufficiency(covered, rrf_only=True).collect()} == {"a": "pass", "b": "out_of_domain_query", "c": "no_selected_evidence"}
    blind = selected.withColumn("bm25_rank", F.lit(None).cast("int"))
    again = context.sufficiency(context.coverage(queries, blind, rrf_only=True), rrf_only=True)
    assert {r.query_id: r.reason for r in again.collect()}["a"] == "rrf_only_missing_lexical_signal"
    blocked = spark.createDataFrame([("c", 0.5)], "query_id string, overlap_ratio double")
    assert {r.query_id: r.reason for r in context.sufficiency(covered, blocked, rrf_only=True).collect()}["c"] == "permission_denied"


def test_citations_and_answers_by_model(spark):
    answers = spark.createDataFrame([("q", "extractive", "x [E1] y [E404]", [])], "query_id string, mode string, answer string, citations array<string>")
    cited = spark.createDataFrame([("q", "E1"), ("q", "E2")], "query_id string, citation_id string")
    r = context.validate_citations(answers, cited).first()
    assert (r.used, r.missing, r.citation_valid) == (["E1", "E404"], ["E404"], False)
    none = context.answer_with(None, answers)
    assert none.first().fallback_reason == "llm_not_configured"


def test_golden_questions(spark):
    found = {r.query_id: r for r in catalogue.hybrid_golden(spark, "").collect()}
    assert "7 到 15 个工作日" in found["q1"].answer and "不支持 7 天无理由退款" in found["q2"].answer and "不能提现" in found["q3"].answer
    assert found["q4"].mode == "refusal" and found["q4"].reason == "out_of_domain_query"
    assert found["q5"].reason == "permission_denied" and found["q5"].answer == context.PERMISSION_ANSWER
    assert all(r.citation_valid for r in found.values())


def test_golden_questions_equal_sql(spark):
    """The engine from chunking to answers, in DuckDB's words."""
    duckdb = pytest.importorskip("duckdb")
    columns = ["query_id", "mode", "reason", "answer", "citations", "citation_valid"]
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({GOLDEN_SQL})").fetchall()
    assert sorted(map(tuple, catalogue.hybrid_golden(spark, "").select(*columns).collect())) == sorted(want)


def test_numbered_context_holds_whole_texts(spark, tmp_path):
    texts = [(1, "refund rules " + "and more of them " * 60 + "the end", "en", "a"), (2, "refund of parcels", "en", "b"), (3, "nothing else here", "en", "c")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "refund")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ranked = sorted((r["rank"], r.doc_id, r.score) for r in catalogue._lexical(spark, str(tmp_path)).where("rank <= 3").collect())
    assert {1, 2} <= {doc_id for _, doc_id, _ in ranked}
    whole = {doc_id: (text, source) for doc_id, text, _, source in texts}
    want = "\n\n---\n\n".join(f"[{rank}] source={whole[i][1]} chunk={i} score={score:.4f}\n{whole[i][0]}" for rank, i, score in ranked)
    assert [tuple(r) for r in catalogue.numbered_context(spark, str(tmp_path)).collect()] == [(7, len(want), hashlib.sha256(want.encode()).hexdigest())]


def test_casebook(spark):
    schema = "issue_area string, issue_category string, issue_sub_category string, product_category string, product_sub_category string, issue_complexity string, conversation string, qa string, n int"
    qa = '{"knowledge":[{"customer_summary_question":"How long?","agent_summary_solution":"A week"},null]}'
    rows = [("Orders", "", "Refund timelines", "A", "B", "low", "hi  there", qa, 0), ("Orders", "Late", "", "A", "B", "low", "x", "not json", 1), (None, None, None, None, None, None, None, None, 2)]
    docs = casebook.render_documents(spark.createDataFrame(rows, schema), "n", 2).orderBy("filename").collect()
    assert [d.filename for d in docs] == ["brownbox_support_001_orders.md", "brownbox_support_002_customer_support.md"]
    assert "## Case 1: Refund timelines" in docs[0].content and "- Q1: How long?\n  Resolution: A week" in docs[0].content and len(docs[0].content) > 700
    assert "## Case 2: Late" in docs[0].content and "Resolution: not json" in docs[0].content
    assert casebook.NO_QA in docs[1].content
    counted = casebook.numbered(spark.range(50).withColumn("k", 100 - F.col("id")), "k").orderBy("k").collect()
    assert [r.row_no for r in counted] == list(range(50))


def test_evaluation_and_monitoring(spark):
    cases = spark.createDataFrame([("1", "a", "d", "TRUE", "ok"), ("2", "b", "", "false", "x"), ("3", "c", "d", "true", "ok")], "case_id string, query_id string, expected_doc_id string, must_answer string, expected_terms string")
    answers = spark.createDataFrame([("a", "extractive", "it is ok"), ("b", "refusal", "no"), ("c", "extractive", "ok")], "query_id string, mode string, answer string")
    cited = spark.createDataFrame([("a", "d"), ("c", "e")], "query_id string, doc_id string")
    done = reports.evaluate(cases, answers, cited)
    assert {r.case_id: r.passed for r in done.collect()} == {"1": True, "2": True, "3": False}
    assert tuple(reports.summary(done).first()) == (3, 2)
    event = reports.monitoring_events(spark.createDataFrame([("q", "跨境订单退款多久到账？", ["b", "a", "a"])], "query_id string, query string, doc_ids array<string>")).first()
    assert event.query_hash == "30cd02540ef95ea7" and event.query_chars == 11 and event.selected_doc_ids == ["a", "b"] and event.dense_hits == 0


def test_streams(spark, tmp_path):
    from ferrule.streaming import ingest

    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "one.md").write_text("# One\n\nwords here\n", encoding="utf-8")
    target = store.IndexStore(spark, str(tmp_path / "index"), buckets=2)
    ingest.keep_indexed(ingest.stream_corpus(spark, str(raw)), target, str(tmp_path / "cp")).awaitTermination()
    (raw / "two.md").write_text("# Two\n\nmore words\n", encoding="utf-8")
    ingest.keep_indexed(ingest.stream_corpus(spark, str(raw)), target, str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id for r in target.chunks().collect()} == {"one", "two"}


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_engine_reads_a_stored_index(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embedder(texts):
        import uuid as u

        for t in texts:
            (calls / u.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    def docs(*texts):
        raw = [(f"f{i}", f"d{i}", f"# D{i}\n\n{t}\n") for i, t in enumerate(texts)]
        return documents.with_defaults(documents.parse_frontmatter(spark.createDataFrame(raw, "source_path string, name string, raw_text string")))

    config = EngineConfig(dimensions=2, lexical="plain", embedding_provider="test", embedding_model="length")
    index = store.IndexStore.of_identity(spark, str(tmp_path / "index"), config, buckets=3, embedder=embedder)
    assert ".test_length." in index.path
    index.sync(docs("refund takes days", "shipping is slow", "points expire"))
    assert len(list(calls.iterdir())) == 3 and index.vectors().count() == 3
    index.sync(docs("refund takes days", "shipping is fast", "points expire"))
    assert len(list(calls.iterdir())) == 4
    queries = spark.createDataFrame([("q", "refund days")], "query_id string, query string")
    done = HybridEngine(index, config, embedder=embedder).run(queries, blocked_hint=True)
    assert "refund" in done.answers.first().answer and len(list(calls.iterdir())) == 5  # the query only
    assert index.postings().join(index.chunks(), "chunk_id").count() == index.postings().count()
    trace, event = done.traces.first(), done.events.first()
    assert (trace.dense_hits, trace.bm25_hits, trace.mode, trace.doc_ids, trace.citation_valid) == (3, 1, "extractive", ["d0"], True)
    assert event.status == "ok" and len(event.query_hash) == 16 and event.selected_doc_ids == ["d0"] and "rerank" in event.stage_latencies_ms and event.trace_id
    assert done.permission.first().visible == 3
    assert {r.component: r.mode for r in done.status.collect()} == {"reranker": "skipped", "llm": "extractive", "embedding": "external"}
    done.release()
    other = store.IndexStore(spark, index.path, EngineConfig(embedding_model="another"))
    with pytest.raises(ValueError, match="embedded by test:length"):
        other.vectors()


def test_reranker_and_model_fall_back_inside_the_engine(spark):
    raw = [(f"f{i}", f"d{i}", f"# D{i}\n\n{t}\n") for i, t in enumerate(["refund takes days", "refund is slow", "points expire"])]
    chunks = store.build_chunks(documents.with_defaults(documents.parse_frontmatter(spark.createDataFrame(raw, "source_path string, name string, raw_text string"))))
    queries = spark.createDataFrame([("a", "refund days"), ("b", "refund slow")], "query_id string, query string")

    def reranker(query, texts):
        if query == "refund slow":
            raise OSError("model is down")
        return [0.9 if "days" in t else 0.5 for t in texts]

    def llm(prompt):
        raise OSError("no model")

    engine = HybridEngine(chunks, EngineConfig(lexical="plain"), reranker=reranker, model_name="m", llm=llm, patience=plugins.Patience(pause_s=0))
    done = engine.run(queries)
    reasons = {r.query_id: r.reason for r in done.ranked.select("query_id", "reason").distinct().collect()}
    assert reasons == {"a": "external_reranker:m", "b": "rerank_skipped:reranker_error"}
    assert {r.query_id: (r.mode, r.fallback_reason, r.attempts) for r in done.answers.collect()} == {q: ("extractive", "llm_error", 3) for q in "ab"}
    fell = {r.component: (r.fallback_used, r.attempts) for r in reports.fallbacks(done.status).withColumn("fallback_used", F.lit(True)).collect()}
    assert fell == {"reranker": (True, 3), "llm": (True, 3)}
    assert {r.query_id: r.reranker_fallback_used for r in done.events.collect()} == {"a": False, "b": True}


def test_a_sync_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch):
    def docs(*texts):
        raw = [(f"f{i}", f"d{i}", f"# D{i}\n\n{t}\n") for i, t in enumerate(texts)]
        return documents.with_defaults(documents.parse_frontmatter(spark.createDataFrame(raw, "source_path string, name string, raw_text string")))

    mirror = store.IndexStore(spark, str(tmp_path / "mirror"))
    index = store.IndexStore(spark, str(tmp_path / "index"), buckets=2, mirror=mirror)
    assert index.sync(docs("one", "two")).added == 2
    monkeypatch.setattr(store.IndexStore, "_embedded", lambda self, chunks: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        index.sync(docs("one", "three", "four"))
    assert sorted(r.text for r in index.chunks().collect()) == ["# D0\n\none", "# D1\n\ntwo"] and index.vectors().count() == 2
    monkeypatch.undo()
    done = index.sync(docs("one", "three", "four"))
    assert (done.added, done.changed, done.removed) == (1, 1, 0)
    assert sorted(r.text for r in mirror.chunks().collect()) == ["# D0\n\none", "# D1\n\nthree", "# D2\n\nfour"]
    assert mirror.vectors().exceptAll(index.vectors()).count() == 0
    assert index.vacuum() > 0 and index.count() == index.vectors().count() == 3


def test_equal_vectors_leave_at_most_k_rows_a_batch(spark):
    rows = spark.range(2_000).select(F.col("id").alias("key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).repartition(2)
    asked = rows.where("key < 20").withColumnRenamed("key", "query_id")
    found = dense.dense_topk(asked, rows, 5)
    assert {(r.key, r["rank"]) for r in found.collect()} == {(i, i + 1) for i in range(5)}
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        keys = r.integers(0, 4, (3, 30)).astype(float)
        hit = dense._best(keys, 7)
        for row, h in zip(keys, hit, strict=True):
            assert np.flatnonzero(h).tolist() == sorted(np.argsort(-row, kind="stable")[:7].tolist())


def test_kernels_hold_a_bounded_piece_of_a_batch(spark, monkeypatch):
    """Counting, hashing and multiplying a few rows at a time, with the results of whole batches."""
    lengths = np.array([3, 0, 9, 2, 2, 2, 0, 40, 1])
    assert list(vectors.pieces(lengths, 6)) == [(0, 2), (2, 3), (3, 7), (7, 8), (8, 9)]
    assert list(vectors.pieces(lengths, 100, 4)) == [(0, 4), (4, 8), (8, 9)]
    rows = spark.range(90).select(F.col("id").alias("key"), F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda i: F.concat(F.lit("t"), (F.col("id") * i) % 11)).alias("terms")).coalesce(1)
    asked = vectors.hash_embeddings(rows.where("key % 9 = 0"), "key", "terms", 16).withColumnRenamed("key", "query_id")

    def found():
        near = dense.dense_topk(asked, vectors.hash_embeddings(rows, "key", "terms", 16), 5).select("query_id", "key", "rank", F.round("score", 9))
        parts = (lexical.postings(rows, "key"), lexical.sparse_postings(rows, "key"), vectors.hashed_weights(rows, "key"), near)
        return [sorted(map(tuple, part.collect())) for part in parts]

    whole = found()
    for module, name, value in ((lexical, "COUNTED", 10), (vectors, "PLACES", 64), (vectors, "TERMS", 9), (dense, "ROW_BYTES", 7 * 8 * 16)):
        monkeypatch.setattr(module, name, value)
    assert found() == whole


def test_rows_are_numbered_alike_however_wide_they_are(spark):
    """Rows that lie in several partitions: their sizes alone, being small, would lie in fewer."""
    wide = F.concat(*[F.sha2((F.col("id") * 64 + i).cast("string"), 256) for i in range(32)])
    rows = spark.range(8_000).withColumns({"k": 8_000 - F.col("id"), "wide": wide})
    assert casebook.numbered(rows, "k").where("row_no = k - 1 AND length(wide) = 2048").count() == 8_000


def test_relevant_documents_equal_a_plain_search(spark):
    texts = ["a b c d", "xa b cd", "", "b  c", "the quick brown fox", "quick brown", "thequick brownfox", "c", "a b c d e quick brown fox", None]
    items = ["a b c", "quick brown", "b", "x", "the quick brown", " b ", "b  c", "a b cd", "", "brown fox jumps", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, query string")
    found = catalogue.relevant(docs, asked)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    want = {(q, d) for q, item in enumerate(items) for d, text in enumerate(texts) if item is not None and text is not None and item in text}
    assert {tuple(r) for r in found.collect()} == want


def test_event_stream_rolls_up(spark, tmp_path):
    from ferrule.streaming import ingest

    rows = [("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 01:10:00", "a", 4.0), ("2026-01-01 00:20:00", "b", 8.0)]
    events = spark.createDataFrame(rows, "at string, kind string, value double").select(F.to_timestamp("at").alias("ts"), "kind", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    rolled = ingest.stream_roll_up(stream, "ts", ["kind"], "value", "1 hour", "2 hours")
    rolled.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in reports.roll_up(events, "ts", ["kind"], "value", "1 hour").collect()}
    assert {tuple(r) for r in spark.table("rolled").collect()} == want and len(want) == 3


def test_blocks_meet_their_queries_without_a_row_a_posting_and_query(spark):
    """Scores, ties to the smaller key and the cut equal a plain sum; what leaves a block is its best rows."""
    held = [(b, f"c{(i * 37) % 100:02d}", t, 1.0 + (i * j) % 4) for b in range(2) for j, t in enumerate("xyz") for i in range(b, 100, 2 + j)]
    wanted = [(b, q, t, 0.5 + q % 3) for b in range(3) for q in range(7) for t in "xyzw"[q % 3 :]]
    held, wanted = spark.createDataFrame(held, "block int, key string, term string, value double"), spark.createDataFrame(wanted, "block int, query_id long, term string, weight double")
    got = lexical._best_of_blocks(wanted, held, 4, "key")
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan
    summed = wanted.join(held, ["block", "term"]).groupBy("block", "query_id", "key").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    order = Window.partitionBy("block", "query_id").orderBy(F.desc(lexical.score_key()), "key")
    plain = summed.withColumn("n", F.row_number().over(order)).where("n <= 4").select("query_id", "key", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 56


def test_postings_go_to_their_blocks_packed(spark):
    """What is shuffled to the blocks is a stream a block and task, not a row a posting."""
    held = spark.range(3_000).select((F.col("id") % 3).cast("int").alias("block"), F.concat(F.lit("c"), "id").alias("key"), F.lit("x").alias("term"), (F.col("id") % 7 + 1.0).alias("value")).coalesce(1)
    wanted = spark.createDataFrame([(b, 1, "x", 2.0) for b in range(3)], "block int, query_id long, term string, weight double")
    got = lexical._best_of_blocks(wanted, held, 2, "key")
    assert "held" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 6
    assert {r.score for r in got.collect()} == {14.0}
