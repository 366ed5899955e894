"""The stored index: metadata apart from content, vectors by text, postings by term; batches of differing askers."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ferrule.config import EngineConfig
from ferrule.operators import access, lexical
from ferrule.plans.engine import HybridEngine
from ferrule.sources import store

SCHEMA = "doc_id string, title string, body string, raw_text string, source_path string, version string, permission_scope string, effective_from string, effective_to string"


def documents(spark, *rows):
    """Rows (doc_id, text, scope, from, to, version); what is left out is public, always valid, v1."""
    full = [(r + ("public", "", "", "v1")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(i, "t", text, text, f"p/{i}", version, scope, first, last) for i, text, scope, first, last, version in full], SCHEMA)


class Calls:
    """An embedder that leaves a file for each text it is sent."""

    def __init__(self, folder):
        folder.mkdir()
        self.folder = str(folder)

    def __call__(self, texts):
        from pathlib import Path

        for t in texts:
            (Path(self.folder) / uuid.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    def sent(self):
        from pathlib import Path

        found = sorted(p.read_text() for p in Path(self.folder).iterdir())
        for p in Path(self.folder).iterdir():
            p.unlink()
        return found


CONFIG = EngineConfig(dimensions=2, lexical="plain", embedding_provider="test", embedding_model="length", paragraph_delimiter="\n\n", chunk_chars=40, overlap_chars=5)


def test_permissions_and_dates_follow_metadata(spark, tmp_path):
    calls = Calls(tmp_path / "calls")
    mirror = store.IndexStore(spark, str(tmp_path / "mirror"), CONFIG)
    index = store.IndexStore(spark, str(tmp_path / "index"), CONFIG, buckets=2, embedder=calls, mirror=mirror)
    index.sync(documents(spark, ("a", "refund takes days"), ("b", "shipping is slow"), ("c", "refund never")))
    assert len(calls.sent()) == 3
    withdrawn = documents(spark, ("a", "refund takes days", "finance_restricted"), ("b", "shipping is slow", "public", "", "2026-01-31"), ("c", "refund never", "public", "", "", "v2"))
    done = index.sync(withdrawn)
    assert (done.added, done.changed, done.removed, done.restated) == (0, 0, 0, 3)
    assert {(r.doc_id, r.change) for r in done.changes.collect()} == {(i, "restated") for i in "abc"}
    assert calls.sent() == []
    for rows in (index.chunks(), index.vectors(), index.manifest(), mirror.chunks(), mirror.vectors(), mirror.manifest()):
        assert {r.doc_id: (r.scopes, r.to_day) for r in rows.collect()} == {"a": (["finance_restricted"], 99991231), "b": (["public"], 20260131), "c": (["public"], 99991231)}
    assert {r.doc_id: r.version for r in index.chunks().collect()} == {"a": "v1", "b": "v1", "c": "v2"}
    queries = spark.createDataFrame([("q", "refund days")], "query_id string, query string")
    seen = HybridEngine(index, CONFIG, embedder=lambda texts: [[1.0, 1.0] for _ in texts]).run(queries, ["public"], 20260607)
    assert {r.chunk_id for r in seen.fused.collect()} == {"c:sec_00:chunk_00"}
    assert index.sync(withdrawn).restated == 0 and index.count() == 3
    retitled = withdrawn.withColumn("title", F.when(F.col("doc_id") == "c", "new title").otherwise(F.col("title")))
    assert index.sync(retitled).changed == 1 and calls.sent() == []  # other terms, but the same text
    assert {r.term for r in index.postings().where("doc_id = 'c'").collect()} == {"new", "title", "refund", "never"}


def test_each_text_is_embedded_once(spark, tmp_path):
    calls = Calls(tmp_path / "calls")
    index = store.IndexStore(spark, str(tmp_path / "index"), CONFIG, buckets=3, embedder=calls)
    first, second, third = ("one paragraph of some thirty chars", "two paragraph of some thirty chars", "six paragraph of some thirty chars")
    index.sync(documents(spark, ("a", first + "\n\n" + second), ("b", first)))
    sent = calls.sent()
    assert len(sent) == len(set(sent)) == 2 and index.vectors().count() == 3
    index.sync(documents(spark, ("a", first + "\n\n" + third), ("b", first)))
    assert len(calls.sent()) == 1
    index.sync(documents(spark, ("a", first + "\n\n" + third), ("b", first), ("c", first)))  # known from other documents
    assert calls.sent() == [] and index.vectors().count() == 4
    assert {r.text_hash is not None and len(r.vector) for r in index.read("vectors").collect()} == {2}


def corpus(spark, r, n, start=0, scopes=("public", "internal")):
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(4_000)]
    rows = [(f"d{i}", " ".join(r.choice(words) for _ in range(r.randrange(3, 60))), r.choice(scopes)) for i in range(start, start + n)]
    return rows


def plain_recall(index, queries, k, variant, seen):
    rows = index.chunks()
    return lexical.bm25(queries, lexical.postings(rows), lexical.corpus_statistics(rows), k, variant, among=rows.where(seen))


def told(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in found.collect())


@pytest.mark.parametrize("variant", ["plain", "fts5"])
def test_recall_from_blocks_equals_a_plain_scan(spark, tmp_path, monkeypatch, variant):
    monkeypatch.setattr(store, "SEGMENTS", 2)
    r = random.Random(5)
    config = EngineConfig(dimensions=4, chunk_chars=120, overlap_chars=0, paragraph_delimiter=" ")
    index = store.IndexStore(spark, str(tmp_path / "index"), config, buckets=2)
    rows = corpus(spark, r, 120)
    queries = spark.createDataFrame([(i, " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(r.randrange(1, 5)))) for i in range(12)] + [(99, "unheard")], "query_id long, query string")
    seen = access.visible(["public"], 20260607)
    merged = []
    for step in range(4):
        index.sync(documents(spark, *rows))
        for k in (1, 7):
            assert told(index.recall(queries, k, variant, seen)) == told(plain_recall(index, queries, k, variant, seen)), step
        merged.append(len(index._held("postings")["segments"]))
        rows = rows[10:] + corpus(spark, r, 10, 1_000 * (step + 1))
        rows[step] = (rows[step][0], rows[step][1] + " w1 w2 more", rows[step][2])
        rows[step + 5] = (*rows[step + 5][:2], "finance")
    assert merged == [1, 2, 1, 2]
    assert index.statistics().first().asDict() == lexical.corpus_statistics(index.chunks()).first().asDict()


def test_recall_reads_the_files_of_asked_terms(spark, tmp_path):
    r = random.Random(7)
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=2)
    index.sync(documents(spark, *corpus(spark, r, 200)))
    asked = spark.createDataFrame([("w1",), ("w2",)], "term string")
    stored, read = (len(index.read("postings", among).inputFiles()) for among in (None, index._parts_of(asked)))
    assert stored >= 12 and read <= 2
    plan = index.read("postings", index._parts_of(asked)).where(F.col("term").isin("w1", "w2"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [w1,w2])]" in plan


def test_blocks_that_cannot_reach_the_best_are_left_out(spark, monkeypatch):
    """A term that only two of fifty blocks hold often: the others are not scored."""
    rows = [(f"k{b}:{i}", "x", 9 if b < 2 else 1, 10, b) for b in range(50) for i in range(4)]
    postings = spark.createDataFrame(rows, "chunk_id string, term string, tf long, length long, block int")
    blocks = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))
    stats = spark.createDataFrame([(1_000, 10.0)], "n_rows long, mean_length double")
    asked = spark.createDataFrame([(1, "x", 1)], "query_id long, term string, times long")
    written = {}
    keep = lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, label: written.setdefault(label, keep(df, label)))
    found = lexical.bm25_blocks(asked, blocks, postings, lambda met: met, stats, 5)
    assert {r.chunk_id.split(":")[0] for r in found.collect()} == {"k0", "k1"} and found.count() == 5
    assert written["bounds"].count() == 50 and written["reached"].count() == 0


def test_one_writer_at_a_time(spark, tmp_path):
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4))
    with index._writing(), pytest.raises(RuntimeError, match="another sync"):
        index.sync(documents(spark, ("a", "x y z")))
    (tmp_path / "index" / "versions" / "gen=000000001").mkdir(parents=True)  # left by a writer that was killed
    assert index.sync(documents(spark, ("a", "x y z"))).added == 1 and index._newest() == 1


def test_a_store_of_an_earlier_kind_is_brought_up_to_date(spark, tmp_path):
    """It knows no metadata, no postings by term and no counts."""
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=2)
    rows = [("a", "refund takes days"), ("b", "shipping is slow"), ("c", "refund never")]
    index.sync(documents(spark, *rows))
    version = index._version()
    del version["documents"]["digests"]
    version["documents"]["schema"]["fields"] = [f for f in version["documents"]["schema"]["fields"] if f["name"] in ("doc_id", "source_path", "content_hash", "embedding_model", "updated_at")]
    version["vectors"]["schema"]["fields"] = [f for f in version["vectors"]["schema"]["fields"] if f["name"] != "text_hash"]
    held = [(name, json.dumps(version[name])) for name in ("documents", "chunks", "vectors")]
    spark.createDataFrame(held, "name string, held string").coalesce(1).write.json(f"{index.path}/versions/gen=000000002")
    later = documents(spark, ("a", "refund takes days", "internal"), ("b", "shipping is fast"), ("c", "refund never"), ("d", "new words"))
    done = index.sync(later)
    assert (done.added, done.changed, done.restated) == (1, 1, 2) and index.count() == 4
    assert {r.doc_id: r.scopes for r in index.manifest().collect()} == {"a": ["internal"], "b": ["public"], "c": ["public"], "d": ["public"]}
    queries = spark.createDataFrame([(1, "refund"), (2, "fast slow")], "query_id long, query string")
    seen = access.visible(["public"], 20260607)
    assert told(index.recall(queries, 5, "plain", seen)) == told(plain_recall(index, queries, 5, "plain", seen))
    assert index.sync(later).changes.count() == 0


# ------------------------------------------------------------------ askers


def test_days_meet_spans_by_equal_nodes(spark):
    r = random.Random(2)
    day = lambda: r.choice([0, 1, 20260607, 20251231, 99991231, r.randrange(0, 100_000_000), 134217727])
    spans = [(i, day(), day()) for i in range(120)]
    points = [(i, day()) for i in range(60)]
    a = spark.createDataFrame(spans, "i long, a int, b int").select("i", F.explode(access.days_of_span(F.col("a"), F.col("b"))).alias("node"))
    b = spark.createDataFrame(points, "j long, p int").select("j", F.explode(access.days_of_point(F.col("p"))).alias("node"))
    met = [tuple(x) for x in a.join(b, "node").select("i", "j").collect()]
    assert len(met) == len(set(met))  # each span and day once
    assert set(met) == {(i, j) for i, x, y in spans for j, p in points if x <= p <= y}
    assert a.groupBy("i").count().agg(F.max("count")).first()[0] <= 54


def test_visible_rows_of_differing_askers(spark):
    r = random.Random(3)
    names = ["public", "internal", "x", "y"]
    pick = lambda: sorted(r.sample(names, r.randrange(0, 3)))
    rows = [(i, pick(), r.choice([0, 20260101]), r.choice([20260131, 99991231])) for i in range(80)]
    asked = [(q, pick() if q % 3 else None, r.choice([20260115, 20251231, None])) for q in range(12)]
    held = spark.createDataFrame(rows, "k long, scopes array<string>, from_day int, to_day int")
    queries = spark.createDataFrame(asked, "query_id long, scopes array<string>, as_of int")
    usual, today = ["internal", "public"], 20260607
    who = access.with_askers(queries.withColumn("query", F.lit("")), usual, today)
    want = {q: (set(s or usual), d or today) for q, s, d in asked}
    assert {x.query_id: (set(x.allowed), x.as_of) for x in who.collect()} == want
    pairs = access.visible_pairs(who, held, "k")
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert {tuple(x) for x in pairs.collect()} == {(q, k) for q, (s, d) in want.items() for k, scopes, a, b in rows if s & set(scopes) and a <= d <= b}
    counts = {x.query_id: x for x in access.counts_by_asker(who, held).collect()}
    for q, (s, d) in want.items():
        allowed = [(a, b) for _, scopes, a, b in rows if s & set(scopes)]
        got = counts[q]
        assert (got.visible, got.permission_scope) == (sum(a <= d <= b for a, b in allowed), len(rows) - len(allowed))
        assert (got.not_yet_effective, got.expired) == (sum(a > d for a, b in allowed), sum(a <= d and b < d for a, b in allowed))
    none = access.with_askers(queries.withColumn("query", F.lit("")), [], today, EngineConfig(empty_scopes_mean_default=False))
    assert all(x.allowed == [] for x in none.where("query_id % 3 = 0").collect())


@pytest.mark.parametrize("stored", [True, False])
def test_a_batch_of_askers_is_answered_one_by_one(spark, tmp_path, stored):
    config = EngineConfig(dimensions=16, lexical="plain")
    docs = documents(
        spark, ("a", "A refund takes 7 days."), ("b", "A refund for partners takes 2 days.", "partner"), ("c", "A refund took 30 days.", "public", "", "2025-12-31"),
        ("d", "Finance pays a refund at once.", "finance"), ("e", "From 2027 a refund takes 1 day.", "public", "2027-01-01"),
    )
    if stored:
        source = store.IndexStore(spark, str(tmp_path / "index"), config, buckets=2)
        source.sync(docs)
    else:
        source = store.build_chunks(docs, config)
    asked = [("q1", "refund days", ["public"], None), ("q2", "refund days", ["partner"], None), ("q3", "refund days", ["public"], 20250601), ("q4", "refund days", ["finance", "public"], 20270601), ("q5", "refund days", ["nobody"], None)]
    batch = spark.createDataFrame(asked, "query_id string, query string, scopes array<string>, as_of int")
    done = HybridEngine(source, config).run(batch, today=20260607, blocked_hint=True)
    together = {x.query_id: sorted(y.chunk_id for y in done.fused.where(F.col("query_id") == x.query_id).collect()) for x in batch.collect()}
    assert {q: [c[0] for c in found] for q, found in together.items()} == {"q1": ["a"], "q2": ["b"], "q3": ["a", "c"], "q4": ["a", "d", "e"], "q5": []}
    answers = {x.query_id: x.answer for x in done.answers.collect()}
    assert "7 days" in answers["q1"] and "partners" in answers["q2"] and "7 days" not in answers["q2"]
    permission = {x.query_id: x for x in done.permission.collect()}
    assert (permission["q1"].visible, permission["q1"].permission_scope, permission["q1"].not_yet_effective, permission["q1"].expired) == (1, 2, 1, 1)
    assert {x.query_id: x.reason for x in done.judged.collect()}["q5"] == "permission_denied"
    alone = HybridEngine(source, config).run(batch.where("query_id = 'q4'").select("query_id", "query"), ["finance", "public"], 20270601)
    assert sorted(x.chunk_id for x in alone.fused.collect()) == together["q4"] and alone.answers.first().answer == answers["q4"]


def test_expansion_takes_no_siblings_an_asker_may_not_see(spark):
    """Chunks of one parent with scopes of their own."""
    rows = [(f"c{i}", "p", "d", f"refund part {i}", 3, ["refund", f"part{i}"], scope) for i, scope in enumerate(["public", "secret", "public"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, parent_id string, doc_id string, text string, token_count int, terms array<string>, permission_scope string")
    chunks = access.with_access_columns(chunks.withColumns({"effective_from": F.lit(""), "effective_to": F.lit(""), "title_path": F.array(F.lit("t")), "source_path": F.lit("p"), "version": F.lit("v1"), "chunk_no": F.lit(0)}))
    asked = spark.createDataFrame([("q", "refund", ["public"]), ("r", "refund", ["public", "secret"])], "query_id string, query string, scopes array<string>")
    done = HybridEngine(chunks, EngineConfig(dimensions=16, lexical="plain")).run(asked, today=20260607)
    seen = {}
    for x in done.selected.collect():
        seen.setdefault(x.query_id, set()).update(x.expanded_ids)
    assert seen == {"q": {"c0", "c2"}, "r": {"c0", "c1", "c2"}}


def test_merging_some_documents(spark, tmp_path):
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=2)
    with pytest.raises(FileNotFoundError):
        index.merge(gone=spark.createDataFrame([("a",)], "doc_id string"))
    assert index.merge(documents(spark, ("a", "one x"), ("b", "two x"), ("c", "three x"))).added == 3
    newest = index._newest()
    done = index.merge(documents(spark, ("a", "one x")))
    assert (done.added, done.changed, done.removed, done.restated) == (0, 0, 0, 0) and index._newest() == newest
    done = index.merge(documents(spark, ("b", "two y"), ("d", "four x")), spark.createDataFrame([("c",), ("b",), ("unheard",)], "doc_id string"))
    assert (done.added, done.changed, done.removed) == (1, 1, 1)
    assert {r.doc_id for r in index.manifest().collect()} == {"a", "b", "d"}
    assert index.merge(gone=spark.createDataFrame([("a",)], "doc_id string")).removed == 1
    assert sorted((r.doc_id, r.term) for r in index.postings().where("term <> 't'").collect()) == [("b", "two"), ("b", "y"), ("d", "four"), ("d", "x")]
    assert index.count() == index.chunks().count() == index.vectors().count() == 2


def test_a_folder_is_followed(spark, tmp_path):
    """Files run through again write no version; a file that has gone takes its document along."""
    from ferrule.streaming import ingest

    raw = tmp_path / "raw"
    raw.mkdir()
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=2)

    def run(checkpoint):
        ingest.keep_indexed(ingest.stream_corpus(spark, str(raw)), index, str(tmp_path / checkpoint), str(raw)).awaitTermination()

    for name in ("one", "two"):
        (raw / f"{name}.md").write_text(f"# {name}\n\nwords of {name}\n", encoding="utf-8")
    run("cp")
    newest = index._newest()
    run("other")  # all files again, in a stream of its own
    assert index._newest() == newest and index.count() == 2
    (raw / "one.md").unlink()
    assert [r.doc_id for r in ingest.missing(index, str(raw)).collect()] == ["one"]
    (raw / "three.md").write_text("# three\n\nother words\n", encoding="utf-8")
    run("cp")
    assert {r.doc_id for r in index.chunks().collect()} == {"two", "three"}


def test_what_is_the_same_is_told_from_digests(spark, tmp_path, monkeypatch):
    """A sync without changes reads no manifest; one with a change reads the bucket it lies in."""
    mirror = store.IndexStore(spark, str(tmp_path / "mirror"), EngineConfig(dimensions=4))
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=8, mirror=mirror)
    rows = [(f"d{i}", f"text number {i}") for i in range(40)]
    index.sync(documents(spark, *rows))
    read = []
    plain = store.IndexStore.read

    def recorded(self, name, among=None):
        read.append((name, among))
        return plain(self, name, among)

    monkeypatch.setattr(store.IndexStore, "read", recorded)
    index.mirror = None
    assert index.sync(documents(spark, *rows)).changes.count() == 0
    assert [(name, among) for name, among in read if name == "documents" and among != []] == []
    read.clear()
    index.mirror = mirror
    rows[3] = ("d3", "another text")
    assert index.sync(documents(spark, *rows)).changed == 1
    assert all(among is not None and len(among) <= 1 for name, among in read if name == "documents")
    assert {r.doc_id: r.content_hash for r in mirror.manifest().collect()} == {r.doc_id: r.content_hash for r in index.manifest().collect()}
    read.clear()
    mirror.follow(index)
    assert [n for n, among in read if n == "documents" and among is not None] == []


def test_a_sync_writes_rows_of_split_documents_only(spark, tmp_path):
    """Chunks and vectors of other documents are not written again, and no text or vector for new metadata."""
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=1)
    rows = [(f"d{i}", f"text number {i}") for i in range(30)]
    index.sync(documents(spark, *rows))
    written = lambda name, gen: sorted({r.doc_id for r in spark.read.parquet(f"{index.path}/{name}/gen={gen:09d}").select("doc_id").collect()})
    rows[3] = ("d3", "another text")
    index.sync(documents(spark, *rows[:29]))
    assert written("chunks", 2) == written("vectors", 2) == written("postings", 2) == ["d3"]
    rows[4] = ("d4", "text number 4", "finance")
    assert index.sync(documents(spark, *rows[:29])).restated == 1
    assert written("chunks", 3) == written("vectors", 3) == written("postings", 3) == []
    for name in ("chunks", "vectors", "postings"):
        assert {r.doc_id for r in getattr(index, name)().collect()} == {f"d{i}" for i in range(29)}, name
    for found in (index.chunks(), index.vectors()):
        assert {r.doc_id: r.scopes for r in found.collect()} == {f"d{i}": ["finance" if i == 4 else "public"] for i in range(29)}
    assert index.count() == index.chunks().count() == index.vectors().count() == 29


def test_segments_of_chunks_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SEGMENTS", 2)
    index = store.IndexStore(spark, str(tmp_path / "index"), EngineConfig(dimensions=4), buckets=2)
    held = []
    for step in range(4):
        rows = [(f"d{i}", f"text number {i} {step if i == step else ''}") for i in range(step, 8)]
        index.sync(documents(spark, *rows))
        held.append(len(index._held("chunks")["segments"]))
        assert {r.doc_id for r in index.chunks().collect()} == {r.doc_id for r in index.vectors().collect()} == {r[0] for r in rows}
        assert index.count() == len(rows)
    assert held == [1, 2, 1, 2]
    assert index.read("vectors").count() < 12 and index.vacuum() > 0 and index.chunks().count() == 5


@pytest.mark.parametrize("packed", [7, 10_000])
def test_packed_postings_equal_plain_ones(spark, monkeypatch, packed):
    """Dealt out by part and packed, postings take few rows; unpacked, they are those that a row a posting says."""
    monkeypatch.setattr(lexical, "PACKED", packed)
    r = random.Random(3)
    rows = [(f"{d}:c{c}", d, f":c{c}", [f"w{int(r.paretovariate(0.6)) % 60}" for _ in range(r.randrange(0, 40))], 5, c % 3) for d in range(40) for c in range(d % 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, place string, terms array<string>, born long, block int")
    held = lexical.packed_postings(chunks, 8).repartitionById(8, F.col("part"))
    assert packed < 100 or held.count() <= 8 * chunks.rdd.getNumPartitions()
    found = lexical.unpacked_postings(held, "bigint").withColumn("part", F.spark_partition_id())
    wanted = lexical.postings(chunks, carry=("doc_id", "block")).select(F.concat(F.col("doc_id"), F.substr("chunk_id", F.length("doc_id") + 1)).alias("chunk_id"), "term", "tf", "length", "block")
    assert sorted(map(tuple, found.select(F.concat("doc_id", "place"), "term", "tf", "length", "block").collect())) == sorted(map(tuple, wanted.collect()))
    assert found.where(F.col("part") != lexical.part_of("term", 8)).count() == 0
    said = lambda df: {(x.term, x.block): tuple(x)[2:] for x in df.collect()}
    agg = (F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_length").alias("least_length"))
    plain = wanted.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))
    assert said(lexical.block_counts(found).groupBy("term", "block").agg(*agg)) == said(plain)
    assert said(lexical.lost_counts(chunks).groupBy("term", "block").agg(F.sum(-F.col("n")).alias("n"))) == said(plain.select("term", "block", "n"))
