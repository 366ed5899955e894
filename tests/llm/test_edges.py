"""Every operator and stage on empty tables, nulls, repeats, ties, long texts and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import decontaminate, extract, language, licenses, mix, neardup, neighbours, pii, secrets, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("hits", "items", "size", "target", "score", "lang_pred", "spans", "kept", "digest", "rep", "u", "taken", "budget", "n_words", "runs", "__text", "__row")


def messy(spark):
    long = " ".join(f"wörd{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 5), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, " \t\n ", "fr", "", 3),
        (None, "one two three four five six seven", "en", "a", 5), (None, None, None, None, None), (5, long, "de", "b", 1), (6, long, "de", "b", 1),
        (7, "one two three four five six seven", "en", "a", 5), (7, "one two three four five six seven", "en", "a", 5), (8, "12 34 !!", "en", "c", 8),
        (9, "mail me: x.y@example.com or 10.0.0.1", "en", "c", 8), (10, "\x00\x0b odd   text \U0001f600", "xx", "c", 8),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


OPERATORS = {
    "neardup": lambda d, b: neardup.near_duplicates(d),
    "language": lambda d, b: language.identify(d, language.train(d)),
    "suffixes": lambda d, b: suffixes.remove_repeats(d),
    "decontaminate": decontaminate.find_contamination,
    "mix": lambda d, b: mix.mix(d),
    "secrets": lambda d, b: secrets.scan(d, redacted=True),
    "pii": lambda d, b: pii.scan(d, redacted=True),
    "licenses": lambda d, b: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_and_empty_tables(spark, name):
    docs = messy(spark)
    items = spark.createDataFrame([(1, "two three four"), (None, "five six"), (2, None), (3, "")], "item_id long, text string")
    rows = OPERATORS[name](docs, items).collect()
    assert len(rows) == docs.count()
    assert OPERATORS[name](docs.limit(0), items.limit(0)).collect() == []


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = messy(spark)
    spark.createDataFrame([(1, "two three four")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() > 0 and last(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_defined_results(spark):
    docs = messy(spark).select("doc_id", "text", "lang", "source")
    near = {r.doc_id: r for r in neardup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert near[7].component_id == 1 and not near[7].kept and near[6].component_id == 5
    assert (near[2].n_shingles, near[2].component_id, near[4].n_shingles) == (0, 2, 0)
    said = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert said[2].lang_pred == said[3].lang_pred == said[8].lang_pred == "und" and said[2].score == 0
    cut = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert cut[6].n_removed == cut[6].n_bytes > 0 and cut[5].n_removed == 0 and cut[2].n_bytes == 0
    found = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert found[9].n_email == 1 and found[9].n_ip == 1 and found[2].spans == ""
    assert {r.taken for r in mix.mix(docs).collect() if r["size"] == 0} == {0}


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>a"), (3, "u", "<p>a"), (4, "u", "<" * 50), (5, "u", "x" * 200_000)], "page_id long, url string, html string")
    got = [r.text for r in extract.extract(pages.withColumn("text", F.lit("clash"))).orderBy("page_id").collect()]
    assert got[:4] == ["", "", "a", "a"] and got[5] == "x" * 200_000
    assert extract.extract(pages.limit(0)).collect() == []
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (None, [1.0, 1.0]), (60, [1.0]), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 3, 1.0), (0, 2, 4, 0.5)]
    assert neighbours.nearest_neighbours(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_signs_without_letters_have_no_language(spark):
    rows = [(1, "plain words of a language"), (2, "\u00bd \u00b2"), (3, "5 \u2460"), (4, "\u2167 12"), (5, "\u0301\u0302"), (6, "\u00aa"), (7, "\u0e01")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}
    assert {i for i, (lang, _) in said.items() if lang == "und"} == {2, 3, 4, 5} and all(said[i][1] == 0 for i in (2, 3, 4, 5))


def test_queries_and_rows_that_repeat_an_id(spark):
    """Query rows of one id and different vectors are asked apart, equal ones once; an id is listed once."""
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)]
    other = (20, r.normal(size=8).tolist())
    rows += [other, other, rows[40], *[(7, r.normal(size=8).tolist()) for _ in range(30)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 70).collect())
    want = []
    for i, q in {(i, tuple(q)) for i, q in rows if i % 20 == 0}:
        best = {}
        for j, v in rows:
            if j != i:
                best[j] = max(best.get(j, -np.inf), float((np.array(v) * np.array(q)).sum()))
        want += [(i, k, j, s) for k, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0])), 1)]
    want.sort()
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
