"""Dense recall from lists against the whole product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import access, clustered, dense


def vectors(spark, r, n, width=16, groups=12):
    centre = r.normal(size=(groups, width))
    x = centre[r.integers(0, groups, n)] + 0.35 * r.normal(size=(n, width))
    rows = [(i, v.tolist(), ["public"] if i % 3 else ["internal"], 0, 20260101 if i % 5 == 0 else 99991231) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    return spark.createDataFrame(rows, "key long, vector array<double>, scopes array<string>, from_day int, to_day int").repartition(3)


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.key, round(r.score, 9))
    return out


def test_lists_hold_most_neighbours_and_read_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "LIST_ROWS", 100)
    rows = vectors(spark, np.random.default_rng(1), 3_000)
    held = clustered.VectorLists.build(rows, str(tmp_path / "lists"), 10)
    asked = rows.where("key % 100 = 0").select(F.col("key").alias("query_id"), "vector")
    exact = found(dense.dense_topk(asked, rows.select("key", "vector"), 10))
    assert found(held.search(asked, 10, exact=True)) == exact
    again = clustered.VectorLists.open(spark, str(tmp_path / "lists"))
    assert again.probes == held.probes and np.allclose(again.centroids, held.centroids) and len(held.centroids) == 30
    got = found(again.search(asked, 10))
    hits = sum(len({k for k, _ in got[q].values()} & {k for k, _ in exact[q].values()}) for q in exact)
    assert hits / (10 * len(exact)) >= 0.9 and held.probes <= 10
    # scores are those of the whole vectors, and what is found at a rank is never better than what there is
    scores = {q: dict(v.values()) for q, v in exact.items()}
    assert all(abs(scores[q][k] - s) < 1e-9 for q, v in got.items() for k, s in v.values() if k in scores[q])
    one = asked.limit(1)
    read = [held.rows(lists).select(F.input_file_name()).distinct().count() for lists in (None, [0])]
    assert read[1] < read[0] / 5
    plan = held.search(one, 10, probes=2, exact=False)
    assert plan.count() == 10
    few = found(held.search(asked, 3, block_bytes=16 * 8 * 4))
    assert all(few[q][1] == got[q][1] for q in few)


def test_lists_by_asker(spark, tmp_path):
    rows = vectors(spark, np.random.default_rng(2), 600)
    held = clustered.VectorLists.build(rows, str(tmp_path / "lists"), 5)
    asked = rows.where("key % 60 = 0").select(F.col("key").alias("query_id"), "vector", F.lit("").alias("query"))
    k = F.col("query_id")
    asked = access.with_askers(asked.withColumns({"scopes": F.when(k % 120 == 0, F.array(F.lit("internal"))).otherwise(F.array(F.lit("public"))), "as_of": F.when(k % 180 == 0, 20250601).otherwise(20260607)}), ["public"], 20260607)
    want = found(dense.dense_topk(asked, rows, 5))
    assert found(held.search(asked, 5, exact=True)) == want
    got = found(held.search(asked, 5))
    seen = {(q, key) for q, v in want.items() for key, _ in v.values()}
    assert sum((q, key) in seen for q, v in got.items() for key, _ in v.values()) >= 0.9 * len(seen)
    allowed = {r.key: (r.scopes, r.to_day) for r in rows.collect()}
    for r in asked.collect():
        assert all(set(allowed[key][0]) & set(r.allowed) and allowed[key][1] >= r.as_of for key, _ in got.get(r.query_id, {}).values())


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0]), (3, None), (4, []), (5, [1.0, 0.0]), (6, [0.5, 0.5])], "key long, vector array<double>")
    held = clustered.VectorLists.build(rows, str(tmp_path / "lists"), 3)
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    assert [k for k, _ in (found(held.search(asked, 3, exact=True))[9][i] for i in (1, 2, 3))] == [1, 5, 6]
    assert len(found(held.search(asked, 3))[9]) >= 1
    none = clustered.VectorLists.build(rows.limit(0), str(tmp_path / "none"), 3)
    assert none.search(asked, 3).collect() == [] and none.search(asked, 3, exact=True).collect() == []
    with pytest.raises(Exception, match="exists"):
        clustered.VectorLists.build(rows, str(tmp_path / "lists"), 3)
