"""Scalar expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as fx
from ferrule.functions import vectors as vx


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("跨境订单退款多久到账？", "跨境订单退款多久到账 跨境 境订 订单 单退 退款 款多 多久 久到 到账"),
        ("SKU-A17 是否支持无理由退货？", "sku-a17 是否支持无理由退货 是否 否支 支持 持无 无理 理由 由退 退货"),
        ("用户 可以 的", ""),
        ("refund Refund policy", "refund refund policy"),
        ("", ""),
    ],
)
def test_tokenize(spark, text, terms):
    assert value(spark, F.array_join(fx.tokenize("t"), " "), t=text) == terms


@pytest.mark.parametrize(("term", "idx", "bucket"), [("refund", 295, 1263870520), ("退款", 541, 66000651), ("sku-a17", 355, 1454873247)])
def test_hashed_places(spark, term, idx, bucket):
    slot = value(spark, fx.hash_slot("t", 1024), t=term)
    assert (slot.idx, slot.sign) == (idx, 1)
    assert value(spark, fx.sparse_bucket("t"), t=term) == bucket


def test_content_hash_depends_on_identity_and_size(spark):
    h = lambda identity, dims: value(spark, fx.content_hash("t", "i", dims), t="same text", i=identity)
    assert h("local:local-hash-embedding", 1024) == "1e4ebb11c40d865c9f832559c4b5e77ba55b0fb50c85acb98203ccccd80cfe8c"
    assert len({h("local:local-hash-embedding", 1024), h("local:other", 1024), h("local:local-hash-embedding", 256)}) == 3


def test_normalize_clean_and_slugs(spark):
    assert value(spark, fx.normalize_text("t"), t="\r\n a\r\n\r\n\r\n\r\nb\r 　") == "a\n\nb"
    assert value(spark, fx.clean_text("t"), t=" a \n\t b ") == "a b"
    assert value(spark, fx.slugify("t"), t="  Über / x ") == "ber_x"
    assert value(spark, fx.slugify("t"), t="---") == "customer_support"
    assert value(spark, fx.path_slug("t"), t=" a b//c. ") == "a_b_c"


def test_values_and_days(spark):
    assert value(spark, fx.split_values("t"), t=" a, b；a ，c ") == ["a", "b", "c"]
    days = [value(spark, fx.sortable_day("t", 7), t=t) for t in ("2026-06-07", "", "2026/01/31 x", "1-2-3")]
    assert days == [20260607, 7, 20260131, 7]


def test_sentences_and_citations(spark):
    assert value(spark, fx.split_sentences("t"), t="# head\n一。二！ three. four? ") == ["一。", "二！", "three. four?"]
    assert value(spark, fx.citation_ids("t"), t="x [E2] [E10] [E2] [e1] E3") == ["E10", "E2"]


def test_out_of_domain(spark):
    assert value(spark, fx.is_out_of_domain("t"), t="今天北京天气怎么样？")
    assert not value(spark, fx.is_out_of_domain("t"), t="下雨会影响快递吗")
    assert not value(spark, fx.is_out_of_domain("t"), t="hello")


def test_dot_and_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, vx.dot(a, b)) == 11.0
    assert value(spark, vx.dot(a, F.array().cast("array<double>"))) == 0.0
    assert value(spark, vx.cosine(b, b)) == pytest.approx(1.0)
    assert value(spark, vx.cosine(b, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_hash_embeddings_agree_with_weights(spark):
    rows = spark.createDataFrame([("a", ["alpha", "beta", "alpha"]), ("b", [])], "key string, terms array<string>")
    dense = {r.key: r.vector for r in vx.hash_embeddings(rows, "key", "terms", 64).collect()}
    sparse = vx.hashed_weights(rows, "key", dims=64).collect()
    assert len(dense["a"]) == 64 and not any(dense["b"])
    assert {i: v for i, v in enumerate(dense["a"]) if v} == pytest.approx({r.idx: r.weight for r in sparse})
