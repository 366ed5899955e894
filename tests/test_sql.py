"""SQL functions against the expressions they stand for."""

from pyspark.sql import functions as F

from ferrule.functions import sql
from ferrule.functions import text as fx
from ferrule.operators import access, chunking

TEXTS = [
    "跨境订单退款多久到账？ SKU-A17 用户 可以", "Refund Policy\r\n\r\n\r\n\r\nwithin 7 days\rof parcel\n", "", None, " \t　 ", "## One\ntext\n## Two\n\nmore", "intro\n## One", "a" * 700,
    "\n\n".join(f"paragraph {i} " + "word " * (i * 7 % 30) for i in range(25)), "x\n\n" + "y" * 300 + "\n\nz", "public, internal；partner　x", "2026-06-07", "2026/1/1",
]


def test_functions_equal_the_expressions(spark):
    names = sql.register(spark)
    assert set(names) >= {"visible_to", "access_reason", "terms_of", "chunks_of", "sections_of"} and sql.register(spark) == names
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, x string")
    pairs = {
        "strip_text(x)": fx.strip("x"), "normalized_text(x)": fx.normalize_text("x"), "token_count(x)": fx.token_count("x"), "split_scopes(x)": fx.split_values("x"),
        "sortable_day(x, 5)": fx.sortable_day("x", 5), "terms_of(x)": fx.tokenize("x"),
    }
    got = spark.sql(f"SELECT {', '.join(f'{call} AS c{k}' for k, call in enumerate(pairs))} FROM {{rows}} ORDER BY i", rows=rows).collect()
    want = rows.orderBy("i").select(*[c.alias(f"c{k}") for k, c in enumerate(pairs.values())]).collect()
    assert got == want
    for chars, overlap in ((40, 10), (280, 60)):
        made = spark.sql("SELECT r.i, c.chunk_no, c.chunk FROM {rows} r, LATERAL chunks_of(r.x, %d, %d, '\\n\\n') c" % (chars, overlap), rows=rows)
        plain = rows.select("i", F.posexplode(chunking.pack(chunking.paragraphs(F.col("x")), chars, overlap)))
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    sections = spark.sql("SELECT r.i, s.section_no, normalized_text(s.section) FROM {rows} r, LATERAL sections_of(r.x) s", rows=rows)
    plain = chunking.split_sections(rows.select(F.col("i").alias("doc_id"), F.lit("t").alias("title"), F.col("x").alias("body"))).select("doc_id", "section_no", "text")
    assert sorted(map(tuple, sections.collect())) == sorted(map(tuple, plain.collect()))


def test_access_functions(spark):
    sql.register(spark)
    rows = [(i, scope, start, end) for i, (scope, start, end) in enumerate((s, a, b) for s in ("public", "x; public", "", None) for a in ("", "2027-01-01") for b in ("", "2026-01-31"))]
    df = spark.createDataFrame(rows, "i long, permission_scope string, effective_from string, effective_to string")
    call = "permission_scope, effective_from, effective_to, array('public'), 20260607"
    got = spark.sql(f"SELECT i, access_reason({call}) AS reason, visible_to({call}) AS seen FROM {{df}} ORDER BY i", df=df).collect()
    want = access.with_access_columns(df).orderBy("i").select("i", access.reason(["public"], 20260607).alias("reason"), access.visible(["public"], 20260607).alias("seen")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and {r.reason for r in got} == {None, "permission_scope", "not_yet_effective", "expired"}
    pushed = spark.sql(f"SELECT i FROM {{df}} WHERE visible_to({call})", df=df)._jdf.queryExecution().optimizedPlan().toString()
    assert "visible_to" not in pushed and "arrays_overlap" in pushed  # replaced by its body
