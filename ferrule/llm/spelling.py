"""Spelling variants: the words within one edit of each word, without ever pairing words up.

A word of length L lies in L wildcard groups, one a position: (position, prefix, suffix), what
is left when the code point at that position goes.  The words of a group differ from each other
in just that place, so a group's size says how many words a member can be replaced by, and its
two best words say which of them is best for any member.  A word that is another one's text
without a code point is found by a join of those texts with the vocabulary.  Counts and best
words of all groups and deletions are added up per word.

A group holds at most one word a letter of the alphabet, so no group grows with the input, and
a word has at most twice its length of links by deletion a letter.  Frequent words are counted
where they lie before anything is shuffled.

Defined results: null and empty texts have no words; a null ``doc_id`` alters no word (its key
is null); rows that repeat count again; ties between near words go to the smaller one in
code-point order; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table

RUN = "[A-Za-zÀ-ÿ]+"
#: Code points and occurrences of a word, and how many times more frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 5, 3, 2
#: One occurrence in so many loses a code point in ``op12_spelling``.
DAMAGED = 97

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; words of other letters take the slower way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at``, counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def runs(documents: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters of every text, in lower case."""
    found = documents.select("doc_id", F.explode_outer(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    return found.where("run IS NOT NULL").select("doc_id", lowered(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counted = words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= occurrences)


def _rank(n: str, word: str) -> Column:
    """Orders words by falling count, then by code points."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def _replacements(words: DataFrame) -> DataFrame:
    """(word, n_near, best): a row for each wildcard group of a word that others share."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    members = words.select("word", "n", at).select("word", "n", "at", without(F.col("word"), F.col("at")).alias("rest"))
    # prefix and suffix: the parts of ``rest`` on both sides of the position
    groups = members.groupBy("at", "rest").agg(F.count("*").alias("size"), F.collect_list(_rank("n", "word")).alias("members"))
    groups = groups.where("size > 1").withColumn("top", F.slice(F.array_sort("members"), 1, 2))
    each = groups.select(F.explode("members.word").alias("word"), "size", "top")
    best = F.when(F.col("word") == F.col("top")[0]["word"], F.col("top")[1]).otherwise(F.col("top")[0])
    return each.select("word", (F.col("size") - 1).alias("n_near"), best.alias("best"))


def _indels(words: DataFrame, length: int) -> DataFrame:
    """(word, n_near, best): a row for each word that is another one without a code point, and for that other one."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    cut = words.where(F.length("word") > length).select("word", "n", at)
    # of a run of one letter only the last is taken out: all of them leave the same text
    last = F.substring(F.col("word"), F.col("at"), F.lit(1)) != F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
    cut = cut.where(last).select("word", "n", without(F.col("word"), F.col("at")).alias("rest"))
    short = words.select(F.col("word").alias("rest"), F.col("n").alias("rest_n"))
    met = cut.join(short, "rest")
    both = F.explode(F.array(F.struct(F.col("word"), _rank("rest_n", "rest").alias("best")), F.struct(F.col("rest").alias("word"), _rank("n", "word").alias("best"))))
    return met.select(both.alias("side")).select("side.word", F.lit(1).cast("long").alias("n_near"), "side.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last, twice as far each step.

    Counts at least double from a word to its form, so there are no circles and few steps.
    """
    steps = materialise(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not steps.where("moved").isEmpty():
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, steps = steps, materialise(moved, "roots")
        discard(last)
    return steps.select("word", "root")


def spelling_variants(words: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = _replacements(words).unionByName(_indels(words, length)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    found = words.join(near, "word", "left")
    frequent = -F.col("best.less") >= times * F.col("n")
    forms = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")
    )
    forms = materialise(forms, "forms")
    discard(words)
    out = forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = found.where(F.length("run") >= LENGTH).select("run", h.alias("h"))  # a shorter run gives no word
    word = F.when(F.col("h") % DAMAGED == 0, without(F.col("run"), (F.col("h") % F.length("run") + 1).cast("int"))).otherwise(F.col("run"))
    return spelling_variants(vocabulary(hashed.select(word.alias("word"))))


OP12_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE len(run) >= 5 GROUP BY ALL),
k AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM c),
h AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i:
      16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295::BIGINT) AS h
  FROM k),
o AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word
  UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 2 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.other_n = b.m) END AS form
  FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root FROM f UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word
"""
