"""Jaccard join, spelling variants and hard negatives against brute force, and their defined results."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import jaccard, negatives, spelling


def joined(rows, similarity=90):
    """(number of shingles, component) by comparing all pairs; rows with one id share a component."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, s in sets:
        for b, t in sets:
            both = len(s & t)
            if both and a != b and 100 * both >= similarity * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(seed=3):
    r = random.Random(seed)
    prose = lambda n, v=300: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    passage = prose(25, 40)
    texts = [prose(r.randrange(1, 80)) for _ in range(60)]
    texts += [prose(4) + " " + passage + " " + prose(r.randrange(0, 4)) for _ in range(40)]
    for base in (prose(60), prose(90), prose(12)):
        for k in range(30):
            words = base.split()
            for _ in range(k % 4):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", " \t ", "one", "one two", "One  TWO", "one two three", texts[5] + "\n", texts[70].upper(), "x y " * 30]
    r.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize(("block", "ranges", "sent"), [(512, 1_024, 4_000_000), (6, 1_024, 500), (512, 3, 2_000)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block, ranges, sent):
    monkeypatch.setattr(jaccard, "LEAST_RANGES", ranges)
    monkeypatch.setattr(jaccard, "MOST_RANGES", ranges)
    monkeypatch.setattr(jaccard, "SENT", sent)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.jaccard_join(docs, block=block).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == joined(rows)
    assert len({c for *_, c in got}) < len(rows) - 30


@pytest.mark.parametrize("similarity", [60, 80, 90, 100])
def test_prefixes_lose_no_pair(spark, monkeypatch, similarity):
    """Prefixes as the operator makes them, with hashes cut so short that shingles share cells."""
    monkeypatch.setattr(jaccard, "SENT", 300)
    cells = jaccard._cells
    monkeypatch.setattr(jaccard, "_cells", lambda hashes: cells(hashes) & np.uint32(0xFFF00000))
    rows = [(i, t) for i, t in near_copies(similarity) if t.split()]
    made = jaccard.sketch(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 3, similarity).collect()
    sets = dict(zip((i for i, _ in rows), jaccard.sets_of([t for _, t in rows], 3), strict=True))
    assert {r.doc_id: r.n_shingles for r in made} == {i: len(s) for i, s in sets.items()}
    prefix = {r.doc_id: np.frombuffer(r.prefix or b"", np.int64) for r in made}
    linked = 0
    for a, x in sets.items():
        for b, y in sets.items():
            both = len(np.intersect1d(x, y))
            if a < b and 100 * both >= similarity * (len(x) + len(y) - both):
                linked += 1
                assert len(np.intersect1d(prefix[a], prefix[b])), (a, b)
                assert jaccard.passing([prefix[a], prefix[b]], np.array([len(x), len(y)]), similarity)[0, 1]
    assert linked > 20


def test_members_of_one_group_pass_alone():
    """Equal prefixes and sizes share their whole prefix, whether or not another group holds any of it."""
    lone, far = np.arange(6), np.arange(100, 106)
    assert jaccard.passing([lone], np.array([100]), 90).all()
    assert jaccard.passing([lone, far], np.array([100, 100]), 90).tolist() == [[True, False], [False, True]]


def test_families_apart_from_all_others_equal_brute_force(spark):
    r, rows = random.Random(1), []
    for f in range(40):
        for _ in range(r.randrange(2, 5)):
            words = [f"b{f}x{i}" for i in range(40 + 4 * f)]
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"u{r.random()}"
            rows.append((len(rows) + 1, " ".join(words)))
    got = sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == joined(rows)


def test_jaccard_join_of_odd_rows(spark):
    long = " ".join(f"wörd{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, ""), (4, long), (5, long + " end"), (7, "a b c d e f g"), (7, "a b c d e f g"), (7, long), (9, "A b C d e f g"), (9, "p q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "prefix", "rep", "g", "h", "n_shingles", "component_id")})
    got = sorted(map(tuple, jaccard.jaccard_join(docs).collect()), key=str)
    # 7 repeats with two texts, so it joins the short copies with the long ones
    assert {(i, c) for i, _, c in got} == {(1, 1), (None, None), (2, 2), (3, 3), (4, 1), (5, 1), (7, 1), (9, 1)}
    assert len(got) == len(rows) and {n for i, n, _ in got if i in (2, 3)} == {0}
    assert jaccard.jaccard_join(docs.limit(0)).collect() == []


def varied(docs, length=5, occurrences=3, times=2, damaged=97):
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{i}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1 :] if i is not None and h % damaged == 0 else run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= occurrences}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and apart(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def test_spelling_variants_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(4, 8))) for _ in range(160)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Éaaaaa", "éaaaaa", "naïve×x", "ÀÿÀÿÀ"]
    docs = [(i, " ".join(r.choice(words[: r.randrange(2, len(words))]) + r.choice([" ", ", ", "1", "\n"]) for _ in range(r.randrange(200)))) for i in range(60)]
    docs += [(None, docs[0][1]), (3, docs[3][1]), (61, None), (62, ""), (63, "AAAAA aaaaab " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("run", "word", "n", "at", "rest", "best")})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, spelling.op12_spelling(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda x: x[0])
    want = varied(docs)
    assert got == want and sum(f is not None for _, f, *_ in want) > 20 and any(f and f != root for _, f, root, *_ in want)
    frame.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert spelling.op12_spelling(spark, str(tmp_path / "none")).collect() == []


def test_code_points_beyond_the_basic_plane(spark):
    words = [("\U0001f600abcd", 9), ("\U0001f601abcd", 4), ("\U0001f600abcde", 3), ("zzzzz", 3)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    a = words[0][0]
    assert got == {a: (None, a, 2), words[1][0]: (a, a, 1), words[2][0]: (a, a, 1), "zzzzz": (None, "zzzzz", 0)}


def mined(rows):
    """All products in whole numbers."""
    e = sorted({(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, label, x in (a for a in e if a[0] % 50 == 0):
        scores = sorted({(-sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for j, other, y in e if j != i and len(y) == len(x)})
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            found = [(-s, j) for s, j, same in scores if not same and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, positive, k, j, -p, s) for k, (s, j) in enumerate(found, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("anchor_bytes", "seed"), [(16_000_000, 1), (400, 2)])
def test_hard_negatives_equal_brute_force(spark, anchor_bytes, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, 12))
    rows = [(i, i % 4, (centre[i % 4] * r.random() + r.normal(size=12) * (0.6 if i % 5 else 0.0)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, 1, rows[8][2]) for i in range(400, 520)]  # one vector with many ids
    rows += [(50, 2, r.normal(size=12).tolist()), rows[100], rows[7], rows[7]]  # an anchor's id twice, repeated rows
    rows += [(600, None, rows[0][2]), (None, 1, rows[0][2]), (650, 1, None), (700, 1, [None] * 12), (750, 1, [float("nan")] * 12), (800, 1, [float("inf")] + [0.0] * 11), (850, 1, [0.0] * 12)]
    rows += [(900, 1, [1.0, 0.5]), (901, 1, [1.0, 0.25]), (902, 2, [0.5, 0.5]), (950, 3, []), (951, 3, []), (952, 1, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("clash") for c in ("a", "x", "score", "rank", "asked")})
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = sorted(tuple(x) for x in negatives.hard_negatives(vectors.repartition(4), F.col("vec_id") % 50 == 0, anchor_bytes=anchor_bytes).select(*COLUMNS).collect())
    want = mined(rows)
    assert got == want and len(want) > 60
    assert negatives.hard_negatives(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_hold_every_product():
    r = np.random.default_rng(4)
    for width in (1, 3, 16, 40):
        x = np.floor(256 * r.normal(size=(300, width)) * r.random((300, 1)) ** 3 * 4).astype(np.int64)
        turn = negatives.rotation_of(x[:40])
        side = negatives.Side(np.arange(300), np.zeros(300, np.int64), x, turn)
        exact = x @ x.T
        for k, cut in enumerate(negatives.cuts_of(width)):
            partial = sum(side.parts[i] @ side.parts[i].T for i in range(k + 1))
            reach = np.outer(side.rest[k], side.rest[k]) + side.slack * np.outer(side.norm, side.norm) + 1e-3
            assert (np.abs(exact - partial) <= reach).all(), (width, cut)
