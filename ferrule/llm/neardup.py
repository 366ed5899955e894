"""MinHash near-duplicates: a multi-index Hamming join on b-bit signatures, confirmed on full sets.

A document's set holds its distinct shingles.  Its signature has ``HASHES`` symbols of 16
bits, cut into chunks of four.  Two signatures that differ in fewer than twice as many
symbols as there are chunks differ in at most one symbol of some chunk (pigeonhole), so
each chunk is indexed under its four one-error variants: every pair under the threshold
meets under some key.  At a similarity of 0.8 a pair exceeds the threshold of 23 of 48
symbols with a probability of about 3e-6; less above.

Nothing expands a group into its pairs.  Documents with equal sets are one class.  Keys
name a pivot, their smallest member; keys with the same pivot make one group.  A group is
cut into blocks; a block's task screens signatures and confirms on full sets only what is
not connected yet, and reports a spanning forest of confirmed links.  Groups of several
blocks then get the pairs of blocks in which different components still meet.

Steps that hold texts do so for documents with a candidate partner, once a block.  No list
of documents, links or components reaches the driver.

Defined results: null texts and texts without words have an empty set and no links; rows
with a null ``doc_id`` stay alone (``component_id`` null, kept); rows that repeat an id
share its component, which is linked through any of their texts; ties cannot arise, as components take their smallest id; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_texts, materialise, table

#: Words in a shingle, and the similarity of a link in hundredths.
SHINGLE = 5
SIMILARITY = 80
HASHES = 48
CHUNK = 4
THRESHOLD = 2 * (HASHES // CHUNK) - 1
#: Documents in a block of a group, and shingles of their sets (one document at least).
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: A single text beyond this many bytes is hashed in pieces.
PIECE_BYTES = 4_000_000

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MULTIPLY = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        size = max(n, 1 << 21)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _powers[which] = np.multiply.accumulate(factors)
    return _powers[which][:n]


def _normal(text: str | None) -> bytes:
    """Words with A-Z in lower case, split at blanks and 0x09-0x0D, joined by one blank."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def _hash_words(joined: bytes, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of texts given as words joined by blanks, and each text's number of them."""
    b = np.frombuffer(joined + b" ", np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("up", _BASE, len(b)), out=sums[1:])
    ends = np.flatnonzero(b == 32)
    starts = np.r_[0, ends[:-1] + 1]
    number = np.maximum(counts - size + 1, 1)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    last = np.minimum(at + size - 1, np.repeat(first + counts - 1, number))
    lo, hi = starts[at], ends[last]
    h = (sums[hi] - sums[lo]) * _power("down", _BASE_INVERSE, len(b))[lo]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, number


def shingle_hashes(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The hashes of each text's shingles, in text order; a shorter text's whole sequence is one."""
    normal = [_normal(t) for t in texts]
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    live = [i for i, n in enumerate(normal) if 0 < len(n) <= PIECE_BYTES]
    if live:
        counts = np.array([normal[i].count(b" ") + 1 for i in live])
        h, number = _hash_words(b" ".join(normal[i] for i in live), counts, size)
        for i, part in zip(live, np.split(h, np.cumsum(number)[:-1]), strict=True):
            out[i] = part
    for i, n in enumerate(normal):
        if len(n) > PIECE_BYTES:
            found, step = n.split(b" "), 200_000
            parts = [found[lo : lo + step + size - 1] for lo in range(0, max(1, len(found) - size + 1), step)]
            out[i] = np.concatenate([_hash_words(b" ".join(p), np.array([len(p)]), size)[0] for p in parts])
    return out


def signatures(hashes: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) symbols of 16 bits; texts without shingles get zeros."""
    out = np.zeros((len(hashes), HASHES), np.uint16)
    live = [i for i, h in enumerate(hashes) if len(h)]
    lo = 0
    while lo < len(live):
        hi, total = lo, 0
        while hi < len(live) and (total < 100_000 or hi == lo):
            total += len(hashes[live[hi]])
            hi += 1
        part = live[lo:hi]
        x = (np.concatenate([hashes[i] for i in part]) >> np.uint64(16)).astype(np.uint32)
        offsets = np.r_[0, np.cumsum([len(hashes[i]) for i in part])[:-1]]
        for k in range(HASHES):
            least = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], offsets)
            out[part, k] = (least * np.uint32(2654435769)) >> np.uint32(16)
        lo = hi
    return out


def sketch(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and signature."""

    def make(texts):
        hashes = shingle_hashes(texts, size)
        sets = [np.unique(h) for h in hashes]
        return {
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "signature": [row.tobytes() for row in signatures(sets)],
        }

    added = [("n_shingles", T.LongType()), ("digest", T.BinaryType()), ("signature", T.BinaryType())]
    return map_texts(documents, "text", make, added, keep=["doc_id"])


def variants(symbols: np.ndarray) -> np.ndarray:
    """(rows, HASHES) keys: each chunk without one of its symbols, packed with the place of the one left out."""
    s = symbols.astype(np.int64)
    out = np.empty(s.shape, np.int64)
    for k in range(HASHES):
        a, b, c = [i for i in range(k - k % CHUNK, k - k % CHUNK + CHUNK) if i != k]
        out[:, k] = (k << 48) | (s[:, a] << 32) | (s[:, b] << 16) | s[:, c]
    return out


def _keys(classes: DataFrame) -> DataFrame:
    """A row (key, rep) for each variant of each class."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rep", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)
                rep = np.repeat(part.column(0).to_numpy(), HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(variants(symbols).ravel()), pa.array(rep)], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, schema)


def _parts(rows: DataFrame) -> int:
    """Partitions for steps whose rows are few but dear: a number of its own is not coalesced by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _whole_groups(batches, n_keys: int):
    """Record batches cut at the ends of groups; rows come sorted by the first ``n_keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        ids = [held.column(i).to_numpy() for i in range(n_keys)]
        same = np.logical_and.reduce([c == c[-1] for c in ids])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield held.slice(0, start)
            held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def _group_ids(part, n_keys: int) -> np.ndarray:
    ids = [part.column(i).to_numpy() for i in range(n_keys)]
    new = np.zeros(part.num_rows, bool)
    for c in ids:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _screen(rows: DataFrame, similarity: int) -> DataFrame:
    """The members (g, h, rep, side) of groups that have a partner under the threshold.

    Partners have different components and, in a pair of blocks, different sides.
    Rows at a distance of 1, 2, ... within their group are compared at once for a whole batch.
    """
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("g", "h", "rep", "side", "comp")])

    def run(batches):
        for part in _whole_groups(batches, 2):
            group = _group_ids(part, 2)
            comp, side = part.column("comp").to_numpy(), part.column("side").to_numpy()
            n = part.column("n_shingles").to_numpy()
            symbols = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
            last = np.searchsorted(group, group, side="right") - 1
            live = np.zeros(len(group), bool)
            at, d = np.arange(len(group)), 1
            while len(at := at[at + d <= last[at]]):
                for lo in range(0, len(at), 50_000):
                    a = at[lo : lo + 50_000]
                    b = a + d
                    ok = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] < 0))
                    ok &= 100 * np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
                    ok &= ~(live[a] & live[b])
                    a, b = a[ok], b[ok]
                    near = (symbols[a] != symbols[b]).sum(1) <= THRESHOLD
                    live[a[near]] = True
                    live[b[near]] = True
                d += 1
            if live.any():
                kept = np.flatnonzero(live)
                yield pa.RecordBatch.from_arrays([part.column(c).to_numpy()[kept] for c in out.names], names=out.names)

    columns = ["g", "h", "rep", "side", "comp", "n_shingles", "signature"]
    return rows.select(*columns).repartition(_parts(rows), "g", "h").sortWithinPartitions("g", "h", "rep").mapInArrow(run, out)


def _confirm(members: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Confirmed links (a, b), a spanning forest of each group, from the members' whole texts."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def links(ids, side, comp, whole):
        hashes: list = []
        step, lo = 2_000_000, 0
        while lo < len(whole):
            hi, total = lo, 0
            while hi < len(whole) and (total < step or hi == lo):
                total += len(whole[hi])
                hi += 1
            hashes += shingle_hashes(whole[lo:hi], size)
            lo = hi
        sets = [np.unique(h) for h in hashes]
        n = np.array([len(s) for s in sets])
        symbols = signatures(sets)
        root = np.unique(comp, return_inverse=True)[1]  # component of each member, relabelled as they join
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            ok = (root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]))
            if side[i] >= 0:
                ok &= side[j] != side[i]
            j = j[ok]
            for k in j[(symbols[j] != symbols[i]).sum(1) <= THRESHOLD]:
                if root[k] == root[i]:
                    continue
                common = np.isin(sets[i], sets[k], assume_unique=True).sum()
                if 100 * common >= similarity * (n[i] + n[k] - common):
                    root[root == root[k]] = root[i]
                    yield ids[i], ids[k]

    def run(batches):
        for part in _whole_groups(batches, 2):
            group = _group_ids(part, 2)
            ids, side, comp = (part.column(c).to_numpy() for c in ("rep", "side", "comp"))
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            text = part.column("text")
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                found += links(ids[lo:hi], side[lo:hi], comp[lo:hi], text.slice(lo, hi - lo).to_pylist())
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = members.join(texts, "rep").select("g", "h", "rep", "side", "comp", "text")
    return rows.repartition(_parts(rows), "g", "h").sortWithinPartitions("g", "h", "rep").mapInArrow(run, out)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node reaches.

    Alternates large-star and small-star steps until the edges no longer change; every
    step halves the distances to the smallest node and is written to shared storage.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = materialise(edges, "edges"), None
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    while True:
        now = state(edges)
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        last, edges = edges, materialise(small, "edges")
        discard(last)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _n_blocks(n, weight, block: int) -> F.Column:
    """Blocks of a group of ``n`` documents whose sets hold ``weight`` shingles."""
    n, weight = (F.col(c) if isinstance(c, str) else c for c in (n, weight))
    return F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = materialise(sketch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size), "sketches")
    named = docs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
    )
    classes = materialise(classes, "classes")

    # groups: a pivot and the classes that meet it under some key
    keys = _keys(classes)
    crowded = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot <> top").drop("top")
    crowded = materialise(crowded, "crowded")  # a join of two plain shuffles, so Spark can split a hot key
    stars = keys.join(crowded, "key").where("rep <> pivot").select("pivot", "rep").distinct()
    facts = classes.select("rep", "n_shingles", "signature")
    stars = materialise(stars.join(facts, "rep"), "stars")  # before rows are repeated for pairs of blocks
    heads = stars.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    n_blocks = _n_blocks("n", "weight", block)
    # a written table of its real size: Spark broadcasts it if it is small, else it can split a hot pivot
    several = materialise(heads.where(n_blocks > 1).select("pivot", n_blocks.alias("blocks")), "several")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    placed = stars.join(several, "pivot", "left").select(
        F.col("pivot").alias("g"), F.pmod(F.xxhash64("rep"), blocks).alias("h"), "rep", "n_shingles", "signature", blocks.alias("blocks")
    )
    pivots = heads.select(F.col("pivot").alias("g"), F.col("pivot").alias("rep"), n_blocks.alias("blocks")).join(facts, "rep")
    pivots = pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("h"), "rep", "n_shingles", "signature")
    rows = placed.drop("blocks").unionByName(pivots).withColumns({"side": F.lit(-1).cast("long"), "comp": F.col("rep")})
    members = materialise(_screen(rows, similarity), "members")

    large = materialise(placed.where("blocks > 1"), "large")
    # written, so that its real size decides whether the texts of all documents are shuffled to meet it
    wanted = materialise(members.select("rep").unionByName(large.select("rep")).distinct(), "wanted")
    source = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = materialise(source.join(wanted, "rep"), "texts")
    links = materialise(_confirm(members, texts, size, similarity), "links")
    found = components(links)

    if not large.isEmpty():
        more = materialise(_across_blocks(large, found, texts, size, similarity, block), "links")
        found = components(links.unionByName(more))

    ends = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left")
    ends = materialise(ends.select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    for done in (classes, crowded, stars, several, members, large, wanted, texts, links):
        discard(done)
    out = named.select("doc_id", "n_shingles", "digest").join(ends, "digest").drop("digest")
    alone = docs.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across_blocks(large: DataFrame, found: DataFrame, texts: DataFrame, size: int, similarity: int, block: int) -> DataFrame:
    """Confirmed links between blocks of a group, for members that are not in one component yet.

    A group's most frequent component is settled within itself, so only pairs with a
    member outside it are looked at: blocks of such members (side 0) meet all blocks.
    """
    rows = large.join(found, F.col("rep") == F.col("node"), "left").select("g", "rep", "n_shingles", "signature", F.coalesce("component", "rep").alias("comp"))
    rows = materialise(rows, "large")
    main = rows.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).groupBy("g").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"),
        F.max_by("weight", F.struct("n", "comp")).alias("weight_main"), F.count("*").alias("comps"),
    )
    main = materialise(main.where("comps > 1"), "main")  # a row a large group
    rows = rows.join(main, "g").withColumn("outside", F.col("comp") != F.col("main"))
    n_blocks = _n_blocks("n", "weight", block)
    n_loose = _n_blocks(F.col("n") - F.col("n_main"), F.col("weight") - F.col("weight_main"), block)
    place, loose = F.pmod(F.xxhash64("rep"), n_blocks), F.pmod(F.xxhash64("rep", F.lit(1)), n_loose)
    pair = lambda i, j: i * n_blocks + j
    facts = ["g", "rep", "comp", "n_shingles", "signature"]
    left = rows.where("outside").select(*facts, F.lit(0).cast("long").alias("side"), F.explode(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: pair(loose, j))).alias("h"))
    right = rows.select(*facts, F.lit(1).cast("long").alias("side"), F.explode(F.transform(F.sequence(F.lit(0), n_loose - 1), lambda i: pair(i, place))).alias("h"))
    members = materialise(_screen(left.unionByName(right), similarity), "members")
    return _confirm(members, texts, size, similarity)


def op1_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 3, len(w))], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
