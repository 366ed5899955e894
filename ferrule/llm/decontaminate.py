"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words of the benchmark are numbered, and patterns are windows of consecutive numbers, held as
places in the benchmark.  A hashed table of shifts, keyed by blocks of two words, says how far
the search may move on (blocks that share a cell take the smaller shift); where the shift is
zero the hash of the block and of the pattern's first word names the few patterns that are
then compared word by word.  Patterns of one length share a set of tables, so a short item
never shortens the shifts of the others.  All tables are arrays of whole numbers, built once
on the driver from a slice of the benchmark of a bounded size: some 8 times its bytes.

Defined results: null and empty texts have no words, no hits and no items; null item
texts and items without words are no patterns; rows with a null ``item_id`` mark hits
but name no item; repeated documents are judged row by row; an empty benchmark
contaminates nothing; extra columns of either table are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

WINDOW = 10
#: Benchmark bytes searched for in one pass; a larger benchmark takes several chained passes.
SLICE_BENCHMARK_BYTES = 8_000_000

#: A-Z to lower case; all bytes that are no word bytes to blanks.  Bytes from 0x80 on
#: belong to words, so UTF-8 needs no decoding.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Numbered:
    """Words of several texts as one row of numbers (0: a word the benchmark lacks), and each word's text."""

    def __init__(self, texts: list[list[bytes]], number: dict[bytes, int]):
        self.counts = np.array([len(t) for t in texts], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.uint32)] + [np.fromiter(map(number.get, t, repeat(0)), np.uint32, len(t)) for t in texts])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.bytes = self.ids.tobytes()

    def blocks(self, size: int) -> np.ndarray:
        """The hash of the block of ``size`` words that ends at each word."""
        ids = self.ids.astype(np.uint64)
        if size == 1 or not len(ids):
            return _mixed(ids)
        ids[1:] += ids[:-1] * np.uint64(1 << 32)
        return _mixed(ids)


class WuManber:
    """Tables for the windows of one length, in words, of some benchmark items."""

    def __init__(self, length: int, bench: Numbered, windows: np.ndarray):
        """``windows``: the first word of each window."""
        self.length, self.block = length, min(2, length)
        default = length - self.block + 1
        self.shift = np.full(1 << max(10, int(2 * len(windows)).bit_length()), default, np.uint8)
        blocks = bench.blocks(self.block)
        for end in range(self.block, length + 1):  # the last written, and so the smallest, shift stays
            self.shift[self._cell(blocks[windows + end - 1])] = length - end
        key, whole = self._key(blocks, bench.ids, windows), np.zeros(len(windows), np.uint64)
        for k in range(length):
            whole = _mixed(whole * _NEXT + bench.ids[windows + k])
        order = np.lexsort((windows, whole, key))
        key, whole, windows = key[order], whole[order], windows[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
        self.keys, self.first = key[new], windows[new].astype(np.int32)
        items, window = bench.owner[windows], np.cumsum(new) - 1
        own = np.r_[True, (items[1:] != items[:-1]) | new[1:]]
        self.items, self.item_from = items[own], np.searchsorted(window[own], np.arange(len(self.keys) + 1)).astype(np.int32)

    def _cell(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64(len(self.shift) - 1)).astype(np.int64)

    def _key(self, blocks: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The bucket of a window: its last block and its first word."""
        return _mixed(blocks[starts + self.length - 1] * _NEXT + ids[starts])

    def _ends(self, steps: bytes) -> list[int]:
        """Words at which a window may end; shifts skip the others."""
        out, end, n = [], self.length - 1, len(steps)
        while end < n:
            step = steps[end]
            if step:
                end += step
            else:
                out.append(end)
                end += 1
        return out

    def search(self, text: Numbered, pattern_bytes: bytes):
        """(first words, windows): where in ``text`` which windows occur."""
        blocks, size = text.blocks(self.block), 4 * self.length
        starts = np.array(self._ends(self.shift[self._cell(blocks)].tobytes()), np.int64) - (self.length - 1)
        starts = starts[text.owner[starts] == text.owner[starts + self.length - 1]]
        key = self._key(blocks, text.ids, starts)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        for k in np.flatnonzero(hi > lo):
            at = int(starts[k])
            told = text.bytes[4 * at : 4 * at + size]
            for w in range(lo[k], hi[k]):
                if told == pattern_bytes[4 * int(self.first[w]) : 4 * int(self.first[w]) + size]:
                    yield at, w


class Tables:
    """A slice of the benchmark: its items' names, its words, and tables for each length of window."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        found = [words(text) for _, text in rows]
        self.number = {w: k for k, w in enumerate(sorted({w for f in found for w in f}), 1)}
        bench = Numbered(found, self.number)
        self.names, self.bytes = [None if item is None else str(item) for item, _ in rows], bench.bytes
        lengths, first = np.minimum(bench.counts, window), np.cumsum(bench.counts) - bench.counts
        self.searchers = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            n = bench.counts[own] - length + 1
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.searchers.append(WuManber(length, bench, at))

    def size(self) -> int:
        """Bytes of the tables."""
        arrays = [a for s in self.searchers for a in vars(s).values() if isinstance(a, np.ndarray)]
        return len(self.bytes) + sum(a.nbytes for a in arrays) + sys.getsizeof(self.number) + sum(map(sys.getsizeof, self.number))

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
        """Each text's number of words, a byte a word (1 if hit), and the names of the items found, sorted."""
        text = Numbered([words(t) for t in texts], self.number)
        edges = np.zeros(len(text.ids) + 1, np.int32)
        found: list[set] = [set() for _ in texts]
        for s in self.searchers if len(text.ids) else ():
            for at, w in s.search(text, self.bytes):
                edges[at] += 1
                edges[at + s.length] -= 1
                found[text.owner[at]].update(s.items[s.item_from[w] : s.item_from[w + 1]].tolist())
        hits = (np.cumsum(edges[:-1]) > 0).astype(np.uint8).tobytes()
        ends = np.cumsum(text.counts)
        named = [sorted({self.names[i] for i in f} - {None}) for f in found]
        return text.counts, [hits[e - n : e] for e, n in zip(ends.tolist(), text.counts.tolist(), strict=True)], named


def _benchmark_slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in slices of a bounded size, each small enough to ship to every executor.

    One is fetched when it is asked for, so the driver holds one at a time; equal rows count once.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    rows = rows.where("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    key = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r.i, r.t) for r in (rows if n == 1 else rows.where(key == k)).collect()]


def _either(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") | int.from_bytes(b, "big")).to_bytes(len(a), "big")


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slice_bytes: int = SLICE_BENCHMARK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with ``n_words``, ``hits`` (a byte per word, 1 if hit) and ``items`` (ids, sorted).

    The documents are scanned once, without a shuffle; each slice of the benchmark adds
    one chained pass over the rows in flight.
    """
    spark = documents.sparkSession
    added = [("n_words", T.LongType()), ("hits", T.BinaryType()), ("items", T.ArrayType(T.StringType()))]
    out = None
    for part in _benchmark_slices(benchmark, slice_bytes):
        shipped = spark.sparkContext.broadcast(Tables(part, window))

        def make(texts, shipped=shipped):
            counts, hits, items = shipped.value.search(texts)
            return {"n_words": counts.tolist(), "hits": hits, "items": items}

        if out is None:
            out = map_texts(documents, "text", make, added, keep=list(dict.fromkeys([*(keep or documents.columns), "text"])))
        else:
            more = out.withColumnsRenamed({"hits": "__hits", "items": "__items"})
            more = map_texts(more, "text", make, added)
            merged = F.udf(_either, T.BinaryType(), useArrow=True)
            out = more.withColumn("hits", merged("hits", "__hits")).withColumn(
                "items", F.array_sort(F.array_union("items", "__items"))
            ).drop("__hits", "__items")
    return out if keep is None or "text" in keep else out.drop("text")


def n_hit(hits: str = "hits") -> F.Column:
    """How many words of a document are hit: the bytes of ``hits`` that are not 0."""
    return F.length(F.replace(F.decode(F.col(hits), "ISO-8859-1"), F.lit("\x00"), F.lit(""))).cast("long")


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    """Per document: words, words hit, items found, their digest and the verdict."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i
             FROM d, (SELECT DISTINCT n FROM bl))),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
