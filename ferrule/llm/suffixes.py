"""Repeated passages across documents: one doubling of ranks over positions sampled by content.

This stands in place of full prefix doubling.  A position is ranked by its first ``GRAM``
bytes, and the ranks of two positions an offset apart name the longer string that both cover,
``length`` bytes long, the threshold.  Ranking every byte would move many times the input
through each sort, so positions are sampled by content: of the strings of ``GRAM`` bytes
inside any ``length`` bytes, the one with the smallest rank is its anchor.  Equal strings of
``length`` bytes have the same anchor at the same offset, so no repeat escapes.

1. Anchors are dealt out by rank and sorted; ranks that occur in one text only are unique
   and leave (a bitmap a text and bucket says which anchors stay).
2. The strings around the anchors that stay are dealt out by rank and ranked again by pairs
   of ranks an offset apart; pairs are sorted within the class of their anchor, and a
   string whose smallest document is smaller than its own is a repeat.
   Ranks that occur very often are left out of both steps: their strings are rows of their
   own, whose smallest document is found by an aggregation that combines before it shuffles,
   so no class has to fit a task.
3. The runs of repeated strings go back to their documents, which drop the bytes covered.

Spark deals and sorts by bucket of ranks, one bucket a partition, and their number grows with
the input; within a bucket ranks are sorted in numpy.  Ranks are 64-bit hashes, named in
place of sort positions, so a rank is the same in every task.

Texts that equal a text of a smaller document are repeats as a whole and take no part in
2.  All steps stream over bounded buckets; texts are shuffled by document, never gathered.

Defined results: a null text is an empty one; texts shorter than ``length`` bytes lose and
lend nothing; rows with a null ``doc_id`` lose and lend nothing; rows that repeat an id do
not repeat each other (no smaller id), and each row's text is judged by itself; positions
are judged on the input; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_texts, materialise, slices, table

LENGTH = 50
GRAM = 26
#: Bytes of text whose anchors share a bucket, on average, and the least number of buckets; a bucket is a partition.
BUCKET_BYTES, LEAST_BUCKETS = 16_000_000, 32
#: Bytes of text a task works on at once, and bytes whose anchors it deals out together.
SLICE, DEAL = 400_000, 4_000_000
#: A rank that is estimated to occur so often is too large a class for one task.  The estimate
#: counts every text beyond ``HUGE_BYTES`` and a sample of the others, and equal texts once; the
#: list of such ranks has a bound (the rest is ranked as usual).
FREQUENT, SAMPLE, HUGE_BYTES, MOST_FREQUENT = 500_000, 64, 1_000_000, 20_000
#: Strings of ``length`` bytes ranked at once within a bucket; a larger class takes two passes.
RANK_ROWS = 80_000

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        factors = np.full(max(n, 1 << 19), base, np.uint64)
        factors[0] = 1
        _powers[which] = np.multiply.accumulate(factors)
    return _powers[which][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes of ``b``."""
    if len(b) < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("up", _BASE, len(b)), out=sums[1:])
    h = sums[size:] - sums[:-size]
    h *= _power("down", _BASE_INVERSE, len(b))[: len(h)]
    return _mixed(h)


def anchors(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Anchors of the texts ``b[starts:ends]``: (position, rank, first string, last string).

    ``first`` and ``last`` bound the starts of the strings that have the anchor.
    """
    width = length - GRAM + 1
    h = gram_hashes(b, GRAM)
    if len(h) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    place = np.uint64(2**32 - 1)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # strings that lie within one text
    edge = np.zeros(len(least) + 1, np.int32)
    fits = ends - starts >= length
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, ends[fits] - length + 1, -1)
    strings = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = (least[strings] & place).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (strings[1:] != strings[:-1] + 1)] if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(at)] - 1 if len(heads) else heads
    position = at[heads]
    return position, h[position], strings[heads], strings[tails]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def _bucket(rank: np.ndarray, n: int) -> np.ndarray:
    return ((rank >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _text_slices(batches, column: int):
    """(record batch, texts as bytes) of bounded size."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for lo, hi in slices(sizes, SLICE):
            part = batch.slice(lo, hi - lo)
            yield part, [t or b"" for t in part.column(column).cast(pa.large_binary()).to_pylist()]


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _rows_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _summaries(documents: DataFrame) -> DataFrame:
    """doc_id, mark, digest and size of every text."""

    def make(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return {"digest": [_digest(t) for t in raw], "n_bytes": [len(t) for t in raw]}

    return map_texts(documents, "text", make, [("digest", T.BinaryType()), ("n_bytes", T.LongType())], keep=["doc_id", "mark"])


_PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("packed", T.BinaryType())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each preceded by its length in bytes."""
    raw = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def _unpack(packed: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(packed[:-8], int.from_bytes(packed[-8:], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _by_bucket(batches):
    """(bucket, packed values) of rows that come sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(packed)
    if held:
        yield bucket, held


def doubled(b: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all strings of ``length`` bytes of ``b``: pairs of ranks at growing offsets, from ``GRAM`` bytes on."""
    size = min(GRAM, length)
    rank = gram_hashes(b, size)
    while size < length and len(rank):
        step = min(size, length - size)
        rank = _mixed(rank[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + rank[step:])
        size += step
    return rank


_LONGS = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
#: A text's rows are told apart by its document and by a hash of the text.
_OWNER = ("doc_id", "mark")


def _frequent_ranks(documents: DataFrame, length: int, least: int, sample: int = SAMPLE) -> np.ndarray:
    """Ranks of anchors that occur about ``least`` times or more, equal texts counted once; sorted."""
    rate = sample if least >= 100 * sample else 1
    size = F.octet_length("text")
    drawn = (size > HUGE_BYTES) | (F.pmod(F.col("mark"), F.lit(rate)) == 0)
    rows = documents.where(drawn).withColumn("weight", F.when(size > HUGE_BYTES, F.lit(1)).otherwise(F.lit(rate)).cast("long"))
    schema = _LONGS("rank", "mark", "n")

    def list_ranks(batches):
        for part, texts in _text_slices(batches, 2):
            position, rank, _, _ = anchors(*_joined(texts), length)
            doc = np.searchsorted(np.cumsum([len(t) for t in texts]), position, side="right")
            held, n = np.unique(np.c_[rank.astype(np.int64), doc], axis=0, return_counts=True)
            mark, weight = part.column(1).to_numpy()[held[:, 1]], part.column(3).to_numpy()[held[:, 1]]
            yield _rows_of(schema, [pa.array(held[:, 0]), pa.array(mark), pa.array(n * weight)])

    counts = rows.mapInArrow(list_ranks, schema).groupBy("rank", "mark").agg(F.max("n").alias("n"))
    counts = counts.groupBy("rank").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "rank").limit(MOST_FREQUENT)
    return np.sort(np.array([r["rank"] for r in found.select("rank").collect()], np.int64).astype(np.uint64))


_RUNS = T.StructType([*_LONGS(*_OWNER).fields, T.StructField("runs", T.BinaryType())])


def _packed_runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row of runs for each text among the (start, end) given."""
    order = np.lexsort((start, mark, doc))
    doc, mark, pairs = doc[order], mark[order], np.c_[start, end][order].astype(np.uint64)
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])) + 1
    heads = np.r_[0, cuts]
    return _rows_of(_RUNS, [pa.array(doc[heads]), pa.array(mark[heads]), pa.array([p.tobytes() for p in np.split(pairs, cuts)], pa.binary())])


def _frequent_repeats(documents: DataFrame, frequent: np.ndarray, length: int) -> DataFrame:
    """(doc_id, mark, runs) of the strings whose anchors have frequent ranks."""
    schema = _LONGS("pair", "rank", *_OWNER, "start")

    def strings(batches):
        for part, texts in _text_slices(batches, 2):
            b, starts, ends = _joined(texts)
            position, rank, first, last = anchors(b, starts, ends, length)
            own = np.flatnonzero(np.isin(rank, frequent))
            if not len(own):
                continue
            number = last[own] - first[own] + 1
            at = np.repeat(first[own] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            doc = np.repeat(np.searchsorted(ends, position[own], side="right"), number)
            pair, rank = doubled(b, length)[at].astype(np.int64), np.repeat(rank[own], number).astype(np.int64)
            columns = [pair, rank, part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], at - starts[doc]]
            yield _rows_of(schema, [pa.array(c) for c in columns])

    rows = documents.select(*_OWNER, "text").mapInArrow(strings, schema)
    first = rows.groupBy("pair", "rank").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    first = materialise(first.drop("most"), "first")  # a join of two plain shuffles, so Spark can split a hot pair
    repeats = rows.join(first, ["pair", "rank"]).where("doc_id > least").select(*_OWNER, "start")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                doc, mark, start = (batch.column(i).to_numpy() for i in range(3))
                yield _packed_runs(doc, mark, start, start + length)

    return repeats.mapInArrow(pack, _RUNS)


def _dealt(batches, column: int, places):
    """(bucket, packed) rows of what ``places(part, texts)`` finds, a bounded number of bytes at a time.

    ``places`` gives the bucket of each find and a function that packs chosen finds' arrays;
    finds of several slices of text share a row, so rows stay few.
    """
    held, size = [], 0

    def flush():
        buckets = np.unique(np.concatenate([h[0][h[1]] for h in held])) if held else []
        names, blobs, reach = [], [], [0] * len(held)
        for bucket in buckets:
            parts = []
            for k, (found, order, pack) in enumerate(held):
                lo = reach[k]
                hi = int(np.searchsorted(found[order], bucket, side="right")) if lo < len(order) else lo
                if hi > lo:
                    parts.append(pack(order[lo:hi]))
                    reach[k] = hi
            names.append(int(bucket))
            blobs.append(_pack(*[np.concatenate(c) for c in zip(*parts, strict=True)]))
        held.clear()
        return _rows_of(_PACKED, [pa.array(names, pa.int64()), pa.array(blobs, pa.binary())])

    for part, texts in _text_slices(batches, column):
        found, pack = places(part, texts)
        if len(found):
            held.append((found, np.argsort(found, kind="stable"), pack))
        size += sum(map(len, texts))
        if size >= DEAL:
            yield flush()
            size = 0
    if held:
        yield flush()


def _sorted_buckets(dealt: DataFrame, n_buckets: int) -> DataFrame:
    """A bucket a partition, sorted by Spark."""
    return dealt.repartitionById(n_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")


def _repeated_anchors(documents: DataFrame, frequent: np.ndarray, n_buckets: int, length: int) -> DataFrame:
    """(doc_id, mark, bucket, bits): which of a text's anchors in a bucket have ranks that other texts have too."""

    def places(part, texts):
        ids, marks = part.column(0).to_numpy(), part.column(1).to_numpy()
        position, rank, _, _ = anchors(*_joined(texts), length)
        usual = ~np.isin(rank, frequent)
        position, rank = position[usual], rank[usual]
        doc = np.searchsorted(np.cumsum([len(t) for t in texts]), position, side="right")

        def pack(at):
            own, counts = np.unique(doc[at], return_counts=True)
            return ids[own], marks[own], counts.astype(np.uint32), rank[at].astype(np.uint32)

        return _bucket(rank, n_buckets), pack

    out = T.StructType([*_LONGS(*_OWNER, "bucket").fields, T.StructField("bits", T.BinaryType())])

    def sift(batches):
        for bucket, blobs in _by_bucket(batches):
            parts = [_unpack(b, [np.int64, np.int64, np.uint32, np.uint32]) for b in blobs]
            ids, marks, counts, rank = (np.concatenate([p[i] for p in parts]) for i in range(4))
            counts = counts.astype(np.int64)
            order = np.argsort(rank, kind="stable")
            sorted_rank = rank[order]
            mark = np.repeat(marks, counts)[order]
            heads = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
            shared = np.minimum.reduceat(mark, heads) != np.maximum.reduceat(mark, heads)
            stays = np.zeros(len(rank), bool)
            stays[order] = np.repeat(shared, np.diff(np.r_[heads, len(rank)]))
            cuts = np.cumsum(counts) - counts
            some = np.flatnonzero(np.add.reduceat(stays.astype(np.int64), cuts))
            for lo in range(0, len(some), 10_000):
                rows = some[lo : lo + 10_000]
                bits = [np.packbits(stays[cuts[i] : cuts[i] + counts[i]]).tobytes() for i in rows]
                yield _rows_of(out, [pa.array(ids[rows]), pa.array(marks[rows]), pa.array(np.full(len(rows), bucket)), pa.array(bits, pa.binary())])

    dealt = documents.mapInArrow(lambda batches: _dealt(batches, 2, places), _PACKED)
    return _sorted_buckets(dealt, n_buckets).mapInArrow(sift, out)


def _repeats(texts: DataFrame, frequent: np.ndarray, n_buckets: int, length: int) -> DataFrame:
    """(doc_id, mark, runs): starts and ends of runs of strings that a smaller document has."""

    def places(part, whole):
        ids, marks = part.column(0).to_numpy(), part.column(1).to_numpy()
        stays = part.column(3).to_pylist()
        b, starts, ends = _joined(whole)
        position, rank, first, last = anchors(b, starts, ends, length)
        usual = ~np.isin(rank, frequent)
        position, rank, first, last = position[usual], rank[usual], first[usual], last[usual]
        doc = np.searchsorted(ends, position, side="right")
        bucket = _bucket(rank, n_buckets)
        keep = np.zeros(len(position), bool)
        cuts = np.searchsorted(doc, np.arange(len(whole) + 1))
        for k, found in enumerate(stays):
            own = bucket[cuts[k] : cuts[k + 1]]
            for row in found:
                at = np.flatnonzero(own == row["bucket"])
                keep[cuts[k] + at] |= np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: len(at)].astype(bool)
        live = np.flatnonzero(keep)

        def pack(chosen):
            own = live[chosen]
            size = last[own] + length - first[own]
            where = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            begin = (first[own] - starts[doc[own]]).astype(np.int64)
            return ids[doc[own]], marks[doc[own]], begin, size.astype(np.int64), rank[own], b[where]

        return bucket[live], pack

    def pairs_of(first, size, rank, raw):
        """Each string's rank, entry and start."""
        number = size - length + 1
        begin = np.cumsum(size) - size
        at = np.repeat(begin - (np.cumsum(number) - number), number) + np.arange(number.sum())
        pair = doubled(raw, length)[at]
        pair ^= _mixed(np.repeat(rank, number))
        start = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
        return pair, np.repeat(np.arange(len(first)), number), start

    def least_of(pair, doc):
        """The distinct ranks, sorted, and the smallest document of each."""
        order = np.argsort(pair, kind="stable")
        heads = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
        return pair[order][heads], np.minimum.reduceat(doc[order], heads)

    def runs_of(ids, marks, pair, block, start, known):
        """(doc_id, mark, start, end) of the runs of strings whose smallest document is smaller than their own."""
        hit = np.flatnonzero(ids[block] > known[1][np.searchsorted(known[0], pair)])
        if not len(hit):
            return None
        new = np.r_[True, (np.diff(hit) > 1) | (block[hit][1:] != block[hit][:-1])]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(hit)] - 1
        own = block[hit[heads]]
        return ids[own], marks[own], start[hit[heads]], start[hit[tails]] + length

    def sift(batches):
        for _, blobs in _by_bucket(batches):
            parts = [_unpack(b, [np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint8]) for b in blobs]
            ids, marks, first, size, rank, raw = (np.concatenate([p[i] for p in parts]) for i in range(6))
            del parts
            order = np.argsort(rank, kind="stable")
            begin = np.cumsum(size) - size
            heads = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
            total = np.cumsum(size[order] - length + 1)

            def strings(own):
                where = np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(size[own].sum())
                return pairs_of(first[own], size[own], rank[own], raw[where])

            def ranked(own):
                pair, block, start = strings(own)
                return runs_of(ids[own], marks[own], pair, block, start, least_of(pair, ids[own][block]))

            def ranked_in_pieces(own):
                pieces = np.array_split(own, -(-int((size[own] - length + 1).sum()) // RANK_ROWS))
                known = []
                for piece in pieces:
                    pair, block, _ = strings(piece)
                    known.append(least_of(pair, ids[piece][block]))
                known = least_of(*(np.concatenate([k[i] for k in known]) for i in range(2)))
                for piece in pieces:
                    yield runs_of(ids[piece], marks[piece], *strings(piece), known)

            found, lo = [], 0
            while lo < len(order):
                done = total[lo - 1] if lo else 0
                hi = int(np.searchsorted(total, done + RANK_ROWS, side="right"))
                later = heads[heads > lo]
                cut = later[later <= hi]
                hi = int(cut[-1]) if len(cut) else (int(later[0]) if len(later) else len(order))
                if total[-1] - done <= RANK_ROWS:
                    hi = len(order)
                own = order[lo:hi]
                found += ranked_in_pieces(own) if total[hi - 1] - done > 2 * RANK_ROWS else [ranked(own)]
                lo = hi
            found = [f for f in found if f is not None]
            if found:
                yield _packed_runs(*(np.concatenate([f[i] for f in found]) for i in range(4)))

    dealt = texts.mapInArrow(lambda batches: _dealt(batches, 2, places), _PACKED)
    return _sorted_buckets(dealt, n_buckets).mapInArrow(sift, _RUNS)


def merged(runs: list[bytes]) -> np.ndarray:
    """(n, 2) maximal runs, in order, of pairs given as bytes."""
    pairs = np.frombuffer(b"".join(runs), np.uint64).astype(np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    heads = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.c_[pairs[heads, 0], reach[np.r_[heads[1:], len(pairs)] - 1]]


def repeated_passages(documents: DataFrame, length: int = LENGTH, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Documents (doc_id, mark, text), their runs of repeats (doc_id, mark, runs: unordered pairs of
    offsets in bytes), those that equal a smaller document's text (doc_id, mark, digest), and the
    written tables behind these, which the caller discards."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    sums = materialise(_summaries(docs.where("doc_id IS NOT NULL")), "texts")
    total = sums.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = int(max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)))
    long_ones = sums.where(F.col("n_bytes") >= length)
    first = long_ones.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = materialise(first.drop("last"), "first")  # a join of two plain shuffles, so Spark can split a hot digest
    copies = long_ones.join(first, "digest").where("doc_id > first").select(*_OWNER, "digest").distinct()

    named = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    often = _frequent_ranks(named, length, frequent)
    stays = _repeated_anchors(named, often, n_buckets, length)
    stays = stays.join(copies.select(*_OWNER), list(_OWNER), "left_anti")
    stays = stays.groupBy(*_OWNER).agg(F.collect_list(F.struct("bucket", "bits")).alias("stays"))
    stays = materialise(stays, "anchors")
    runs = _repeats(named.join(stays, list(_OWNER)).select(*_OWNER, "text", "stays"), often, n_buckets, length)
    if len(often):
        runs = runs.unionByName(_frequent_repeats(named.join(copies.select(*_OWNER), list(_OWNER), "left_anti"), often, length))
    return docs, runs, copies, [sums, first, stays]


def remove_repeats(documents: DataFrame, length: int = LENGTH, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes that remain) of every document."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    docs, runs, copies, written = repeated_passages(documents, length, frequent)
    found = runs.groupBy(*_OWNER).agg(F.collect_list("runs").alias("runs"))
    whole = copies.groupBy(*_OWNER).agg(F.collect_list("digest").alias("copies"))
    found = materialise(found.join(whole, list(_OWNER), "full"), "repeats")
    for done in written:
        discard(done)
    rows = docs.join(found, list(_OWNER), "left").select("doc_id", "text", "runs", "copies")
    out = T.StructType([*_LONGS("doc_id", "n_bytes", "n_removed", "n_spans").fields, T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for part, texts in _text_slices(batches, 1):
            made = [[], [], [], []]
            for text, runs, copies in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                spans = np.zeros((0, 2), np.int64)
                if copies and _digest(text) in copies:
                    spans = np.array([[0, len(text)]])
                elif runs:
                    spans = merged(runs)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                for column, value in zip(made, (len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(kept)), strict=True):
                    column.append(value)
            yield _rows_of(out, [part.column(0)] + [pa.array(c, pa.int64()) for c in made[:3]] + [pa.array(made[3], pa.binary())])

    return rows.mapInArrow(cut, out)


def op4_repeated_passages(spark, sf_dir) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
