"""Inverted index and the three lexical scorers."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import SPARSE_BUCKETS
from ..functions.text import sparse_bucket, tokenize
from ..functions.vectors import list_lengths, pieces
from ..storage import materialise


#: Terms that a kernel counts at once (one row's at least): a batch holds many times as many where texts are long.
COUNTED = 200_000
#: Postings that are held before they are dealt out in packed form.
PACKED = 2_000_000


def term_rows(rows: DataFrame, *columns, terms: str = "terms") -> DataFrame:
    """(columns, term): a row a term.

    An inner explode of an expression makes Spark test the expression's size as well, which
    tokenises every text twice; an outer one does not.
    """
    return rows.select(*columns, F.explode_outer(terms).alias("term")).where("term IS NOT NULL")


def _counted(rows: DataFrame, key: str, terms: str, columns: str, name_terms, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, name, tf, length, carry): how often each name occurs among a row's terms, counted where the row lies.

    ``name_terms`` maps a batch's distinct terms to names, or gives None to keep the terms.
    The key is a row's own, so nothing is shuffled.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def counted(batch, lengths, code, names):
        n = max(len(names), 1)
        pairs, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * n + code, return_counts=True)
        row = pairs // n
        own = pa.array(row)
        told = [batch.column(0).take(own), names.take(pa.array(pairs % n)), pa.array(tf), pa.array(lengths[row])]
        return pa.RecordBatch.from_arrays([*told, *[batch.column(2 + i).take(own) for i in range(len(carry))]], names=kinds)

    def run(batches):
        for batch in batches:
            lengths = list_lengths(batch.column(1))
            found = batch.column(1).flatten().dictionary_encode()
            code, names, at = found.indices.to_numpy(zero_copy_only=False), found.dictionary, 0
            if name_terms is not None:
                names, place = np.unique(name_terms(names.to_pylist()), return_inverse=True)
                code, names = place.astype(np.int32)[code], pa.array(names)
            for lo, hi in pieces(lengths, COUNTED):
                n = int(lengths[lo:hi].sum())
                yield counted(batch.slice(lo, hi - lo), lengths[lo:hi], code[at : at + n], names)
                at += n

    kinds = [key, columns.split()[0], "tf", "length", *carry]
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(key, F.col(terms).cast("array<string>"), *carry).mapInArrow(run, f"`{key}` {key_type}, {columns}, tf long, length long{more}")


def postings(chunks: DataFrame, key: str = "chunk_id", terms: str = "terms", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf, length, carry): one row for each distinct term of a row; the key is a row's own."""
    return _counted(chunks, key, terms, "term string", None, carry)


def part_of(term: str, parts: int) -> Column:
    """Which part of the stored postings holds a term."""
    return F.pmod(F.crc32(term), F.lit(parts)).cast("int")


def _dealt(rows: pa.Table, part: np.ndarray, name: str) -> pa.RecordBatch:
    """(name, held): rows as compressed Arrow streams, one for each number in ``part``; dictionaries hold what their stream needs."""
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)).combine_chunks(), part[order]
    starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    columns, found = [c.chunk(0) for c in rows.columns], []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        own = []
        for c in columns:
            c = c.slice(lo, hi - lo)
            if isinstance(c, pa.DictionaryArray):
                used, place = np.unique(c.indices.to_numpy(), return_inverse=True)
                c = pa.DictionaryArray.from_arrays(pa.array(place.astype(np.int32)), c.dictionary.take(pa.array(used)))
            own.append(c)
        batch, sink = pa.RecordBatch.from_arrays(own, names=rows.column_names), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        found.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]]), pa.array(found, pa.binary())], names=[name, "held"])


def _opened(held: pa.Scalar):
    """The rows of a stream that ``_dealt`` has made, without dictionaries."""
    with pa.ipc.open_stream(held.as_buffer()) as stream:
        for rows in stream:
            plain = [c.dictionary_decode() if isinstance(c, pa.DictionaryArray) else c for c in rows.columns]
            yield pa.RecordBatch.from_arrays(plain, names=rows.schema.names)


_POSTING = ("term", "doc_id", "place", "tf", "length", "born", "block")


def packed_postings(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, held): postings of chunks (terms, doc_id, place, born, block), dealt out to the parts of their terms.

    ``held`` is a compressed Arrow stream of postings in the order of their chunks: a shuffle of these
    moves a fraction of the bytes that a row a posting takes.
    """

    def dealt(tables):
        rows = pa.concat_tables(tables).unify_dictionaries().combine_chunks()
        term = rows["term"].chunk(0)
        part = np.array([zlib.crc32(t.encode("utf-8")) % parts for t in term.dictionary.to_pylist()], np.int32)
        return _dealt(rows, part[term.indices.to_numpy()], "part")

    def run(batches):
        tables, held = [], 0
        for batch in batches:
            lengths = list_lengths(batch.column(0))
            found, place, at = batch.column(0).flatten().dictionary_encode(), batch.column(2).dictionary_encode(), 0
            code, n = found.indices.to_numpy(zero_copy_only=False), max(len(found.dictionary), 1)
            for lo, hi in pieces(lengths, COUNTED):
                size = int(lengths[lo:hi].sum())
                pairs, tf = np.unique(np.repeat(np.arange(lo, hi), lengths[lo:hi]) * n + code[at : at + size], return_counts=True)
                at += size
                row = pairs // n
                own = pa.array(row)
                term = pa.DictionaryArray.from_arrays(pa.array((pairs % n).astype(np.int32)), found.dictionary)
                columns = [term, batch.column(1).take(own), place.take(own), pa.array(tf.astype(np.int32)), pa.array(lengths[row].astype(np.int32)), *[batch.column(i).take(own) for i in (3, 4)]]
                tables.append(pa.table(columns, names=_POSTING))
                held += len(row)
                if held >= PACKED:
                    yield dealt(tables)
                    tables, held = [], 0
        if held:
            yield dealt(tables)

    return chunks.select(F.col("terms").cast("array<string>"), "doc_id", "place", "born", "block").mapInArrow(run, "part int, held binary")


def _ranks(values: pa.Array) -> np.ndarray:
    """Of each value its place in the order of all distinct ones."""
    found = values.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[found.indices.to_numpy()]


def unpacked_postings(packed: DataFrame, id_type: str) -> DataFrame:
    """(term, doc_id, place, tf, length, born, block): the rows of ``packed_postings`` in the tasks they lie in, sorted piece by piece by term, block and document."""

    def joined(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        order = np.lexsort((_ranks(rows["doc_id"].chunk(0)), rows["block"].to_numpy(), _ranks(rows["term"].chunk(0))))
        return rows.take(pa.array(order)).combine_chunks().to_batches()

    def run(batches):
        found, n = [], 0
        for batch in batches:
            for held in batch.column(0):
                for rows in _opened(held):
                    found.append(rows)
                    n += rows.num_rows
                if n >= COUNTED:
                    yield from joined(found)
                    found, n = [], 0
        if found:
            yield from joined(found)

    return packed.select("held").mapInArrow(run, f"term string, doc_id {id_type}, place string, tf int, length int, born long, block int")


def block_counts(postings: DataFrame) -> DataFrame:
    """(term, block, n, most_tf, least_length) of postings that lie by term and block: a row a run of equal ones, more where batches cut it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = batch.column(0).dictionary_encode().indices.to_numpy()
                block, tf, length = (batch.column(i).to_numpy() for i in (1, 2, 3))
                at = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(block) != 0)]))
                n = np.diff(np.append(at, batch.num_rows))
                most, least = np.maximum.reduceat(tf, at).astype(np.int64), np.minimum.reduceat(length, at).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(block[at]), pa.array(n), pa.array(most), pa.array(least)], names=names)

    names = ["term", "block", "n", "most_tf", "least_length"]
    return postings.select("term", "block", "tf", "length").mapInArrow(run, "term string, block int, n long, most_tf long, least_length long")


def lost_counts(chunks: DataFrame) -> DataFrame:
    """(term, block, n): how many chunks (terms, block) hold each term, as numbers below zero, added up batch by batch."""

    def run(batches):
        for batch in batches:
            lengths = list_lengths(batch.column(0))
            found = batch.column(0).flatten().dictionary_encode()
            n, blocks = max(len(found.dictionary), 1), batch.column(1).to_numpy()
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * n + found.indices.to_numpy(zero_copy_only=False))
            keys, count = np.unique(blocks[pairs // n].astype(np.int64) * n + pairs % n, return_counts=True)
            yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(keys % n)), pa.array((keys // n).astype(np.int32)), pa.array(-count)], names=["term", "block", "n"])

    return chunks.select(F.col("terms").cast("array<string>"), "block").mapInArrow(run, "term string, block int, n long")


def sparse_postings(chunks: DataFrame, key: str = "chunk_id", terms: str = "terms") -> DataFrame:
    """(key, bucket, tf): hashed term frequencies; terms that share a bucket add up.  A batch hashes each distinct term once."""

    def hashed(found: list) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.sha256(t.encode("utf-8")).digest()[:8], "big") % SPARSE_BUCKETS for t in found], np.int64)

    return _counted(chunks, key, terms, "bucket long", hashed).drop("length")


def corpus_statistics(chunks: DataFrame, terms: str = "terms") -> DataFrame:
    """One row: number of rows and mean number of terms."""
    return chunks.agg(F.count("*").alias("n_rows"), F.avg(F.size(terms)).alias("mean_length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): terms of each query, with their multiplicity."""
    rows = term_rows(queries.select("query_id", tokenize("query").alias("terms")), "query_id")
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def top_k(scored: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query, with their ``rank``; partial limits run before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def score_key(score: str = "score") -> Column:
    """Scores as whole millionths, so that rank ties do not hang on the order of a sum."""
    return F.round(F.col(score) * 1_000_000).cast("long")


# Constants of the two BM25 variants.
VARIANTS = {"plain": (1.5, 0.75), "fts5": (1.2, 0.75)}
LEAST_IDF = 1e-6


def bm25(
    queries: DataFrame, index: DataFrame, stats: DataFrame, k: int, variant: str = "plain", key: str = "chunk_id", among: DataFrame | None = None, seen: Column | None = None
) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best rows above zero.

    ``index`` and ``stats`` say what the statistics are of; ``among`` (keys) which rows may
    be found.  With ``seen``, a test of columns of ``among`` beside columns of ``queries``, each
    query finds its own.  Only postings of asked terms take part; they are written once,
    frequencies are counted on them, and the sizes of what is written decide how it is joined.
    """
    of_query = [] if seen is None else [c for c in queries.columns if c not in ("query_id", "query")]
    k1, b = VARIANTS[variant]
    asked = materialise(query_terms(queries), "asked")
    held = materialise(index.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    odds = (F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(1 + odds) if variant == "plain" else F.when(F.log(odds) <= 0, F.lit(LEAST_IDF)).otherwise(F.log(odds))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "times", "mean_length", idf.alias("idf"))
    weighed = materialise(weighed, "weights")
    if among is not None:
        held = held.join(among.select(key), key, "left_semi") if seen is None else held.join(among, key)
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    met = held.join(weighed, "term")
    if seen is not None:
        met = met.join(queries.select("query_id", *of_query), "query_id").where(seen)
    scored = met.groupBy("query_id", key).agg(F.sum(F.col("times") * F.col("idf") * saturated).alias("score"))
    return top_k(scored.where("score > 0"), k, [F.desc(score_key()), F.col(key)])


def _best_of_blocks(wanted: DataFrame, held: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, key, score): of each query and block the ``k`` best rows above zero, ties to the smaller key.

    ``wanted``: block, query_id, term, weight.  ``held``: block, key, term, value, a posting once: a
    block's postings meet its queries inside the task, so no row a query and posting is made.
    They go there as compressed streams.
    """
    kinds = pa.schema([(key, pa.string()), ("term", pa.string()), ("value", pa.float64())])

    def packed(batches):
        tables, n = [], 0
        for batch in batches:
            columns = [batch.column(i).dictionary_encode() for i in (1, 2, 3)]
            tables.append(pa.table([batch.column(0), *columns], names=["block", *kinds.names]))
            n += batch.num_rows
            if n >= PACKED:
                yield dealt(tables)
                tables, n = [], 0
        if n:
            yield dealt(tables)

    def dealt(tables):
        rows = pa.concat_tables(tables).unify_dictionaries().combine_chunks()
        return _dealt(rows.drop_columns(["block"]), rows["block"].to_numpy(), "block")

    schema = T.StructType([wanted.schema["query_id"], held.schema[key], T.StructField("score", T.DoubleType())])

    def best(asked: pa.Table, streams: pa.Table) -> pa.Table:
        rows = pa.Table.from_batches([rows for held in streams["held"] for rows in _opened(held)], kinds)
        keys, terms = (rows[c].combine_chunks().dictionary_encode() for c in (key, "term"))
        names = keys.dictionary.take(order := pc.array_sort_indices(keys.dictionary))
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        place, code = place[keys.indices.to_numpy()], terms.indices.to_numpy()
        by_term = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(terms.dictionary)))
        place, value = place[by_term], rows["value"].to_numpy()[by_term]
        ids = asked["query_id"].combine_chunks().dictionary_encode()
        met = pc.index_in(asked["term"].combine_chunks(), value_set=terms.dictionary).fill_null(-1).to_numpy()
        query, weight = ids.indices.to_numpy(), asked["weight"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        live = np.flatnonzero(met >= 0)
        live = live[np.argsort(query[live], kind="stable")]
        for own in np.split(live, np.flatnonzero(np.diff(query[live])) + 1) if len(live) else []:
            total = np.zeros(len(names))
            for i in own:
                lo, hi = ends[met[i] - 1] if met[i] else 0, ends[met[i]]
                np.add.at(total, place[lo:hi], weight[i] * value[lo:hi])
            hit = np.flatnonzero(total > 0)
            level = np.floor(total[hit] * 1_000_000 + 0.5)
            if len(hit) > k:
                edge = np.partition(level, len(hit) - k)[len(hit) - k]
                hit, level = hit[level >= edge], level[level >= edge]
                hit = hit[np.argsort(-level, kind="stable")[:k]]
            out.append((np.full(len(hit), query[own[0]]), hit, total[hit]))
        q, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.Table.from_arrays([ids.dictionary.take(pa.array(q)), names.take(pa.array(at)), pa.array(score)], names=schema.names)

    streams = held.select("block", key, "term", "value").mapInArrow(packed, "block int, held binary")
    return wanted.groupBy("block").cogroup(streams.groupBy("block")).applyInArrow(best, schema)


def bm25_blocks(
    asked: DataFrame, blocks: DataFrame, postings: DataFrame, living, stats: DataFrame, k: int, variant: str = "plain", key: str = "chunk_id", of_query: DataFrame | None = None, first: int = 2
) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best rows above zero, from postings in blocks.

    ``asked``: query_id, term, times.  ``blocks``: term, block, n, most_tf, least_length, as many
    rows a block as have been written; a key lies in one block for all terms.  ``living`` keeps
    of met postings, beside the columns of ``of_query``, those that count.  A query's ``first`` most
    promising blocks say what its ``k``-th best is at the least; of the others only those are
    looked at whose terms could outweigh it together.
    """
    k1, b = VARIANTS[variant]
    saturated = lambda tf, length: F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.col("mean_length")))
    blocks = blocks.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_length").alias("least_length"))
    blocks = materialise(blocks, "blocks")
    df = blocks.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
    odds = (F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(1 + odds) if variant == "plain" else F.when(F.log(odds) <= 0, F.lit(LEAST_IDF)).otherwise(F.log(odds))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "mean_length", (F.col("times") * idf).alias("weight"))
    weighed = materialise(weighed, "weights")
    bounds = weighed.join(blocks.where("n > 0"), "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * saturated("most_tf", "least_length")).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    bounds = materialise(bounds.withColumn("place", F.row_number().over(order)), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = weighed.join(pairs.select("query_id", "block"), "query_id")
        if of_query is None:
            held = postings.join(asked.select("term").distinct(), "term", "left_semi")  # by lists that are short beside the postings
            held = living(held.join(pairs.select("block").distinct(), "block", "left_semi"))
            held = held.crossJoin(F.broadcast(stats.select("mean_length"))).select("block", key, "term", saturated("tf", "length").alias("value"))
            return _best_of_blocks(wanted.select("block", "query_id", "term", "weight"), held, k, key)
        met = postings.join(wanted, ["term", "block"]).join(of_query, "query_id")
        return living(met).groupBy("query_id", key).agg(F.sum(F.col("weight") * saturated("tf", "length")).alias("score")).where("score > 0")

    best = materialise(top_k(scored(bounds.where(F.col("place") <= first)), k, [F.desc(score_key()), F.col(key)]), "best")
    edge = best.where(F.col("rank") == k).select("query_id", score_key().alias("edge"))
    rest = bounds.where(F.col("place") > first).join(edge, "query_id", "left").where(F.col("edge").isNull() | (score_key("most") + 1 >= F.col("edge")))
    more = scored(materialise(rest.select("query_id", "block"), "reached"))
    return top_k(best.drop("rank").unionByName(more), k, [F.desc(score_key()), F.col(key)])


def sparse_idf(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", among: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) by hashed term frequencies times idf: no saturation, no length norm.

    Only postings of buckets that a query asks for take part.
    """
    asked = query_terms(queries).groupBy("query_id", sparse_bucket("term").alias("bucket")).agg(F.sum("times").alias("times"))
    asked = materialise(asked, "asked")
    held = materialise(sparse_postings(chunks, key).join(asked.select("bucket").distinct(), "bucket", "left_semi"), "postings")
    df = held.groupBy("bucket").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n_rows"))
    idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(df, "bucket").crossJoin(F.broadcast(n)).select("query_id", "bucket", "times", idf.alias("idf"))
    weighed = materialise(weighed, "weights")
    if among is not None:
        held = held.join(among.select(key), key, "left_semi")
    scored = held.join(weighed, "bucket").groupBy("query_id", key).agg(F.sum(F.col("times") * F.col("tf") * F.col("idf")).alias("score"))
    return top_k(scored, k, [F.desc(score_key()), F.col(key)])
