"""A keyed index on Parquet: documents, chunks and vectors by document, postings by term.

Documents, chunks and vectors are divided into buckets by a hash of ``doc_id``, postings into
parts by a hash of the term, sorted by term.  A bucket or part of a generation is one file or
some, whose numbers are those of the tasks that wrote them.  A sync writes new generations of
the buckets of documents (the manifest: hashes, metadata and access columns, a row a document)
that hold changes.  Of chunks, vectors and postings it writes a segment with the rows of the
documents that it has split; a row counts while the manifest names the generation its document
was ``born`` in, so no row of other documents is written again.  Documents that have given way
are also listed by themselves, for readers who need nothing else of the manifest.  Where there
are more than ``SEGMENTS`` segments, they are merged.  Beside the postings, a dictionary of the
terms says of each block of postings how many there are and what they can weigh at most.  Last
comes a version that says which generations and segments count.  A reader takes the newest
version there is, so it sees a whole index before, during and after a sync, and after one that
failed.

A document's content and its metadata (path, version, scopes, validity) have hashes of their
own: where only the metadata has changed, the manifest alone is written anew, and nothing is
split, tokenised or embedded.  A text that is embedded already, in whatever document, is not
embedded again.
"""

from __future__ import annotations

import copy
import hashlib
import json
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions.text import content_hash
from ..functions.vectors import hash_embeddings
from ..operators import lexical, selection
from ..operators.access import with_access_columns
from ..operators.chunking import section_chunks, split_sections
from ..operators.plugins import embed
from ..storage import materialise, names_in, remove
from .documents import read_index

#: Tables in buckets of documents, and tables in parts by term.
BUCKETED, BY_TERM = ("documents", "chunks", "vectors"), ("postings", "terms")
#: What this kind of store is called in its versions; one of an earlier kind is written anew by its next sync.
KIND = 5
#: Bytes of documents a bucket is meant to hold, and those whose chunks share a file of it.
BUCKET_BYTES, FILE_BYTES = 512 << 20, 8 << 20
#: Bytes of documents whose terms share a part of the postings, and whose chunks a block of them.
PART_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Segments that a reader looks through at most; one more and they are merged.
SEGMENTS = 8
#: Asked terms up to which the scan of the postings is told their names.
NAMED_TERMS = 1_000
_ACCESS = ("scopes", "from_day", "to_day")
_METADATA = ("source_path", "version", "permission_scope", "effective_from", "effective_to")
#: Columns of the manifest beside ``doc_id``, and of the stored chunks.
_MANIFEST = "content_hash string, shape_hash string, metadata_hash string, embedding_model string, updated_at timestamp, born long, " + ", ".join(f"{c} string" for c in _METADATA) + ", scopes array<string>, from_day int, to_day int"
_CHUNK = ("chunk_id", "parent_id", "doc_id", "chunk_no", "title_path", "text", "token_count", "terms", "n_terms", "born")


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, change): added, changed, restated, removed or same.

    Changed: another ``content_hash``, or ``shape_hash`` (title and body) where both sides have
    one.  Restated: the same content under another ``metadata_hash``, or one never stored.
    """
    both = [c for c in ("content_hash", "shape_hash", "metadata_hash") if c in current.columns and c in stored.columns]
    new = current.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in both], F.lit(True).alias("now"))
    old = stored.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in both], F.lit(True).alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old_content_hash") != F.col("new_content_hash"), "changed")
    if "shape_hash" in both:
        change = change.when(F.col("old_shape_hash") != F.col("new_shape_hash"), "changed")
    if "metadata_hash" in both:
        change = change.when(~F.col("old_metadata_hash").eqNullSafe(F.col("new_metadata_hash")), "restated")
    return new.join(old, "doc_id", "full_outer").select("doc_id", change.otherwise("same").alias("change"))


def _digests(manifest: DataFrame) -> dict[str, list]:
    """Of each ``bucket`` of a manifest, how many documents it holds and a digest of their ids and hashes."""
    said = ["doc_id", *[F.coalesce(c, F.lit("")) for c in ("content_hash", "shape_hash", "metadata_hash")]]
    sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64(*said)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *said)).alias("y")]
    return {str(r.bucket): [r.n, r.x, r.y] for r in manifest.groupBy("bucket").agg(*sums).collect()}  # a row a bucket


def upsert(stored: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stored`` with all rows of the changed documents replaced."""
    keys = changed.select(key).distinct()
    return stored.join(keys, key, "left_anti").unionByName(changed, allowMissingColumns=True)


def delete(stored: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(removed.select(key).distinct(), key, "left_anti")


def restate(stored: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stored`` with the columns that ``updates`` (a row a document) has for its documents."""
    own = [c for c in updates.columns if c != key and c in stored.columns]
    told = updates.select(F.col(key).alias("__key"), F.struct(*own).alias("__new"))
    rows = stored.join(told, F.col(key) == F.col("__key"), "left")
    return rows.select(*[F.when(F.col("__key").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in stored.columns])


def build_chunks(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks with their document's access columns, all from one pass over the documents."""
    return with_access_columns(_split(docs, config, ("permission_scope", "effective_from", "effective_to", "source_path", "version")))


def _split(docs: DataFrame, config: EngineConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    return section_chunks(split_sections(docs, carry=carry), config.chunk_chars, config.overlap_chars, config.paragraph_delimiter, carry)


def _completed(rows: DataFrame, columns: str) -> DataFrame:
    """``rows`` with those of the columns that they lack, as null."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(columns) if f.name not in rows.columns})


@dataclass(frozen=True)
class Synced:
    """What a sync did: the changes, a row a document (doc_id, change), and how many there were of each kind."""

    changes: DataFrame
    added: int
    changed: int
    removed: int
    restated: int = 0


class IndexStore:
    """``buckets`` is for a new index; by default it follows from the size of the first documents."""

    def __init__(
        self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), buckets: int | None = None, mirror: IndexStore | None = None, embedder=None
    ):
        self.spark, self.path, self.config, self.buckets, self.mirror, self.embedder = spark, path.rstrip("/"), config, buckets, mirror, embedder
        self.identity = f"{config.embedding_provider.strip().lower()}:{config.embedding_model.strip()}"
        self._pinned: dict | None = None

    @classmethod
    def of_identity(cls, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), **more) -> IndexStore:
        """The index beside ``path`` for the configured embedder: each identity has a folder of its own."""
        identity = f"{config.embedding_provider.strip().lower()}:{config.embedding_model.strip()}"
        slug = "".join(c if c.isascii() and (c.isalnum() or c in "_.-") else "_" for c in identity).strip("._") or "embedding"
        return cls(spark, f"{path.rstrip('/')}.{slug[:80]}.{hashlib.sha256(identity.encode()).hexdigest()[:12]}", config, **more)

    # -------------------------------------------------------------- versions

    def _newest(self) -> int:
        names = names_in(self.spark, f"{self.path}/versions")
        return max([int(n.rpartition("=")[2]) for n in names if "_SUCCESS" in names_in(self.spark, f"{self.path}/versions/{n}")], default=0)

    def _version(self) -> dict[str, dict]:
        """What each table's files are, and ``facts``: numbers about the whole index."""
        if self._pinned is not None:
            return self._pinned
        newest = self._newest()
        if not newest:
            return {}
        return {r.name: json.loads(r.held) for r in self.spark.read.schema("name string, held string").json(f"{self.path}/versions/gen={newest:09d}").collect()}

    def pinned(self) -> IndexStore:
        """This index as of its newest version, which is read once."""
        out = copy.copy(self)
        out._pinned = self._version()
        return out

    def exists(self) -> bool:
        return bool(self._version())

    def _held(self, name: str) -> dict:
        held = self._version().get(name)
        if held is None:
            raise FileNotFoundError(f"no index in {self.path}")
        return held

    def read(self, name: str, among: list[int] | None = None) -> DataFrame:
        """The files of a table in the newest version, or of some of its buckets or parts; rows of documents that have given way among them."""
        held = self._held(name)
        schema = T.StructType.fromJson(held["schema"])
        if self._is_named(held):
            own = [(g, [i for i in numbers if among is None or i // files in among]) for g, files, numbers in held["segments"]]
            parts = [f"{self.path}/{name}/gen={g:09d}/part-{{{','.join(f'{i:05d}' for i in numbers)}}}-*" for g, numbers in own if numbers]
        else:
            placed = held["generation"].items() if name in BUCKETED else [(b, g) for g, parts in held["segments"] for b in parts]
            parts = [f"{self.path}/{name}/gen={g:09d}/bucket={b}" for b, g in placed if among is None or int(b) in among]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts).select(*schema.names)

    @staticmethod
    def _is_named(held: dict) -> bool:
        """Whether a table's buckets or parts are told by names of files: [generation, files a bucket, numbers].  Earlier kinds have a folder each."""
        return "generation" not in held and all(len(segment) == 3 for segment in held["segments"])

    def _is_earlier(self) -> bool:
        version = self._version()
        return bool(version) and version.get("facts", {}).get("kind") != KIND

    def manifest(self) -> DataFrame:
        return self.read("documents")

    def _living(self, rows: DataFrame, among: list[int] | None = None) -> DataFrame:
        """Rows (doc_id, born) of documents as they are now, with their documents' metadata and access columns."""
        return rows.join(self.read("documents", among).select("doc_id", "born", *_METADATA, *_ACCESS), ["doc_id", "born"])

    def _left(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, born) without those of documents that have given way since; the list of these is short beside the manifest."""
        gone = self._held("gone")
        if not gone["segments"]:
            return rows
        schema = T.StructType.fromJson(gone["schema"])
        return rows.join(self.spark.read.schema(schema).parquet(*[f"{self.path}/gone/gen={g:09d}" for g in gone["segments"]]), ["doc_id", "born"], "left_anti")

    def chunks(self) -> DataFrame:
        """Chunks of all documents as they are now, with their documents' metadata and access columns."""
        now = self.pinned()
        rows = now.read("chunks")
        return rows if now._is_earlier() else now._living(rows).select(*[c for c in _CHUNK if c != "born"], *_METADATA, *_ACCESS)

    def _postings(self, among: list[int] | None = None) -> DataFrame:
        if self._is_earlier():
            raise ValueError(f"{self.path} is of an earlier kind; a sync brings it up to date")
        return self.read("postings", among).withColumns({"chunk_id": F.concat(F.col("doc_id").cast("string"), "place"), "tf": F.col("tf").cast("long"), "length": F.col("length").cast("long")})

    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, length, doc_id) of all documents as they are now."""
        now = self.pinned()
        return now._left(now._postings()).select("chunk_id", "term", "tf", "length", "doc_id")

    def vectors(self) -> DataFrame:
        """(chunk_id, doc_id, vector) as embedded when the document last changed, and the access columns."""
        now = self.pinned()
        held = now._version().get("vectors")
        if held and held["identity"] != self.identity:
            raise ValueError(f"{self.path} was embedded by {held['identity']}, not by {self.identity}")
        rows = now.read("vectors").drop("text_hash")
        return rows if now._is_earlier() else now._living(rows).select("chunk_id", "vector", "doc_id", *_ACCESS)

    def hydrate(self, ids: DataFrame) -> DataFrame:
        """The stored rows of the asked ``chunk_id``, each once; unknown ids are absent."""
        return selection.hydrate(ids, self.chunks(), "chunk_id")

    def siblings(self, parents: DataFrame) -> DataFrame:
        """(parent_id, siblings) of the asked ``parent_id``, in order of their ids; an empty array for a parent without chunks."""
        asked = parents.select("parent_id").distinct()
        return selection.siblings(asked, self.chunks().join(asked, "parent_id", "left_semi"))

    def statistics(self) -> DataFrame:
        """One row: number of chunks and mean number of terms, as counted when they were written."""
        facts = self._held("facts")
        mean = facts["n_terms"] / facts["n_rows"] if facts["n_rows"] else None
        return self.spark.createDataFrame([(facts["n_rows"], mean)], "n_rows long, mean_length double")

    def count(self) -> int:
        return self._held("facts")["n_rows"]

    def _parts_of(self, terms: DataFrame) -> list[int]:
        """Which parts of the postings hold some terms: numbers, at most as many as there are parts."""
        n = self._held("postings")["buckets"]
        return [r.b for r in terms.select(lexical.part_of("term", n).alias("b")).distinct().collect()]

    def recall(self, queries: DataFrame, k: int, variant: str = "plain", seen=None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the ``k`` best chunks by BM25 among those that pass ``seen``.

        ``seen`` is a test of the access columns, beside columns of ``queries`` if it needs them.
        Only the parts of the postings and of the dictionary that hold asked terms are read, and
        of a query's blocks only those that can still reach its ``k`` best.
        """
        now = self.pinned()
        asked = materialise(lexical.query_terms(queries), "asked")
        terms = asked.select("term").distinct()
        parts = now._parts_of(terms)
        named = [r.term for r in terms.limit(NAMED_TERMS + 1).collect()]
        test = F.col("term").isin(named) if 0 < len(named) <= NAMED_TERMS else F.lit(True)
        blocks = now.read("terms", parts).where(test).join(terms, "term", "left_semi")
        who = [c for c in queries.columns if c != "query"]

        def living(met):
            return now._left(met) if seen is None else now._living(met).where(seen)

        of_query = queries.select(*who) if len(who) > 1 else None
        return lexical.bm25_blocks(asked, blocks, now._postings(parts).where(test), living, now.statistics(), k, variant, of_query=of_query)

    def reset(self) -> None:
        for name in (*BUCKETED, *BY_TERM, "gone", "versions", "changes", "incoming", "claims"):
            remove(self.spark, f"{self.path}/{name}")
        if self.mirror:
            self.mirror.reset()

    def vacuum(self) -> int:
        """Delete generations that the newest version does not name; how many.  Not while others read older versions."""
        gone = 0
        for name, held in self._version().items():
            if name == "facts":
                continue
            if name == "gone":
                live = {(f"gen={g:09d}", None) for g in held["segments"]}
            elif self._is_named(held):
                live = {(f"gen={g:09d}", f"part-{i:05d}") for g, _, numbers in held["segments"] for i in numbers}
            else:
                placed = held["generation"].items() if name in BUCKETED else [(b, g) for g, parts in held["segments"] for b in parts]
                live = {(f"gen={g:09d}", f"bucket={b}") for b, g in placed}
            for gen in names_in(self.spark, f"{self.path}/{name}"):
                for file in names_in(self.spark, f"{self.path}/{name}/{gen}"):
                    if file.startswith(("bucket=", "part-")) and not {(gen, None), (gen, "-".join(file.split("-")[:2]))} & live:
                        remove(self.spark, f"{self.path}/{name}/{gen}/{file}")
                        gone += 1
        return gone

    # -------------------------------------------------------------- writing

    @contextmanager
    def _writing(self):
        """The number of the next version, held by one writer at a time; a second one fails."""
        gen = self._newest() + 1
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/gen={gen:09d}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.createNewFile(place):
            raise RuntimeError(f"another sync of {self.path} writes version {gen}; if it was killed, delete {place.toString()}")
        try:
            if self._newest() != gen - 1:
                raise RuntimeError(f"another sync of {self.path} has written version {gen}")
            remove(self.spark, f"{self.path}/versions/gen={gen:09d}")  # what a writer that was killed has left
            yield gen
        finally:
            files.delete(place, False)

    def with_hashes(self, docs: DataFrame) -> DataFrame:
        told = lambda names: F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names if c in docs.columns])), 256)
        hashed = content_hash("raw_text", F.lit(self.identity), self.config.dimensions)
        return docs.withColumns({"content_hash": hashed, "embedding_model": F.lit(self.identity), "shape_hash": told(("title", "body")), "metadata_hash": told(_METADATA)})

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """Vectors of chunks.  A plugged-in embedder is sent each text once, and none that the index holds a vector of."""
        if self.embedder is None:
            found = hash_embeddings(chunks.withColumnRenamed("chunk_id", "key"), "key", "terms", self.config.dimensions, carry=("doc_id", "born"))
            return found.withColumnRenamed("key", "chunk_id").withColumn("text_hash", F.lit(None).cast("string"))
        facts = chunks.select("chunk_id", "doc_id", "born")
        named = chunks.select("chunk_id", F.sha2("text", 256).alias("text_hash"))
        texts = chunks.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"))
        known = None
        held = self._version().get("vectors")
        if held and held["identity"] == self.identity and "text_hash" in T.StructType.fromJson(held["schema"]).names:
            wanted = materialise(texts.select(F.col("key").alias("text_hash")), "wanted")
            known = self.read("vectors").join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("vector").alias("vector"))
            known = materialise(known, "known")
            texts = texts.join(known.select(F.col("text_hash").alias("key")), "key", "left_anti")
        made = embed(texts, "key", "text", self.embedder, self.config.dimensions).withColumnRenamed("key", "text_hash")
        made = materialise(made.select("text_hash", "vector"), "vectors")
        found = made if known is None else made.unionByName(known.select("text_hash", F.col("vector").cast(made.schema["vector"].dataType).alias("vector")))
        return named.join(found, "text_hash").join(facts, "chunk_id").select("chunk_id", "vector", "doc_id", "born", "text_hash")

    def _manifest(self, docs: DataFrame, gen: int) -> DataFrame:
        docs = with_access_columns(docs).withColumns({"updated_at": F.current_timestamp(), "born": F.lit(gen).cast("long")})
        return docs.select("doc_id", *T.StructType.fromDDL(_MANIFEST).names)

    def _write(self, name: str, rows: DataFrame, gen: int) -> list[int]:
        """Write a generation of a table, a file a task; the numbers of its files."""
        path = f"{self.path}/{name}/gen={gen:09d}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return sorted({int(f.split("-")[1]) for f in names_in(self.spark, path) if f.startswith("part-")})

    def _written(self, name: str, gen: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/gen={gen:09d}")

    def _commit(self, gen: int, fresh: DataFrame, keys: DataFrame | None, restated: DataFrame | None = None, made: dict[str, DataFrame] | None = None) -> None:
        """Version ``gen``: documents with ``keys`` (None: all there are) give way to ``fresh``, ``restated`` ones get their metadata.

        ``made`` holds the new rows of the tables in buckets where there are such already (a mirror's).
        """
        before = self.pinned()
        old = {} if keys is None else before._version()
        earlier = bool(old) and before._is_earlier()  # all it holds is written anew, as of generation 0
        merged = earlier or (bool(old) and len(old["chunks"]["segments"]) >= SEGMENTS)
        n_bytes = 0
        if merged or not old:
            sizes = [before.read("chunks").select("text")] if old else []
            sizes += [made["chunks"].select("text") if made else fresh.select(F.col("body").alias("text"))]
            n_bytes = sum(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for rows in sizes)
        if old and not earlier:
            n, parts, ranges = old["documents"]["buckets"], old["postings"]["buckets"], old["facts"]["ranges"]
        else:
            share = lambda size: max(1, -(-n_bytes // size))
            n, parts, ranges = old["documents"]["buckets"] if old else self.buckets or share(BUCKET_BYTES), max(16, share(PART_BYTES)), max(16, share(BLOCK_BYTES))
        cores = self.spark.sparkContext.defaultParallelism
        files = max(-(-cores // n), -(-n_bytes // (n * FILE_BYTES)), 0 if merged or not old else old["chunks"]["segments"][0][1] // 4)
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
        place = (bucket * files + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files))).cast("int")
        dealt = lambda rows: rows.repartitionById(n * files, place)
        block = F.pmod(F.xxhash64("chunk_id"), F.lit(ranges)).cast("int")
        numbers = lambda ids: [r.b for r in ids.select(bucket.alias("b")).distinct().collect()]  # noqa: E731  at most as many as there are buckets
        counted = lambda rows: [x or 0 for x in rows.agg(F.count("*"), F.sum("n_terms")).first()]
        new = F.lit(gen).cast("long")

        touched = updates = gone = None
        stored = {}
        if old:
            keys = keys.select("doc_id").distinct()
            ids = keys
            if restated is not None:
                ids = keys.unionByName(restated.select("doc_id"))
                updates = with_access_columns(restated).select("doc_id", *_METADATA, *_ACCESS, "metadata_hash", "shape_hash", F.current_timestamp().alias("updated_at"))
                updates = materialise(updates, "restated")
            touched = None if earlier else numbers(ids)
            stored = {name: before.read(name, touched if name == "documents" or not merged else None) for name in BUCKETED}
            if earlier:
                stored = self._of_now(stored)
            else:
                gone = stored["documents"].join(keys, "doc_id", "left_semi").select("doc_id", "born")
                gone.write.mode("overwrite").parquet(f"{self.path}/gone/gen={gen:09d}")
                gone = self._written("gone", gen, gone.schema)
        kept = lambda name: stored[name].join(keys, "doc_id", "left_anti")
        living = lambda name: kept(name) if earlier else before._left(kept(name))

        if made:
            chunks = dealt(made["chunks"].withColumn("born", new).select(*_CHUNK))
        else:  # dealt out before they are split, so that chunks are written where they come from
            chunks = _split(dealt(fresh.select("doc_id", "title", "body")), self.config).withColumns({"n_terms": F.size("terms"), "born": new}).select(*_CHUNK)
        if merged:
            chunks = dealt(living("chunks").select(*_CHUNK).unionByName(chunks))
        of_chunks = [gen, files, self._write("chunks", chunks, gen)]
        chunks = self._written("chunks", gen, chunks.schema)
        found = counted(chunks)
        if old and not merged:
            facts, lost = old["facts"], counted(stored["chunks"].join(gone, ["doc_id", "born"], "left_semi"))
            found = [facts[c] + a - b for c, a, b in zip(("n_rows", "n_terms"), found, lost, strict=True)]
        version = {"facts": {"n_rows": found[0], "n_terms": found[1], "ranges": ranges, "kind": KIND}}
        segments = {name: list(old[name]["segments"]) if old and not merged else [] for name in ("chunks", "vectors", *BY_TERM)}

        if made:
            vectors = made["vectors"].withColumn("born", new)
        else:
            vectors = self._embedded(chunks.where(F.col("born") == gen) if merged else chunks)
        vectors = _completed(vectors, "text_hash string").select("chunk_id", "vector", "doc_id", "born", "text_hash")
        if merged:
            vectors = living("vectors").select(*vectors.columns).unionByName(vectors)
        of_vectors = [gen, files, self._write("vectors", dealt(vectors), gen)]

        rows = made["documents"].withColumn("born", new) if made else self._manifest(fresh, gen)
        rows = _completed(rows, _MANIFEST).select("doc_id", *T.StructType.fromDDL(_MANIFEST).names)
        if old:
            left = kept("documents")
            rows = (restate(left, updates) if updates is not None else left).select(*rows.columns).unionByName(rows)
        written = self._write("documents", rows.repartitionById(n, bucket), gen)
        written = written if touched is None else [b for b in written if b in touched]
        held = [[g, 1, [b for b in own if b not in touched]] for g, _, own in old["documents"]["segments"]] if touched is not None else []
        held = [segment for segment in held if segment[2]] + [[gen, 1, written]]
        digests = {b: d for b, d in old["documents"].get("digests", {}).items() if int(b) not in touched} if touched is not None else {}
        version["documents"] = {"schema": json.loads(rows.schema.json()), "buckets": n, "segments": held, "identity": self.identity}
        version["documents"]["digests"] = digests | _digests(self._written("documents", gen, rows.schema).withColumn("bucket", bucket))
        for name, table, segment in (("chunks", chunks, of_chunks), ("vectors", vectors, of_vectors)):
            version[name] = {"schema": json.loads(table.schema.json()), "buckets": n, "segments": segments[name] + [segment], "identity": self.identity}
        if gone is None or merged:
            version["gone"] = {"schema": json.loads(rows.select("doc_id", "born").schema.json()), "segments": []}
        else:
            version["gone"] = {**old["gone"], "segments": old["gone"]["segments"] + [gen]}

        placed = chunks.withColumns({"place": F.substr("chunk_id", F.length(F.col("doc_id").cast("string")) + 1), "block": block})
        postings = lexical.unpacked_postings(lexical.packed_postings(placed, parts).repartitionById(parts, F.col("part")), rows.schema["doc_id"].dataType.simpleString())
        postings = postings.sortWithinPartitions("term", "block", "doc_id")
        of_terms = {"postings": [gen, 1, self._write("postings", postings, gen)]}
        terms = lexical.block_counts(self._written("postings", gen, postings.schema))
        if old and not merged:
            lost = lexical.lost_counts(stored["chunks"].join(gone, ["doc_id", "born"], "left_semi").withColumn("block", block))
            terms = terms.unionByName(_completed(lost, "most_tf long, least_length long"))
        of_terms["terms"] = [gen, 1, self._write("terms", terms.repartitionById(parts, lexical.part_of("term", parts)).sortWithinPartitions("term", "block"), gen)]
        for name, table in (("postings", postings), ("terms", terms)):
            version[name] = {"schema": json.loads(table.schema.json()), "buckets": parts, "segments": segments[name] + [of_terms[name]]}
        # the switch: Spark marks the folder as done when its only file is whole
        rows = [(name, json.dumps(held)) for name, held in version.items()]
        self.spark.createDataFrame(rows, "name string, held string").coalesce(1).write.mode("error").json(f"{self.path}/versions/gen={gen:09d}")

    def _rows(self, among: list[int] | None = None) -> dict[str, DataFrame]:
        """The tables in buckets with the rows of documents as they are now, as they are written now."""
        stored = {name: self.read(name, among) for name in BUCKETED}
        return self._of_now(stored) if self._is_earlier() else stored | {name: self._left(stored[name]) for name in ("chunks", "vectors")}

    @staticmethod
    def _of_now(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Tables of a store of an earlier kind, where chunks had the metadata of their documents, as they are written now."""
        documents, chunks, zero = stored["documents"], stored["chunks"], F.lit(0).cast("long")
        lacking = [c for c in (*_METADATA, *_ACCESS) if c not in documents.columns and c in chunks.columns]
        if lacking:
            told = chunks.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in lacking])
            documents = documents.join(told, "doc_id", "left")
        chunks = chunks if "n_terms" in chunks.columns else chunks.withColumn("n_terms", F.size("terms"))
        found = {"documents": _completed(documents, _MANIFEST), "chunks": chunks, "vectors": _completed(stored["vectors"], "text_hash string")}
        return {name: rows.withColumn("born", zero) for name, rows in found.items()}

    def follow(self, primary: IndexStore) -> None:
        """Take over the rows of documents that ``primary`` holds otherwise, vectors and all."""
        primary = primary.pinned()
        with self._writing() as gen:
            there = self.exists()
            keys = None
            differing = None
            if there:
                mine, other = (side._held("documents") for side in (self, primary))
                if mine["buckets"] == other["buckets"] and "digests" in mine and "digests" in other:
                    differing = self._differing(mine["digests"], other["digests"])
                    if not differing:
                        return
                path = f"{self.path}/changes/gen={gen:09d}"
                changes = diff(primary.read("documents", differing), self._probed(self.read("documents", differing))).where("change <> 'same'")
                changes.write.mode("overwrite").parquet(path)
                keys = self.spark.read.schema(changes.schema).parquet(path).select("doc_id")
                if keys.isEmpty():
                    return
            else:
                self.buckets = self.buckets or primary._held("documents")["buckets"]
            rows = primary._rows(differing)
            if keys is not None:
                rows = {name: part.join(keys, "doc_id", "left_semi").select(*part.columns) for name, part in rows.items()}
            self._commit(gen, rows["documents"], keys, made=rows)

    def add(self, docs: DataFrame) -> None:
        """Index ``docs`` beside what is there, whatever is known of them; documents of the same id are replaced."""
        docs = self.with_hashes(docs)
        with self._writing() as gen:
            self._commit(gen, docs, docs.select("doc_id") if self.exists() else None)

    def merge(self, docs: DataFrame | None = None, gone: DataFrame | None = None) -> Synced:
        """Bring the index in line with some documents: those of ``docs`` that are new or otherwise, without those in ``gone`` (doc_id).

        All others stay.  Where nothing changes no version is written.
        """
        return self._applied(docs, gone, False)

    def sync(self, docs: DataFrame, rebuild: bool = False) -> Synced:
        """Bring the index in line with ``docs``: what is not among them goes.

        Only changed documents are split, tokenised and embedded, and of those only texts without
        a vector; documents whose metadata alone has changed are restated.  A second run without
        changes writes no version.
        """
        if rebuild:
            self.reset()
        return self._applied(docs, None, True)

    def _changes(self, docs: DataFrame | None, gone: DataFrame | None, whole: bool) -> DataFrame:
        """(doc_id, change) of what is not the same."""
        if not self.exists():
            return docs.select("doc_id", F.lit("added").alias("change"))
        if whole:
            held = self._held("documents")
            bucket = F.pmod(F.xxhash64("doc_id"), F.lit(held["buckets"])).cast("int")
            other = None
            if "digests" in held:  # only the buckets whose digests differ are compared
                other = self._differing(held["digests"], _digests(docs.withColumn("bucket", bucket)))
                docs = docs.where(bucket.isin(other))
            return diff(docs, self._probed(self.read("documents", other))).where("change <> 'same'")
        manifest = self._probed(self.manifest())
        found = []
        if docs is not None:
            found.append(diff(docs, manifest.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")).where("change NOT IN ('same', 'removed')"))
        if gone is not None:
            ids = gone.select("doc_id").distinct()
            ids = ids.join(docs.select("doc_id"), "doc_id", "left_anti") if docs is not None else ids
            found.append(manifest.select("doc_id").join(ids, "doc_id", "left_semi").withColumn("change", F.lit("removed")))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _applied(self, docs: DataFrame | None, gone: DataFrame | None, whole: bool) -> Synced:
        docs = None if docs is None else self.with_hashes(docs)
        with self._writing() as gen:
            there = self.exists()
            if docs is None and not there:
                raise FileNotFoundError(f"no index in {self.path}")
            path = f"{self.path}/changes/gen={gen:09d}"
            self._changes(docs, gone, whole).write.mode("overwrite").parquet(path)  # kept beside the index, as long as the documents' list is long
            changes = self.spark.read.schema("doc_id " + self._id_type(docs) + ", change string").parquet(path)
            number = {r.change: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
            if number or not there or self._is_earlier():
                if docs is None:  # documents only go: what comes in is an empty table of the right kind
                    fresh, restated = None, None
                else:
                    of_kind = lambda *kinds: docs.join(changes.where(F.col("change").isin(*kinds)).select("doc_id"), "doc_id", "left_semi")
                    fresh, restated = of_kind("added", "changed") if there else docs, of_kind("restated") if "restated" in number else None
                keys = changes.where("change <> 'restated'").select("doc_id") if there else None
                made = {name: rows.limit(0) for name, rows in self._rows().items()} if fresh is None else None
                self._commit(gen, fresh, keys, restated, made)
        if self.mirror:
            self.mirror.follow(self)
        return Synced(changes, number.get("added", 0), number.get("changed", 0), number.get("removed", 0), number.get("restated", 0))

    @staticmethod
    def _differing(a: dict[str, list], b: dict[str, list]) -> list[int]:
        """Buckets that do not hold the same documents on both sides."""
        return sorted(int(k) for k in a.keys() | b.keys() if a.get(k) != b.get(k))

    def _id_type(self, docs: DataFrame | None) -> str:
        return (self.manifest() if docs is None else docs).schema["doc_id"].dataType.simpleString()

    @staticmethod
    def _probed(manifest: DataFrame) -> DataFrame:
        """A manifest of an earlier kind with the hashes it lacks, as null."""
        return manifest.withColumns({c: F.lit(None).cast("string") for c in ("shape_hash", "metadata_hash") if c not in manifest.columns})


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: the sink of monitoring events and traces."""
    df.write.mode("append").json(path)


def write_markdown(docs: DataFrame, path: str) -> None:
    """One text file a document, in a folder named after it."""
    docs.select("filename", F.col("content").alias("value")).repartition("filename").write.mode("overwrite").partitionBy("filename").text(path)


def write_index(chunks: DataFrame, path: str, embedding_model: str) -> None:
    """A plain chunk index beside those of other models: one partition a model."""
    rows = chunks.withColumn("embedding_model", F.lit(embedding_model))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("embedding_model").parquet(path)


def get_or_build(spark: SparkSession, path: str, embedding_model: str, build, rebuild: bool = False) -> DataFrame:
    """The stored index of a model; ``build()`` makes it where there is none, it is empty, or ``rebuild`` asks for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    found = read_index(spark, path, embedding_model) if there and not rebuild else None
    if found is None:
        write_index(build(), path, embedding_model)
        found = spark.read.parquet(path).where(F.col("embedding_model") == embedding_model)
    return found


def payloads(chunks: DataFrame) -> DataFrame:
    """What an external vector store keeps beside a vector: no text, no terms, scopes as a sorted list."""
    kept = [c for c in ("chunk_id", "parent_id", "doc_id", "title_path", "token_count", "source_path", "version", "from_day", "to_day", "content_hash", "embedding_model") if c in chunks.columns]
    return chunks.select(*kept, F.array_sort("scopes").alias("permission_scopes"))


def append_traces(traces: DataFrame, path: str) -> None:
    """One JSON document a query, as a line."""
    traces.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
