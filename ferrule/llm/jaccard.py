"""N-gram Jaccard join with grouped prefixes: groups of documents meet over rare shingles, members are verified.

A document's set holds its distinct shingles in one order for all documents, rarer ones first.
The prefix of a set of n is so long that two sets which reach the similarity share an element
of both prefixes.  Documents with equal prefixes and sizes make one group, which takes part
once, whatever its number of members; groups that share an element of their prefixes meet at
the smallest of them (their pivot).  A pair of groups is filtered by size and by what the
prefixes' common part and the rest can still hold; members of pairs that pass are verified on
full sets.

How rare a shingle is comes from the counts of all shingles of all documents.  A shingle is
counted by 32 bits of its hash: any order that is one for all documents loses no pair, and
shingles of one document that share these bits are told apart by a number.  Tasks send packed
lists of what their documents hold to ranges of the hash; each range adds up and answers with
those elements that other documents hold as well.  An element nobody else holds stays in its
prefix as a number only, so a document whose prefix is its own alone takes no further part.

No group is expanded into pairs.  It is cut into blocks; a block verifies only what is not in
one component yet, and reports a spanning forest.  Groups of several blocks then get the pairs
of blocks in which different components still meet.  No list of documents, links, components
or shingles reaches the driver, and nothing is broadcast by this module.

Defined results: null texts and texts without words have an empty set and no links; rows with
a null ``doc_id`` stay alone (``component_id`` null); rows that repeat an id share its
component, which is linked through any of their texts; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, table
from .neardup import _group_ids, _parts, _whole_groups, components, shingle_hashes

#: Words in a shingle, and the similarity of a link in hundredths.
SHINGLE, SIMILARITY = 3, 90
#: Ranges of the hash that are counted apart: one for so many bytes of input, and bounds of their number.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 16 << 20, 1_024, 1 << 20
#: Shingles of the documents that a task sends off together.
SENT = 1_500_000
#: Documents in a block, and shingles of their sets (one document at least).
BLOCK, BLOCK_SHINGLES = 512, 4_000_000


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte, compressed: high bytes of small numbers take no room."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def sets_of(texts: list, size: int) -> list[np.ndarray]:
    return [np.unique(h) for h in shingle_hashes(texts, size)]


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits of a hash that its shingle is counted by."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def prefix_length(n, similarity: int):
    """Elements of a prefix: with fewer, a set of ``n`` could reach the similarity without it."""
    return n - -(-similarity * n // 100) + 1


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


_LISTS = "range long, chunk long, n int, cells binary, docs binary, levels binary, digests binary"


def _lists(documents: DataFrame, size: int, ranges: int) -> DataFrame:
    """What documents hold, for each range of the hash; ``chunk`` names documents that are sent off together.

    A row with a negative range is about the documents themselves: their ids, sizes and digests.
    """
    names = [x.split()[0] for x in _LISTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def sent(chunk, ids, held):
        sizes = np.array([len(h) for h in held])
        digests = b"".join(_digest(h) if len(h) else bytes(16) for h in held)
        rows = [(-1 - chunk, chunk, len(ids), np.array(ids).tobytes(), sizes.tobytes(), None, digests)]
        if sizes.sum():
            # a number holds a cell and the place of its document, so one sort orders both
            both = np.concatenate([_cells(h).astype(np.uint64) << np.uint64(32) | np.uint64(i) for i, h in enumerate(held)])
            held.clear()
            both.sort()
            starts = np.searchsorted(both, (np.arange(ranges + 1, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(ranges - 1)) // np.uint64(ranges) << np.uint64(32))
            starts[-1] = len(both)
            for r in np.flatnonzero(np.diff(starts)).tolist():
                own = both[starts[r] : starts[r + 1]]
                cells = (own >> np.uint64(32)).astype(np.uint32)
                rows.append((r, chunk, len(own), _packed(np.diff(cells, prepend=np.uint32(0))), _packed(own.astype(np.uint32)), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32  # the same when a task runs again
        ids, held, n = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            own = batch.column(0).to_pylist()
            for lo, hi in slices([len(t) if t else 0 for t in texts.to_pylist()]):
                found = sets_of(texts.slice(lo, hi - lo).to_pylist(), size)
                ids += [np.iinfo(np.int64).min if i is None else i for i in own[lo:hi]]
                held += found
                n += sum(map(len, found))
                if n >= SENT or len(ids) >= 1 << 23:
                    yield sent(chunk, ids, held)
                    chunk, ids, held, n = chunk + 1, [], [], 0
        if ids:
            yield sent(chunk, ids, held)

    return documents.select("doc_id", "text").mapInArrow(run, _LISTS)


def _answers(lists: DataFrame, ranges: int) -> DataFrame:
    """To each list its elements that several documents hold, with how frequent they are; rows about documents as they are."""
    names = [x.split()[0] for x in _LISTS.split(", ")]
    width = -(-(1 << 32) // ranges) + 1

    def answered(r, rows):
        """One range: packed lists are all that is held of it, beside a number for each of its cells."""
        first = -(-(r << 32) // ranges)
        total = np.zeros(width, np.int64)
        unpacked = lambda row: np.cumsum(_unpacked(row["cells"], row["n"]), dtype=np.uint64).astype(np.int64) - first
        for row in rows:
            np.add.at(total, unpacked(row), 1)
        several = np.flatnonzero(total > 1)
        level = np.zeros(width, np.uint8)
        level[several] = np.minimum(4 * np.log2(total[several].astype(float)), 126) + 1
        for row in rows:
            at = unpacked(row)
            shared = np.flatnonzero(level[at])
            if len(shared):
                cells = (at[shared] + first).astype(np.uint32)
                docs = _unpacked(row["docs"], row["n"])[shared]
                yield (r, row["chunk"], len(shared), _packed(np.diff(cells, prepend=np.uint32(0))), _packed(docs), _packed(level[at[shared]].astype(np.uint32)), None)

    def run(batches):
        at, rows = None, []
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

        def flushed():
            made = list(answered(at, rows)) if rows else []
            for lo in range(0, len(made), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[lo : lo + 256], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            where = batch.column(0).to_numpy()
            if (where < 0).any():
                yield batch.filter(pa.array(where < 0))
            for row in batch.filter(pa.array(where >= 0)).to_pylist():
                if row["range"] != at:
                    yield from flushed()
                    at, rows = row["range"], []
                rows.append(row)
        yield from flushed()

    return lists.repartition(_parts(lists), "range").sortWithinPartitions("range").mapInArrow(run, _LISTS)


def _prefixes(answers: DataFrame, similarity: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), and what others hold of the prefix (null if nothing) with a digest of its group."""
    schema = "doc_id long, n_shingles long, digest binary, prefix binary, group binary"

    def documents(rows):
        about = next(r for r in rows if r["range"] < 0)
        ids, sizes = np.frombuffer(about["cells"], np.int64), np.frombuffer(about["docs"], np.int64)
        lists = [r for r in rows if r["range"] >= 0]
        prefix: list = [None] * len(ids)
        if lists:
            # document, level and cell in one number, sorted; a chunk has fewer than 2**24 documents
            held = lambda r: (_unpacked(r["docs"], r["n"]).astype(np.uint64) << np.uint64(40)) | (_unpacked(r["levels"], r["n"]).astype(np.uint64) << np.uint64(32))
            every = np.concatenate([held(r) | np.cumsum(_unpacked(r["cells"], r["n"]), dtype=np.uint64) for r in lists])
            every.sort()
            docs, key = (every >> np.uint64(40)).astype(np.int64), (every & np.uint64((1 << 40) - 1)).astype(np.int64) << 8
            starts = np.maximum.accumulate(np.where(np.r_[False, every[1:] == every[:-1]], 0, np.arange(len(every))))
            key += np.minimum(np.arange(len(every)) - starts, 255)  # shingles of one document that share a cell
            found, first, held = np.unique(docs, return_index=True, return_counts=True)
            for i, lo, n in zip(found.tolist(), first, held, strict=True):
                taken = prefix_length(int(sizes[i]), similarity) - (int(sizes[i]) - n)  # those nobody else holds come first
                if taken > 0:
                    prefix[i] = key[lo : lo + taken].tobytes()
        for i, n in enumerate(sizes.tolist()):
            digest = about["digests"][16 * i : 16 * i + 16] if n else None
            group = hashlib.blake2b(prefix[i], digest_size=16, salt=n.to_bytes(8, "little")).digest() if prefix[i] else None
            yield None if ids[i] == np.iinfo(np.int64).min else int(ids[i]), n, digest, prefix[i], group

    def run(batches):
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]

        def flushed(rows):
            made = list(documents(rows))
            for lo in range(0, len(made), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[lo : lo + 2_000], strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        at, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != at:
                    if rows:
                        yield from flushed(rows)
                    at, rows = row["chunk"], []
                rows.append(row)
        if rows:
            yield from flushed(rows)

    return answers.repartition(_parts(answers), "chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


def sketch(documents: DataFrame, size: int, similarity: int) -> DataFrame:
    """doc_id, n_shingles, digest, prefix and group of every document."""
    n_bytes = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranges = min(max(n_bytes // RANGE_BYTES, LEAST_RANGES), MOST_RANGES)
    return _prefixes(_answers(_lists(documents, size, ranges), ranges), similarity)


def _elements(groups: DataFrame) -> DataFrame:
    """(key, gid): a row for each element of a group's prefix."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(1)
            for lo, hi in slices([len(b) for b in blobs.to_pylist()]):
                own = blobs.slice(lo, hi - lo).to_pylist()
                keys = np.frombuffer(b"".join(own), np.int64)
                gid = np.repeat(batch.column(0).to_numpy()[lo:hi], [len(b) // 8 for b in own])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(gid)], names=["key", "gid"])

    return groups.select("gid", "prefix").mapInArrow(run, "key long, gid long")


def _overlaps(prefixes: list[np.ndarray]) -> np.ndarray:
    """How many elements each two prefixes share; a prefix shares all of its own with itself, as two members of one group do."""
    m = len(prefixes)
    owner = np.repeat(np.arange(m), [len(p) for p in prefixes])
    _, inverse, counts = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    shared = counts > 1
    live = shared[inverse]
    owner, column = owner[live], (np.cumsum(shared) - 1)[inverse[live]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    step = max(1, 8_000_000 // m)
    for lo in range(0, int(shared.sum()), step):
        part = slice(*np.searchsorted(column, [lo, lo + step]))
        held = np.zeros((m, min(step, int(shared.sum()) - lo)), np.float32)
        held[owner[part], column[part] - lo] = 1
        out += held @ held.T
    np.fill_diagonal(out, [len(p) for p in prefixes])
    return out.astype(np.int64)


def passing(prefixes: list[np.ndarray], n: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of groups can reach the similarity, by their sizes and the shared parts of their prefixes."""
    rest = n - prefix_length(n, similarity)
    last = np.array([p[-1] for p in prefixes])
    # what one set has beyond the prefix that ends first is all that the prefixes do not show
    most = _overlaps(prefixes) + np.where(last[:, None] <= last, rest[:, None], rest)
    need = -(-similarity * (n[:, None] + n) // (100 + similarity))
    return (most >= need) & (100 * np.minimum(n[:, None], n) >= similarity * np.maximum(n[:, None], n))


def _able(part, similarity: int) -> np.ndarray:
    """Which members of a block can be linked: groups are compared, then expanded to members."""
    gids, first, own = np.unique(part.column("gid").to_numpy(), return_index=True, return_inverse=True)
    blobs = part.column("prefix")
    pairs = passing([np.frombuffer(blobs[int(i)].as_py(), np.int64) for i in first], part.column("n_shingles").to_numpy()[first], similarity)
    pairs = pairs[own][:, own]
    side = part.column("side").to_numpy()
    np.fill_diagonal(pairs, False)
    return pairs & ((side[:, None] != side) | (side[:, None] < 0))


_MEMBER = ["g", "h", "rep", "side", "comp", "gid", "n_shingles", "prefix", "digest"]
_KINDS = "g long, h long, rep long, side long, comp long, gid long, n_shingles long, prefix binary, digest binary"


def _blocks(batches):
    """The blocks (g, h) of sorted rows."""
    for part in _whole_groups(batches, 2):
        group = _group_ids(part, 2)
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield part.slice(lo, hi - lo)


def _screen(rows: DataFrame, similarity: int) -> DataFrame:
    """The members that have a partner of another component whose group passes with theirs."""

    def run(batches):
        for part in _blocks(batches):
            comp = part.column("comp").to_numpy()
            live = (_able(part, similarity) & (comp[:, None] != comp)).any(1)
            if live.any():
                yield from part.filter(pa.array(live)).combine_chunks().to_batches()

    return rows.select(*_MEMBER).repartition(_parts(rows), "g", "h").sortWithinPartitions("g", "h", "rep").mapInArrow(run, _KINDS)


def _once(members: DataFrame) -> DataFrame:
    """Blocks without those that hold the same members as another one, met over another pivot."""
    members = materialise(members, "screened")
    sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "rep", F.lit(1))).alias("y")]
    first = members.groupBy("g", "h").agg(*sums).groupBy("n", "x", "y").agg(F.min(F.struct("g", "h")).alias("b")).select("b.*")
    return members.join(first, ["g", "h"], "left_semi").select(*members.columns)


def _confirm(members: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Confirmed links (a, b), a spanning forest of each block, from the members' whole texts."""

    def links(part):
        whole = part.column("text").to_pylist()
        sets: list = []
        for lo, hi in slices([len(t) for t in whole]):
            sets += sets_of(whole[lo:hi], size)
        own = [_digest(s) for s in sets]
        same = np.array([a == b for a, b in zip(own, part.column("digest").to_pylist(), strict=True)])  # an id may have several texts
        part, sets = part.filter(pa.array(same)), [s for s, ok in zip(sets, same, strict=True) if ok]
        if part.num_rows < 2:
            return
        able, ids = _able(part, similarity), part.column("rep").to_numpy()
        root = np.unique(part.column("comp").to_numpy(), return_inverse=True)[1]
        n = np.array([len(s) for s in sets])
        for i in range(len(ids) - 1):
            for k in i + 1 + np.flatnonzero(able[i, i + 1 :] & (root[i + 1 :] != root[i])):
                if root[k] == root[i]:
                    continue
                common = np.isin(sets[i], sets[k], assume_unique=True).sum()
                if 100 * common >= similarity * (n[i] + n[k] - common):
                    root[root == root[k]] = root[i]
                    yield ids[i], ids[k]

    def run(batches):
        for part in _blocks(batches):
            found = list(links(part))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = members.join(texts, "rep").select(*_MEMBER, "text")
    return rows.repartition(_parts(rows), "g", "h").sortWithinPartitions("g", "h", "rep").mapInArrow(run, "a long, b long")


def _n_blocks(n, weight, block: int):
    """Blocks of ``n`` documents whose sets hold ``weight`` shingles."""
    return F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("long")


def jaccard_join(documents: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = materialise(sketch(source, size, similarity), "sketches")
    named = docs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("group").alias("group"), F.first("prefix").alias("prefix"))
    classes = materialise(classes, "classes")

    # a group: equal prefixes and sizes
    groups = classes.where("group IS NOT NULL").groupBy("group").agg(
        F.min("rep").alias("gid"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix")
    )
    groups = materialise(groups, "groups")
    elements = _elements(groups)
    crowded = elements.groupBy("key").agg(F.min("gid").alias("pivot"), F.max("gid").alias("top")).where("pivot <> top").drop("top")
    crowded = materialise(crowded, "crowded")  # a join of two plain shuffles, so Spark can split a hot element
    stars = elements.join(crowded, "key").where("gid <> pivot").select("pivot", "gid").distinct()
    alone = groups.where("members > 1").select(F.col("gid").alias("pivot"), "gid")
    stars = materialise(stars.unionByName(alone), "stars")
    heads = stars.select("pivot").distinct().select("pivot", F.col("pivot").alias("gid"))
    met = materialise(stars.unionByName(heads).distinct(), "met")
    own = classes.select("rep", "digest", "group").join(groups.select("group", "gid").join(met.select("gid").distinct(), "gid"), "group")
    rows = met.join(own.select("gid", "rep", "digest"), "gid").join(groups.select("gid", "n_shingles", "prefix"), "gid")
    rows = materialise(rows.select(F.col("pivot").alias("g"), "gid", "rep", "n_shingles", "prefix", "digest"), "members")
    sums = rows.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("weight"))
    several = materialise(sums.select("g", _n_blocks(F.col("rows"), F.col("weight"), block).alias("blocks")).where("blocks > 1"), "several")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    placed = rows.join(several, "g", "left").withColumn("blocks", blocks)
    large = materialise(placed.where("blocks > 1").drop("blocks"), "large")
    # the pivot is in all blocks
    at = F.when(F.col("rep") == F.col("g"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    placed = placed.withColumns({"side": F.lit(-1).cast("long"), "comp": F.col("rep"), "h": F.explode(at)})
    members = materialise(_once(_screen(placed, similarity)), "screened")
    wanted = materialise(members.select("rep").unionByName(large.select("rep")).distinct(), "wanted")
    texts = materialise(source.withColumnRenamed("doc_id", "rep").join(wanted, "rep"), "texts")
    links = materialise(_confirm(members, texts, size, similarity), "links")
    found, more = components(links), []
    if not large.isEmpty():
        more = [materialise(_across_blocks(large, found, texts, size, similarity, block), "links")]
    repeated = _repeated(named, classes)
    if repeated is not None:
        more.append(repeated)
    for extra in more:
        links = links.unionByName(extra)
    if more:
        found = components(links)

    ends = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left")
    ends = materialise(ends.select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    for done in (classes, groups, crowded, stars, met, rows, several, large, members, wanted, texts, *more):
        discard(done)
    out = named.select("doc_id", "n_shingles", "digest").join(ends, "digest").drop("digest")
    rest = docs.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def _repeated(named: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between a repeated id and the classes of its different texts; none in most tables."""
    twice = named.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc_id")
    twice = materialise(twice, "repeated")
    if twice.isEmpty():
        return None
    own = named.select("doc_id", "digest").join(twice, "doc_id").distinct()
    return materialise(own.join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")


def _across_blocks(large: DataFrame, found: DataFrame, texts: DataFrame, size: int, similarity: int, block: int) -> DataFrame:
    """Confirmed links between blocks, for members that are not in one component yet.

    The largest component of a pivot's members is settled within itself: blocks of members
    outside it (side 0) meet the blocks of all members (side 1).
    """
    rows = large.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    rows = materialise(rows, "large")
    main = rows.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).groupBy("g").agg(
        F.max_by(F.struct("comp", "n", "w"), F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.sum("w").alias("weight"), F.count("*").alias("comps")
    )
    main = materialise(main.where("comps > 1"), "main")  # a row a large group
    rows = rows.join(main, "g")
    n_all = _n_blocks(F.col("all"), F.col("weight"), block)
    n_loose = _n_blocks(F.col("all") - F.col("main.n"), F.col("weight") - F.col("main.w"), block)
    place, loose = F.pmod(F.xxhash64("rep"), n_all), F.pmod(F.xxhash64("rep", F.lit(1)), n_loose)
    given = [c for c in _MEMBER if c not in ("h", "side")]
    outside = rows.where(F.col("comp") != F.col("main.comp"))
    left = outside.select(*given, F.lit(0).cast("long").alias("side"), F.explode(F.transform(F.sequence(F.lit(0), n_all - 1), lambda j: loose * n_all + j)).alias("h"))
    right = rows.select(*given, F.lit(1).cast("long").alias("side"), F.explode(F.transform(F.sequence(F.lit(0), n_loose - 1), lambda i: i * n_all + place)).alias("h"))
    members = materialise(_screen(left.unionByName(right), similarity), "screened")
    return _confirm(members, texts, size, similarity)


def op11_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 2, len(w))], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
