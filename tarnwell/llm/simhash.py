"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments: of at most four differing
bits, some segment has at most one.  The index holds each segment with one bit
left out, for each of its bits, so that entries of equal key differ in that bit
of the segment at most; pairs that meet are verified on all 64 bits.

Documents meet only as distinct fingerprints: copies, however many, are one row
of the index.  Groups of near copies are first joined through leaders, so that
only pairs across such classes are left to be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, drawn, give_back, saved, small
from .components import stars
from .packed import across, bucket_count, by_bucket, joined

SEED = 42
MAX_BITS = 4
#: First bit and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Index entries of a bucket, about, at most.
BUCKET_ENTRIES = 2_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int) -> int:
    """The signed 64-bit fingerprint; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last, strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the bits that over half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprint_column(shingle: int):
    @F.arrow_udf(T.LongType())
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return fingerprints


def _bits(x: Column, segment: tuple[int, int]) -> Column:
    low, width = segment
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def _leader_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links to the leaders of a fingerprint's three segments: of those that have a segment in
    common the smallest, the largest and one by chance lead.  Three segments have nine leaders."""
    seg = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bits(F.col("fp"), s).alias("part")) for k, s in enumerate(SEGMENTS)]))
    whole = fps.select("fp", seg.alias("s")).select("fp", "s.k", "s.part")
    some = F.min(F.struct(F.xxhash64("fp").alias("h"), "fp"))["fp"]
    first = whole.groupBy("k", "part").agg(F.count("*").alias("n"), F.array(F.min("fp"), F.max("fp"), some).alias("leaders"))
    first = saved(first.where("n > 1").select(F.col("k").alias("lk"), F.col("part").alias("lp"), "leaders"), "leaders")
    met = whole.join(first, (F.col("k") == F.col("lk")) & (F.col("part") == F.col("lp"))).select("fp", F.explode("leaders").alias("v"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    return met.where((bits > 0) & (bits <= max_bits)).select(F.col("fp").alias("u"), "v").distinct()


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The deletion variants of fingerprints: keys (a bit and its segment without it), and whose each is."""
    bits = np.arange(64, dtype=np.uint64)
    cleared = fps.view(np.uint64)[:, None] & ~(np.uint64(1) << bits)[None, :]
    keys = np.empty(cleared.shape, dtype=np.uint32)
    for low, width in SEGMENTS:
        own = slice(low, low + width)
        keys[:, own] = (cleared[:, own] >> np.uint64(low)) & np.uint64((1 << width) - 1)
    keys |= (np.arange(64, dtype=np.uint32) << np.uint32(22))[None, :]
    return keys.ravel(), np.repeat(np.arange(len(fps)), 64)


def _links_across(classes: DataFrame, max_bits: int) -> DataFrame:
    """All pairs of ``classes(fp, class)`` of different classes that share a variant and differ in at most ``max_bits`` bits.

    Two that differ in at most four bits share a segment but for one bit at most, so they share a variant.
    """
    buckets = bucket_count(classes.sparkSession, 64 * classes.count(), BUCKET_ENTRIES)

    def sent(batches):
        for batch in batches:
            fps, own = (np.asarray(batch.column(k)).astype(np.int64) for k in range(2))
            for a in range(0, len(fps), 10_000):
                keys, at = variants(fps[a : a + 10_000])
                bucket = (keys * np.uint32(0x9E3779B1) >> np.uint32(1)) % np.uint32(buckets)
                yield from by_bucket(bucket, {"keys": keys, "fps": fps[a : a + 10_000][at], "classes": own[a : a + 10_000][at]})
        give_back()

    def met(table: pa.Table) -> pa.Table:
        keys, fps, own = (joined(table.column(c), kind) for c, kind in (("keys", "<u4"), ("fps", "<i8"), ("classes", "<i8")))
        found = [np.zeros((2, 0), np.int64)]
        for x, y in across(keys, own):
            near = np.bitwise_count((fps[x] ^ fps[y]).view(np.uint64)) <= max_bits
            found.append(np.unique(np.stack([fps[x[near]], fps[y[near]]]), axis=1))
        give_back()
        return pa.Table.from_arrays([pa.array(c) for c in np.unique(np.concatenate(found, axis=1), axis=1)], names=["u", "v"])

    entries = classes.select("fp", "class").mapInArrow(sent, "bucket int, keys binary, fps binary, classes binary")
    return entries.groupBy("bucket").applyInArrow(met, "u long, v long")


def linked(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Stars ``(u, v)`` of the distinct values of ``fp`` under links of at most ``max_bits`` (at most 4) bits.

    Every value but a component's smallest stands with that smallest.  Large
    groups are joined through leaders first, by a number of links that follows
    their size; then only pairs of values of different classes are compared, all
    of them that share a variant.  So a group of near copies is never paired out.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("three segments find up to 4 differing bits")
    fps = fingerprints.select("fp")
    near = stars(_leader_links(fps, max_bits))
    classes = saved(fps.join(near, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("class")), "classes")
    more = saved(_links_across(classes, max_bits), "across")
    discard(classes)
    return stars(near.unionByName(more))


def groups(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    Null and empty texts have the fingerprint 0 and are linked like others.
    ``component_id`` is the smallest doc_id that can be reached; rows whose
    doc_id is null count as members but name a component only if no row of it
    has an id (then null).  Other columns are ignored.
    """
    fps = saved(docs.select("doc_id", fingerprint_column(shingle)("text").alias("fp")), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = linked(distinct, max_bits)
    rooted = distinct.join(star, F.col("fp") == F.col("u"), "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("root")
    )
    names = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller id.

    Rows that repeat the id that stays are the same document and stay with it;
    rows without an id always stay.
    """
    gone = groups(docs, shingle, max_bits).where(F.col("doc_id") > F.col("component_id"))
    gone = saved(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")


# Near-duplicates by the similarity of shingle sets ------------------------------

#: Jaccard similarity of the shingle sets from which documents are near-duplicates, as a fraction.
LEAST = (4, 5)
#: Differing bits up to which fingerprints that share a variant make a pair to be compared in full.
NEAR_BITS = 8
#: Bands of a document and minima in each, for the first links of large groups, and nodes
#: of a band from which it is large.
BANDS = 8
MINIMA = 3
LARGE = 16
#: Documents in which common shingles are looked for, about, in how many of them one must
#: be, and how many are told to every task.  They only move shingles in the order in which a
#: document's are indexed; the pairs found are the same with any order.
COMMON_ROWS = 4_000
COMMON_IN = 4
COMMON = 200_000
#: Indexed shingles that two similar sets must share (or all of the fewer that they must
#: share in all); the index is that much longer, and pairs that meet by chance are fewer.
SHARED = 10
#: Index entries of a bucket in which pairs are looked for: a pair is written once a bucket.
PAIR_ENTRIES = 250_000
#: Ids of documents to be compared that are sent to every task, at most.
ASKED = 500_000
_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 2**63, BANDS * MINIMA, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
#: 64-bit words of the signature of the shingles before one.
WORDS = 4
_ENTRIES = {"keys": "<i8", "nodes": "<i8", "comps": "<i8", "sizes": "<i4", "places": "<i4", "can": "<i4", "ranks": "<i4", "before": "<u8"}
_PAIRS = pa.schema([(c, pa.int64()) for c in ("u", "v", "need", "n")])


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """The word shingles of a text (of all its words, if fewer)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    stops = [e - 1 for e in ends[min(shingle, len(words)) - 1 :]] if words else [0]
    return {line[a:b] for a, b in zip(starts[:n], stops, strict=False)}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, shingle)], dtype=np.uint64))


def similar(a: set, b: set, least: tuple[int, int] = LEAST) -> bool:
    both = len(a & b)
    return both * least[1] >= least[0] * (len(a) + len(b) - both)


def indexed(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """The shingles under which a set is found: the first in an order that all documents share.

    Sets that are similar enough have SHARED shingles in common among these,
    whatever the order; here common shingles come last.
    """
    known, counts = common
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    n = len(hashes) + -(least[0] * len(hashes)) // least[1] + SHARED
    return hashes[np.lexsort((hashes, rank))[:n]]


def _bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: of its minima and its number."""
    minima = np.full(len(_FLIPS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        x = (hashes[None, a : a + 4096] ^ _FLIPS[:, None]) * _FACTORS[:, None]
        minima = np.minimum(minima, (x ^ (x >> np.uint64(31))).min(1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in minima.reshape(BANDS, MINIMA).T:
        keys = (keys ^ part) * _FACTORS[0]
        keys = keys ^ (keys >> np.uint64(29))
    return keys.view(np.int64)


def _common_shingles(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, in order, of shingles common among some documents, and in how many they are."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py(), shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))

    ids = F.broadcast(drawn(slim, COMMON_ROWS, slim.count(), 11).withColumnRenamed("doc_id", "_id"))
    some = slim.join(ids, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"))
    counts = some.select(F.explode(hashes("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_IN)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    known, n = np.asarray(found.column("h")).astype(np.int64).view(np.uint64), np.asarray(found.column("n")).astype(np.int64)
    order = np.argsort(known)
    return known[order], n[order]


def _large_pairs(nodes: DataFrame) -> DataFrame:
    """Nodes that share a band with LARGE nodes or more, each with the smallest of them."""
    whole = nodes.select("node", F.explode("bands").alias("key"))
    first = whole.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("u"), F.count("*").alias("n")).where(F.col("n") >= LARGE)
    met = whole.join(first, F.col("key") == F.col("k")).where(F.col("node") != F.col("u"))
    return met.select("u", F.col("node").alias("v")).distinct()


def _nodes_of(links: DataFrame, owners: DataFrame) -> DataFrame:
    """Links of fingerprints as pairs ``(u, v)`` of the nodes that ``owners(fp, owner)`` name."""
    left, right = (owners.select(F.col("fp").alias(f"{c}f"), F.col("owner").alias(f"{c}n")) for c in "uv")
    met = links.join(left, F.col("u") == F.col("uf")).join(right, F.col("v") == F.col("vf")).where("un <> vn")
    return met.select(F.least("un", "vn").alias("u"), F.greatest("un", "vn").alias("v")).distinct()


def fingerprint_links(nodes: DataFrame, slim: DataFrame, shingle: int, least: tuple[int, int] = LEAST, max_bits: int = NEAR_BITS) -> DataFrame:
    """Stars ``(u, v)`` of similar nodes by their fingerprints: ``nodes(node, fp, bands)``.

    Nodes of one fingerprint meet its smallest node, and fingerprints the
    leaders of their segments; then those of different classes meet that share
    a variant and differ in at most ``max_bits`` bits.  Whatever meets is
    compared in full, so no dissimilar pair is linked.  Bands only join large
    groups beforehand, lest they be paired out.
    """
    owners = saved(nodes.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
    same = nodes.join(owners.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("node <> owner").select(F.col("owner").alias("u"), F.col("node").alias("v"))
    leaders = _nodes_of(_leader_links(owners.select("fp"), max_bits), owners)
    pairs = saved(same.unionByName(leaders).unionByName(_large_pairs(nodes)).distinct(), "pairs")
    first = stars(_similar_pairs(pairs, slim, shingle, least))
    discard(pairs)
    classed = owners.join(first, F.col("owner") == F.col("u"), "left").select("fp", F.coalesce("v", "owner").alias("class"))
    classes = saved(classed, "classes")
    pairs = saved(_nodes_of(_links_across(classes, max_bits).distinct(), owners), "pairs")
    found = stars(first.unionByName(_similar_pairs(pairs, slim, shingle, least)))
    for done in (owners, classes, pairs):
        discard(done)
    return found


def _signatures(keys: np.ndarray) -> np.ndarray:
    """For each of a node's keys, in order, the bits of those before it."""
    bit = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(64 * WORDS)
    own = np.zeros((len(keys), WORDS), np.uint64)
    own[np.arange(len(keys)), bit >> np.uint64(6)] = np.uint64(1) << (bit & np.uint64(63))
    out = np.zeros_like(own)
    out[1:] = np.bitwise_or.accumulate(own, axis=0)[:-1]
    return out


def _pairs_of_keys(keys, nodes, comps, sizes, places, can, ranks, before, least) -> np.ndarray:
    """Pairs of different components that meet and can be similar enough: smaller node,
    larger node, how many keys they must have in common, how many of these they have."""
    found = [np.zeros((4, 0), np.int64)]
    # keys before one that share a bit with another key before it
    hidden = ranks - np.bitwise_count(before).sum(1)
    for x, y in across(keys, comps):
        must = -(-least[0] * (sizes[x] + sizes[y]) // (least[0] + least[1]))
        room = np.minimum(sizes[x] - places[x], sizes[y] - places[y])
        # of one of the two, all that is shared and not indexed comes after its index in the order
        fits = (room + SHARED - 1 >= must) & (np.maximum(can[x], can[y]) >= must)
        x, y, must, room = x[fits], y[fits], must[fits], room[fits]
        # what is shared before this key, at most, and from it on must do
        earlier = np.bitwise_count(before[x] & before[y]).sum(1) + np.minimum(hidden[x], hidden[y])
        fits = room + np.minimum(earlier, SHARED - 1) >= must
        x, y, need = nodes[x[fits]], nodes[y[fits]], np.minimum(must[fits], SHARED)
        pairs, times = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), need]), axis=1, return_counts=True)
        found.append(np.concatenate([pairs, times[None]]))
    return np.concatenate(found, axis=1)


def _rows_of(batch: pa.RecordBatch, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists, and the row of each."""
    column = batch.column(lists)
    return np.asarray(column.flatten()), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(column.offsets)))


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)


def _met_keys(placed: DataFrame, buckets: int) -> DataFrame:
    """``met_node, met``: those of a node's indexed shingles that a node of another component has in its index too."""

    def sent(batches):
        for batch in batches:
            keys, row = _rows_of(batch, 2)
            nodes, comps = (np.asarray(batch.column(k))[row] for k in range(2))
            yield from by_bucket(_buckets_of(keys, buckets), {"keys": keys, "nodes": nodes, "comps": comps})
        give_back()

    def told(table: pa.Table) -> pa.Table:
        keys, nodes, comps = (joined(table.column(c), "<i8") for c in ("keys", "nodes", "comps"))
        order = np.lexsort((comps, keys))
        keys, nodes, comps = keys[order], nodes[order], comps[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys)).astype(np.int64)
        several = np.repeat(comps[starts] != comps[ends - 1], ends - starts) if len(keys) else np.zeros(0, bool)
        order = np.argsort(nodes[several], kind="stable")
        keys, nodes = keys[several][order], nodes[several][order]
        starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(nodes)).astype(np.int32)), pa.array(keys))
        out = pa.Table.from_arrays([pa.array(nodes[starts]), lists], names=["node", "keys"])
        give_back()
        return out

    rows = placed.select("node", "comp", "prefix").mapInArrow(sent, "bucket int, keys binary, nodes binary, comps binary")
    met = rows.groupBy("bucket").applyInArrow(told, "node long, keys array<long>")
    return met.groupBy(F.col("node").alias("met_node")).agg(F.flatten(F.collect_list("keys")).alias("met"))


def _partnered(placed: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``node, comp, size, can, prefix, met`` of the nodes that may have a partner in another component.

    A round over the index tells which of a node's indexed shingles anyone of
    another component has; nodes with too few have no partner.  ``can`` is how
    many shingles a node can share: those, and all that aren't indexed.
    """
    entries = placed.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    own = F.col("size")
    needed = F.least(F.lit(SHARED), F.ceil(own * least[0] / least[1]))
    met = _met_keys(placed, bucket_count(placed.sparkSession, entries, BUCKET_ENTRIES))
    alive = placed.join(met, F.col("node") == F.col("met_node")).where(F.size("met") >= needed)
    can = (own - F.size("prefix") + F.size("met")).cast("int")
    return saved(alive.select("node", "comp", "size", can.alias("can"), "prefix", "met"), "alive")


def _met_pairs(alive: DataFrame, least: tuple[int, int]) -> DataFrame:
    """All pairs ``(u, v)`` of nodes of different components that can be similar enough.

    A pair is left out as soon as what comes before and after a shared shingle is too little.
    """
    entries = alive.agg(F.sum(F.size("met")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-entries // PAIR_ENTRIES))

    def sent(batches):
        for batch in batches:
            parts = []
            for node, comp, size, most, prefix, own_met in zip(*(batch.column(k) for k in range(6)), strict=True):
                prefix = np.asarray(prefix.values)
                at = np.flatnonzero(np.isin(prefix, np.asarray(own_met.values)))
                n = len(at)
                one = [np.full(n, v.as_py(), np.int64) for v in (node, comp, size, most)]
                parts.append((prefix[at], one[0], one[1], one[2], at, one[3], np.arange(n), _signatures(prefix[at])))
            if parts:
                columns = dict(zip(_ENTRIES, map(np.concatenate, zip(*parts, strict=True)), strict=True))
                bucket = _buckets_of(columns["keys"], buckets)
                yield from by_bucket(bucket, {c: x.astype(_ENTRIES[c]) for c, x in columns.items()})
        give_back()

    def paired(table: pa.Table) -> pa.Table:
        columns = {c: joined(table.column(c), kind) for c, kind in _ENTRIES.items()}
        before = columns.pop("before").reshape(-1, WORDS)
        pairs = _pairs_of_keys(*[x.astype(np.int64) for x in columns.values()], before, least)
        give_back()
        return pa.Table.from_arrays([pa.array(x) for x in pairs], schema=_PAIRS)

    rows = alive.mapInArrow(sent, f"bucket int, {', '.join(f'{c} binary' for c in _ENTRIES)}")
    found = rows.groupBy("bucket").applyInArrow(paired, "u long, v long, need long, n long").where("u < v")
    return found.groupBy("u", "v").agg(F.min("need").alias("need"), F.sum("n").alias("n")).where("n >= need").select("u", "v")


def _similar_pairs(pairs: DataFrame, slim: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts' shingle sets are similar enough, compared in full."""

    @F.arrow_udf(T.BooleanType())
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out, before, kept = [], None, None
        for a, b in zip(left, right, strict=True):
            a = a.as_py()
            if kept is None or a != before:
                before, kept = a, shingles(a, shingle)
            out.append(similar(kept, shingles(b.as_py(), shingle), least))
        kept = None
        give_back()
        return pa.array(out, pa.bool_())

    # only texts of documents in question travel; their ids are sent to the tasks if they are few
    asked = pairs.select(F.col("u").alias("asked")).unionByName(pairs.select(F.col("v").alias("asked"))).distinct()
    texts = slim.join(small(asked, ASKED), F.col("doc_id") == F.col("asked"), "left_semi")
    left, right = (texts.select(F.col("doc_id").alias(f"{c}n"), F.col("text").alias(f"{c}t")) for c in "uv")
    both = pairs.join(left, F.col("u") == F.col("un")).join(right, F.col("v") == F.col("vn"))
    return both.where(alike("ut", "vt")).select("u", "v")


def similar_groups(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """``doc_id, component_id`` of near-duplicates by the Jaccard similarity of shingle sets.

    Every pair of documents whose sets have a similarity of ``least`` or more is
    linked, and no other pair.  Documents first meet by the deletion variants of
    their SimHash fingerprints (:func:`fingerprint_links`), and those that meet
    are compared in full.  Similar sets whose fingerprints differ too much are
    then looked for across the groups so found, exactly: a document is indexed
    under the first of its shingles, so many that two similar sets must share
    SHARED of them, and pairs that do are compared in full.  Documents without
    an id take no part; null and empty texts are alike.
    """
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = slim.sparkSession.sparkContext.broadcast(_common_shingles(slim, shingle))

    @F.arrow_udf("struct<digest: binary, size: int, fp: long, prefix: array<long>, bands: array<long>>")
    def sets(texts: pa.Array) -> pa.Array:
        digest, size, fp, prefix, bands = [], [], [], [], []
        for t in texts:
            h = shingle_hashes(t.as_py(), shingle)
            digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            size.append(len(h))
            fp.append(majority(h))
            prefix.append(indexed(h, common.value, least).view(np.int64))
            bands.append(_bands(h))
        longs = pa.list_(pa.int64())
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(prefix, longs), pa.array(bands, longs)],
            names=["digest", "size", "fp", "prefix", "bands"],
        )

    fps = saved(slim.select("doc_id", sets("text").alias("s")).select("doc_id", "s.*"), "sets")
    nodes = saved(fps.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("size", "fp", "prefix", "bands")]), "nodes")
    near = fingerprint_links(nodes.select("node", "fp", "bands"), slim, shingle, least)
    placed = saved(nodes.join(near, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("comp"), "size", "prefix"), "placed")
    alive = _partnered(placed, least)
    discard(placed)
    pairs = saved(_met_pairs(alive, least), "pairs")
    discard(alive)
    final = stars(near.unionByName(_similar_pairs(pairs, slim, shingle, least)))
    named = nodes.join(final, F.col("node") == F.col("u"), "left").select(F.col("digest").alias("d"), F.coalesce("v", "node").alias("component_id"))
    return fps.join(named, F.col("digest") == F.col("d")).select("doc_id", "component_id")


def similar_dedup(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with the smallest id of each group of :func:`similar_groups`; rows
    that repeat it, and rows without an id, stay too."""
    gone = similar_groups(docs, shingle, least).where(F.col("doc_id") > F.col("component_id"))
    gone = saved(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(gone, F.col("_row.doc_id").cast("long") == F.col("_gone"), "left_anti").select("_row.*")
