"""Repeated passages across documents, by fixed-block anchors.

Any run of ``window`` words holds, wherever it starts, a whole block of
``window // 2 + 1`` words that begins at a multiple of the block's length in
the document it is taken from.  So the non-overlapping blocks of every document
are the index and every rolling window of a block's length probes it; around
the hits, runs are extended word by word to ``window`` words and matched
against the smallest document that has them; what overlaps joins up to maximal
exact repeats.

Both rounds move packed arrays instead of rows: a task works through its
documents in chunks, settles what repeats within the chunk there, and sends one
entry for each distinct hash to the hash's bucket.  A passage that a third of
all documents share therefore sends one entry a chunk, not one a document.

In the first round a bucket tells entries apart by half a hash: what meets by
chance there is only looked at in vain.  The second round decides, by 96 bits of each
window besides its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, saved, word_count, worker_state
from .packed import bucket_count

#: Words of a chunk.
CHUNK_WORDS = 500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Words whose windows a bucket holds, about, at most.
BUCKET_WORDS = 4_000_000
NONE = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Key of an entry of the second round: half a hash, and another one.
_WIDE = np.dtype([("low", "<u4"), ("more", "<u8")])

MESSAGE = "bucket int, kind int, keys binary, docs binary, counts binary, flags binary"
_MESSAGE = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("keys", "docs", "counts", "flags")]
)
FOUND = "doc_id long, keys array<long>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64()))])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_state("words", _Hashes)
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of every run of ``k`` entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= base
        out += hashes[i : i + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def full_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half of a hash, as the first round tells the entries of a bucket apart."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _grouped(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key (and more of it), where each group starts in it, and each entry's group."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    s = keys[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    if more is not None:
        first[1:] |= more[order][1:] != more[order][:-1]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def _by_doc(docs: np.ndarray, keys: np.ndarray, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """``FOUND`` rows, one for each document."""
    if not len(docs):
        return
    order, starts, _ = _grouped(docs)
    keys = keys[order].astype(np.int64)
    ends = np.append(starts[1:], len(docs))
    ids = docs[order][starts]
    for k in range(0, len(starts), rows):
        a, b = starts[k], ends[min(k + rows, len(starts)) - 1]
        offsets = np.append(starts[k : k + rows], b) - a
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + rows]), lists], schema=_FOUND)


def _messages(hashes, docs, flags, local_docs, local_keys, buckets, more=None) -> Iterator[pa.RecordBatch]:
    """Entries to their buckets (kind 0) and what the chunk found itself (kind 1).

    An entry's key is half its hash, and all of ``more``, a second hash, if given.
    """
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((docs, bucket))
    bucket, docs, flags = bucket[order], docs[order], flags[order]
    low = (hashes[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
    sent = low if more is None else np.rec.fromarrays([low, more[order]], dtype=_WIDE)
    rows = []
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        runs = np.flatnonzero(np.append(True, docs[a + 1 : b] != docs[a : b - 1]))
        counts = np.diff(np.append(runs, b - a)).astype("<u4")
        rows.append((int(bucket[a]), 0, sent[a:b].tobytes(), docs[a:b][runs].astype("<i8").tobytes(), counts.tobytes(), np.packbits(flags[a:b]).tobytes()))
    if len(local_docs):
        spread = local_docs % buckets
        order = np.argsort(spread, kind="stable")
        spread, local_docs, local_keys = spread[order], local_docs[order], local_keys[order]
        edges = np.flatnonzero(np.append(True, spread[1:] != spread[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(spread)), strict=True):
            rows.append((int(spread[a]), 1, local_keys[a:b].astype("<i8").tobytes(), local_docs[a:b].astype("<i8").tobytes(), b"", b""))
    for k in range(0, len(rows), 256):
        part = list(zip(*rows[k : k + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _MESSAGE, strict=True)], schema=_MESSAGE)


def _received(table: pa.Table, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, docs, flags, own_docs, own_keys = [], [], [], [], []
    for row in table.to_pylist():
        ids = np.frombuffer(row["docs"], "<i8")
        if row["kind"]:
            own_docs.append(ids)
            own_keys.append(np.frombuffer(row["keys"], "<i8"))
            continue
        sent = np.frombuffer(row["keys"], _WIDE if wide else "<u4")
        keys.append(sent)
        docs.append(np.repeat(ids, np.frombuffer(row["counts"], "<u4")))
        flags.append(np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(sent)).astype(bool))
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return joined(keys, _WIDE if wide else "<u4"), joined(docs, "<i8"), joined(flags, bool), joined(own_docs, "<i8"), joined(own_keys, "<i8")


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Groups of ``(doc_id, word hashes, ...)`` of about CHUNK_WORDS words."""
    chunk, words = [], 0
    for row in rows:
        chunk.append(row)
        words += len(row[1])
        if words >= CHUNK_WORDS:
            yield chunk
            chunk, words = [], 0
    if chunk:
        yield chunk


def _windows(chunk: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and position of each run of ``k`` words that stays in its document."""
    lengths = np.array([len(r[1]) for r in chunk], dtype=np.int64)
    hashes = rolling(np.concatenate([r[1] for r in chunk]), k)
    at = np.concatenate([np.arange(n) for n in lengths])[: len(hashes)]
    room = np.repeat(lengths, lengths)[: len(hashes)] - at
    docs = np.repeat(np.array([r[0] for r in chunk], dtype=np.int64), lengths)[: len(hashes)]
    inside = room >= k
    return hashes[inside], docs[inside], at[inside]


def _anchors(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """For every document the keys of its runs of ``block`` words that may lie in a shared passage."""

    def probed(batches):
        def rows():
            for batch in batches:
                for i, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield i.as_py(), word_hashes(words_of(text.as_py()))

        for chunk in _chunks(rows()):
            hashes, ids, at = _windows(chunk, block)
            if not len(hashes):
                continue
            order, starts, group = _grouped(hashes)
            hashes, ids, aligned = hashes[order], ids[order], (at % block == 0)[order]
            least, most = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
            indexed = np.minimum.reduceat(np.where(aligned, ids, NONE), starts)
            several = least < most
            # of a hash in several documents here: all of them are told here, its first indexed and its last one go on
            one, first = ~several, several & (indexed < NONE)
            h = hashes[starts]
            told = several[group]
            yield from _messages(
                np.concatenate([h[one], h[first], h[several]]),
                np.concatenate([least[one], indexed[first], most[several]]),
                np.concatenate([indexed[one] < NONE, np.ones(first.sum(), bool), np.zeros(several.sum(), bool)]),
                ids[told],
                full_key(hashes[told], buckets),
                buckets,
            )
        give_back()

    def matched(key, table):
        keys, ids, flags, own_docs, own_keys = _received(table)
        if len(keys):
            order, starts, group = _grouped(keys)
            keys, ids, flags = keys[order], ids[order], flags[order]
            first = np.minimum.reduceat(np.where(flags, ids, NONE), starts)[group]
            last = np.maximum.reduceat(ids, starts)[group]
            told = (first < last) & (ids >= first)
            own_docs = np.concatenate([own_docs, ids[told]])
            own_keys = np.concatenate([own_keys, (key[0].as_py() << 32) | keys[told].astype(np.int64)])
        yield from _by_doc(own_docs, own_keys)

    return docs.mapInArrow(probed, MESSAGE).groupBy("bucket").applyInArrow(_table_out(matched), FOUND)


def _table_out(function):
    """``applyInArrow`` wants a table."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        found = pa.Table.from_batches(list(function(key, table)), schema=_FOUND)
        give_back()
        return found

    return whole


def _collected(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_list("keys")).alias("_keys"))


def _repeats(candidates: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """For every document the second hashes of its runs of ``window`` words that a smaller document has."""

    def extended(batches):
        def rows():
            for batch in batches:
                for i, text, keys in zip(*batch.columns, strict=True):
                    yield i.as_py(), word_hashes(words_of(text.as_py())), np.asarray(keys.values)

        for chunk in _chunks(rows()):
            picked_hashes, picked_more, picked_docs = [], [], []
            for doc, hashes, keys in chunk:
                n = len(hashes) - window + 1
                if n <= 0:
                    continue
                hit = np.isin(full_key(rolling(hashes, block), buckets), keys)
                # a run qualifies if any of its blocks is an anchor
                seen = np.concatenate([[0], np.cumsum(hit)])
                starts = np.arange(n)
                near = np.flatnonzero(seen[starts + window - block + 1] > seen[starts])
                picked_hashes.append(rolling(hashes, window)[near])
                picked_more.append(rolling(hashes, window, _BASE_2)[near])
                picked_docs.append(np.full(len(near), doc, dtype=np.int64))
            if not picked_hashes:
                continue
            hashes, more, ids = np.concatenate(picked_hashes), np.concatenate(picked_more), np.concatenate(picked_docs)
            if not len(hashes):
                continue
            order, starts, group = _grouped(hashes, more)
            hashes, more, ids = hashes[order], more[order], ids[order]
            least = np.minimum.reduceat(ids, starts)
            later = ids > least[group]
            yield from _messages(hashes[starts], least, np.ones(len(starts), bool), ids[later], more[later].view(np.int64), buckets, more[starts])
        give_back()

    def matched(key, table):
        keys, ids, _, own_docs, own_keys = _received(table, wide=True)
        if len(keys):
            low, more = keys["low"].copy(), keys["more"].copy()
            order, starts, group = _grouped(more, low)
            more, ids = more[order], ids[order]
            later = ids > np.minimum.reduceat(ids, starts)[group]
            own_docs = np.concatenate([own_docs, ids[later]])
            own_keys = np.concatenate([own_keys, more[later].astype(np.uint64).view(np.int64)])
        yield from _by_doc(own_docs, own_keys)

    slim = candidates.select("doc_id", "text", "_keys")
    return slim.mapInArrow(extended, MESSAGE).groupBy("bucket").applyInArrow(_table_out(matched), FOUND)


def spans(hashes: np.ndarray, keys: np.ndarray, window: int) -> np.ndarray:
    """A mask of the words in maximal repeats, from the second hashes of repeated windows."""
    n = len(hashes)
    covered = np.zeros(n + 1, dtype=np.int64)
    if len(keys) and n >= window:
        hit = np.flatnonzero(np.isin(rolling(hashes, window, _BASE_2).view(np.int64), keys))
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return np.cumsum(covered[:-1]) > 0


def dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_removed`` and ``_kept`` (the kept words, joined by a space).

    A word goes if some window of ``window`` words that covers it also starts
    in a document with a smaller doc_id, as the documents came.  Null and empty
    texts have no words.  Rows that repeat a doc_id are one document's and
    don't remove from each other; rows with a null doc_id keep all their words
    and remove nothing.  Documents each of whose rows has the same text as a
    smaller document are settled by a digest of the text and take no part in
    the second round.  A doc_id is cast to long; text that isn't a number raises
    or counts as null, as the session's ANSI mode has it.  Columns of ``docs``
    with the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    block = window // 2 + 1
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    digests = saved(
        slim.select(
            "doc_id",
            F.xxhash64("text").alias("a"),
            F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("b"),
            word_count(F.col("text")).alias("n"),
        ),
        "digests",
    )
    buckets = bucket_count(spark, digests.agg(F.sum("n")).first()[0] or 0, BUCKET_WORDS)
    first = digests.groupBy(F.col("a").alias("fa"), F.col("b").alias("fb")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = saved(first.where("first < last").drop("last"), "firsts")
    # a document is a copy if each of its rows is
    joined = digests.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
    copies = joined.groupBy(F.col("doc_id").alias("_copy")).agg(F.min(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).alias("copy"))
    copies = saved(copies.where("copy").select("_copy"), "copies")
    discard(digests)
    discard(first)

    anchors = _anchors(slim, block, buckets).join(copies, F.col("doc_id") == F.col("_copy"), "left_anti")
    anchors = saved(_collected(anchors), "anchors")
    candidates = slim.join(anchors, F.col("doc_id") == F.col("_doc"))
    repeats = _repeats(candidates, block, window, buckets)
    repeats = saved(
        _collected(repeats).select("_doc", "_keys", F.lit(False).alias("_whole")).unionByName(
            copies.select(F.col("_copy").alias("_doc"), F.array().cast("array<long>").alias("_keys"), F.lit(True).alias("_whole"))
        ),
        "repeats",
    )
    discard(anchors)

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut(texts: pa.Array, keys: pa.Array, whole: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for text, key, copy in zip(texts, keys, whole, strict=True):
            words = words_of(text.as_py())
            n_words.append(len(words))
            if copy.as_py() and len(words) >= window:
                n_removed.append(len(words))
                words = []
            elif key.is_valid and len(key.values):
                gone = spans(word_hashes(words), np.asarray(key.values), window)
                n_removed.append(int(gone.sum()))
                words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        out = pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=["n_words", "n_removed", "kept"],
        )
        del kept
        give_back()
        return out

    # else a filter on its result would run it a second time, in workers of its own
    cut = cut.asNondeterministic()
    # the row travels as one column, so that no name of its own can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = packed.join(repeats, F.col("_row.doc_id").cast("long") == F.col("_doc"), "left")
    added = ("_n_words", "_n_removed", "_kept")
    return joined.withColumn("_cut", cut("_row.text", "_keys", "_whole")).select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added],
        F.col("_cut.n_words").alias("_n_words"),
        F.col("_cut.n_removed").alias("_n_removed"),
        F.col("_cut.kept").alias("_kept"),
    )


def removed(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with the repeated words out of their texts, and ``n_chars`` to match.

    A document that loses nothing keeps its text as it is; one that loses all
    its words is dropped, one that never had any stays.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    cut = dedup(packed, window).where((F.col("_n_words") == 0) | (F.col("_n_removed") < F.col("_n_words")))
    less = F.col("_n_removed") > 0
    out = {"text": F.when(less, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(less, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return cut.select(*[out.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


SUBSTRING_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(w[p : p + 12], ' ')) AS first FROM s
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g WHERE first < doc_id
), r AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
