"""Byte-level BPE by replaying merges over the words of the corpus.

A word is a stretch of text at whose ends the pattern cuts for certain; the
pattern cuts words into pieces.  One pass counts the pieces of the whole corpus;
the most frequent ones, to a fixed number, are encoded once for all and told to
every task as a store.  A second pass looks words and pieces up and encodes the
pieces that the store lacks, all distinct ones of a block at once.

Both encode by the same replay: distinct pieces are laid end to end, an inverted
index leads from each mergeable token pair to the positions where it stands,
and the merges are applied in rank order, each touching only the neighbours of
what it merged.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, uncollected, worker_state

#: Pieces of the store, at most, and the characters of one.
STORE_PIECES = 300_000
STORE_CHARS = 40
#: Distinct words that a task counts before it hands the counts on.
COUNTED_WORDS = 400_000
#: Words beyond the store that a worker remembers.
REMEMBERED = 50_000
#: Characters of text that are encoded together.
BLOCK_CHARS = 1_000_000
#: Pieces that are laid end to end at once.
REPLAYED = 20_000
#: White space as Unicode has it, but for the space and the line feed.
OTHER_SPACES = tuple("\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))
ASCII_SPACES = OTHER_SPACES[:4]
ABSENT = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def piece_pattern(pattern: str) -> str:
    r"""``\s`` as Unicode's White_Space, as the reference implementation of the format reads it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class MergeReplay:
    """Encodes pieces by rank-ordered merges; a merge applies where two
    neighbouring tokens' bytes together are a token, lowest rank first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), ABSENT, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.pairs: dict[int, int] = {}

    def pair_rank(self, key: int) -> int:
        """Of a pair that isn't among ``pairs`` yet; its ids are the halves of ``key``."""
        if len(self.pairs) > 250_000:
            self.pairs.clear()
        token = self.bytes_of[key >> 24] + self.bytes_of[key & 0xFFFFFF]
        got = self.pairs[key] = self.ranks.get(token, ABSENT)
        return got

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as packed 32-bit numbers (no piece may be empty)."""
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(raw)
        # rank of the pair that starts at a position; the last byte of a piece starts none
        at = np.full(n, ABSENT, dtype=np.int64)
        at[:-1] = self.first[raw[:-1], raw[1:]]
        at[ends - 1] = ABSENT
        # the inverted index: rank of a pair -> positions, from left to right
        order = np.argsort(at, kind="stable")
        order = order[: int((at < ABSENT).sum())]
        found, starts = np.unique(at[order], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(found, np.split(order, starts[1:]), strict=True)} if len(order) else {}
        ids = self.byte_ids[raw].tolist()
        at = at.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        ranks = list(index)
        heapify(ranks)
        pair_rank, pairs = self.pair_rank, self.pairs
        while ranks:
            rank = heappop(ranks)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                if at[i] != rank:
                    continue
                j = after[i]
                ids[i], ids[j], at[j] = rank, -1, ABSENT
                nxt = after[i] = after[j]
                lowest = rank
                if nxt >= 0:
                    before[nxt] = i
                    key = rank << 24 | ids[nxt]
                    new = pairs[key] if key in pairs else pair_rank(key)
                    at[i] = new
                    if new < ABSENT:
                        if new < lowest:
                            lowest = new
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(ranks, new)
                else:
                    at[i] = ABSENT
                prev = before[i]
                if prev >= 0:
                    key = ids[prev] << 24 | rank
                    new = pairs[key] if key in pairs else pair_rank(key)
                    at[prev] = new
                    if new < ABSENT:
                        if new < lowest:
                            lowest = new
                        if new in index:
                            index[new].append(prev)
                        else:
                            index[new] = [prev]
                            heappush(ranks, new)
                if lowest < rank:  # a merge made an earlier one possible: that goes first
                    if rank in index:
                        index[rank] += places[k + 1 :]
                    else:
                        index[rank] = places[k + 1 :]
                        heappush(ranks, rank)
                    break
        left = np.array(ids, dtype=np.int32)
        alive = left >= 0
        packed = left[alive].astype("<i4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905


def words_of(text: str) -> list[str]:
    """The text cut before each space or line feed that follows something else than white space.

    A pattern no match of which has white space after anything else cuts there too.
    """
    if "\0" in text:
        return [text]
    text = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(" \0", " ").replace("\n\0", "\n")
    for space in ASCII_SPACES if text.isascii() else OTHER_SPACES:
        if space in text:
            text = text.replace(space + "\0", space)
    return text.split("\0")


class Encoder:
    """Texts to ids by way of their words.

    ``spaced`` tells that no match of the pattern has white space after
    anything else; then words are those of :func:`words_of`, else the pieces.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False, store: dict[str, bytes] | None = None):
        import regex

        self.replay = MergeReplay(ranks)
        self.cut = regex.compile(piece_pattern(pattern)).findall
        self.words = words_of if spaced else self.cut
        self.spaced = spaced
        self.store = store or {}
        self.met: dict[str, bytes] = {}
        top = max(ranks.values(), default=-1) + 1
        self.token = [self.replay.bytes_of.get(k) for k in range(top)]
        self.digits = [str(k).encode() for k in range(top)]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The packed 32-bit ids of each piece."""
        out = []
        for k in range(0, len(pieces), REPLAYED):
            out += self.replay.encode([p.encode("utf-8", "surrogatepass") for p in pieces[k : k + REPLAYED]])
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """The packed 32-bit ids of each word."""
        cut = list(map(self.cut, words)) if self.spaced else [[w] if w else [] for w in words]
        known, new = self._found({p for c in cut for p in c}, self.store)
        known.update(zip(new, self.of_pieces(new), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    @staticmethod
    def _found(words: set[str], *stores: dict[str, bytes]) -> tuple[dict[str, bytes], list[str]]:
        """Those of the words that some store has, with their ids, and the rest."""
        known: dict[str, bytes] = {}
        for store in stores:
            got = store.get
            known.update({w: ids for w in words if (ids := got(w)) is not None})
            words = words - known.keys()
        return known, list(words)

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        """The packed ids of the texts, in blocks; null counts as empty."""
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append(self.words(text) if text else [])
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield self._block(block)
                block, chars = [], 0
        if block:
            yield self._block(block)

    def _block(self, block: list[list[str]]) -> list[bytes]:
        with uncollected():
            return self._encoded(block)

    def _encoded(self, block: list[list[str]]) -> list[bytes]:
        if len(self.met) > REMEMBERED:
            self.met = {}
        known, new = self._found(set().union(*block), self.store, self.met)
        made = dict(zip(new, self.of_words(new), strict=True))
        self.met.update((w, ids) for w, ids in made.items() if len(w) <= STORE_CHARS)
        known |= made
        return [b"".join(map(known.__getitem__, words)) for words in block]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for; unknown ids raise."""
        return b"".join(map(self.token.__getitem__, ids))

    def listed(self, ids: list[int]) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.digits.__getitem__, ids))


def _unpacked(packed: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.splitlines() if x.strip())}


def _counted(docs: DataFrame, encoder) -> DataFrame:
    """How often each distinct piece of the corpus occurs, but for those too long for the store."""

    def counted(batches):
        own, words = encoder(), Counter()
        for batch in batches:
            for text in batch.column(0):
                with uncollected():
                    words.update(own.words(text.as_py() or ""))
                if len(words) > COUNTED_WORDS:
                    yield from handed_on(own, words)
                    words.clear()
        yield from handed_on(own, words)
        words = Counter()
        give_back()

    def handed_on(own, words):
        counts: Counter = Counter()
        for word, n in words.items():
            for piece in own.cut(word) if own.spaced else [word]:
                counts[piece] += n
        kept = [(p, n) for p, n in counts.items() if 0 < len(p) <= STORE_CHARS]
        for k in range(0, len(kept), 50_000):
            part = kept[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["piece", "n"])

    return docs.select("text").mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What the tasks need: the ranks and the store, both broadcast, made into an encoder once a worker.

    With ``store`` 0 nothing is counted and every block encodes all its words.
    """

    def __init__(self, docs: DataFrame, ranks_path: str, pattern: str, spaced: bool = False, store: int = STORE_PIECES):
        context = docs.sparkSession.sparkContext
        with open(ranks_path, "rb") as file:
            self.packed = context.broadcast(file.read())
        self.key = ("bpe", len(self.packed.value), pattern, spaced, uuid.uuid4().hex)
        self.pattern, self.spaced, self.store = pattern, spaced, None
        if store:
            self.store = context.broadcast(self._frequent(docs, store))

    def encoder(self) -> Encoder:
        def made():
            store = dict(zip(*self.store.value, strict=True)) if self.store else {}
            return Encoder(_unpacked(self.packed.value), self.pattern, self.spaced, store)

        return worker_state(self.key, made)

    def _frequent(self, docs: DataFrame, most: int) -> tuple[list[str], list[bytes]]:
        """The corpus' most frequent pieces with their ids; of equally frequent ones the first by code point."""
        packed, key, pattern, spaced = self.packed, (*self.key, "first"), self.pattern, self.spaced
        first = lambda: worker_state(key, lambda: Encoder(_unpacked(packed.value), pattern, spaced))
        frequent = _counted(docs, first).where("n > 1").orderBy(F.desc("n"), "piece").limit(most)

        def encoded(batches):
            for batch in batches:
                # what is a piece by itself too: it may then be looked up as a word
                pieces = [p for p in batch.column(0).to_pylist() if first().cut(p) == [p]]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(first().of_pieces(pieces), pa.binary())], names=["piece", "ids"])

        found = frequent.select("piece").mapInArrow(encoded, "piece string, ids binary").toArrow()
        return found.column("piece").to_pylist(), found.column("ids").to_pylist()


def encode(docs: DataFrame, ranks_path: str, pattern: str, spaced: bool = False) -> DataFrame:
    """``doc_id`` and ``ids array<int>``, one row per input row.

    The vocabulary file (of fixed size) is read on the driver and broadcast.
    Null and empty texts have no ids.  Repeated rows are encoded each.  Special
    tokens' strings are ordinary text.  Other columns are ignored.  ``spaced``
    may be set if no match of the pattern has white space after anything else;
    the ids are the same either way.
    """
    slim = docs.select("doc_id", "text")
    vocabulary = Vocabulary(slim, ranks_path, pattern, spaced)
    kept = pa.schema([("doc_id", _arrow_type(slim, "doc_id")), ("ids", pa.list_(pa.int32()))])

    def encoded(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            at = 0
            texts = (x.as_py() for x in batch.column(1))
            for ids in encoder.encode(texts):
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), lists], schema=kept)
                at += len(ids)

    return slim.mapInArrow(encoded, slim.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())))


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def decoder(docs: DataFrame, ranks_path: str):
    """A column function from ``array<int>`` to the decoded ``binary``; null ids
    are null, an empty list is no bytes, unknown ids raise."""
    with open(ranks_path, "rb") as file:
        packed = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        make = lambda: {v: k for k, v in _unpacked(packed.value).items()}
        token = worker_state(("bpe tokens", len(packed.value)), make).__getitem__
        return pa.array((b"".join(map(token, x.as_py())) if x.is_valid else None for x in ids), pa.binary())

    return decoded


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, spaced: bool = False) -> DataFrame:
    """Encode, decode, and the digests of both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One row per input row; the cases of :func:`encode` hold.  Ids and bytes are
    digested where they are made, in one pass, and never leave the worker.
    """
    slim = docs.select("doc_id", "text")
    vocabulary = Vocabulary(slim, ranks_path, pattern, spaced)
    kinds = [_arrow_type(slim, "doc_id"), pa.int64(), pa.string(), pa.string()]
    kept = pa.schema(list(zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), kinds, strict=True)))

    def digested(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            rows = []
            for block in encoder.encode(x.as_py() for x in batch.column(1)):
                for packed in block:
                    ids = np.frombuffer(packed, dtype="<i4").tolist()
                    rows.append((len(ids), sha256(encoder.listed(ids)).hexdigest(), sha256(encoder.decode(ids)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], schema=kept)
        give_back()

    out = slim.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return slim.mapInArrow(digested, out)
