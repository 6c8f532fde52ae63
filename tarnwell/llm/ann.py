"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several
full-dimensional codebooks, each trained on the residuals of the ones before.
Encoding keeps a beam of the best partial sums.  A query scores codes from a
lookup table of its products with the codewords and the stored norm of the sum;
the best of all blocks by that score then meet their vectors and are ranked
again by true distance.  Only codes travel to the queries.  Rows of the same
code are scored once and taken or left together, so that copies of a vector take
one place among the best, however many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import dealt, matrix, met, one_each, ranked, same_width, usable
from .blocks import every as in_every
from .common import drawn, give_back, saved

#: Rows the codebooks are trained on, at most (by a hash of the id).
SAMPLE_ROWS = 16_000
BOOKS = 24
WORDS = 256
BEAM = 4
#: Distinct rough scores of a query whose rows are ranked again by true distance.
RERANKED = 600
#: Codes of a block, and queries that meet a block together, about.
ROWS = 40_000
QUERIES = 2_000


@dataclass
class Codebooks:
    words: np.ndarray  # books, words, dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and the squared norms of the sums they stand for."""
        codes, norms = [], []
        for part in range(0, len(x), 2048):
            c, n = self._encode(x[part : part + 2048], beam)
            codes.append(c)
            norms.append(n)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        sums = np.zeros((n, 1, d))
        for book in self.words:
            # |x - s - w|^2 without |x - s|^2 of the beam entry added back
            rest = x[:, None, :] - sums
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, -1, len(book)) + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            entry, word = pick // len(book), pick % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, entry], word[:, :, None].astype(np.uint8)], axis=2)
            sums = sums[rows, entry] + book[word]
        cost = ((x[:, None, :] - sums) ** 2).sum(2)
        one = cost.argmin(1)
        rows = np.arange(n)
        return codes[rows, one], (sums[rows, one] ** 2).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of queries and codewords: queries, books, words."""
        return np.einsum("qd,bwd->qbw", queries, self.words)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1) - 2 * x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)])
        sizes = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
        used = near[order][starts]
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / sizes[used][:, None]
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> Codebooks:
    """Residual codebooks: each fits what the beam's best sum so far leaves over."""
    rng = np.random.default_rng(seed)
    trained: list[np.ndarray] = []
    rest = sample.copy()
    for _ in range(books):
        book = _kmeans(rest, words, rng)
        trained.append(book)
        near = np.concatenate([((book**2).sum(1) - 2 * rest[a : a + 4096] @ book.T).argmin(1) for a in range(0, len(rest), 4096)])
        rest = rest - book[near]
    return Codebooks(np.stack(trained))


def index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, codes binary, norm double, same long`` for ``rows(vec_id, v)``, every row encoded.

    ``same`` is a hash of the vector, by which copies are known.  The codebooks
    are trained on at most ``sample_rows`` rows and have a fixed size.  The
    width is the longest vector's.  Of rows that repeat an id each is encoded.
    """
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not seen["n"]:
        return rows.select("vec_id", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0).cast("long").alias("same")), None
    picked = one_each(rows, drawn(rows, sample_rows, seen["n"], 9, "vec_id"))
    sample = matrix(picked.toArrow().sort_by([("vec_id", "ascending")]).column("v"))
    sample = np.pad(sample, ((0, 0), (0, seen["d"] - sample.shape[1]))) if len(sample) else np.zeros((1, seen["d"]))
    codebooks = train(sample.astype(np.float64))
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    kept = pa.schema([("vec_id", pa.int64()), ("codes", pa.binary()), ("norm", pa.float64()), ("same", pa.int64())])

    def encoded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(pa.chunked_array([batch.column(1)]))
            x = np.pad(x, ((0, 0), (0, shared.value.words.shape[2] - x.shape[1])))
            codes, norms = shared.value.encode(x)
            # 0.0 and -0.0 are the same
            same = [xxhash.xxh3_64_intdigest(v.tobytes()) for v in x + 0.0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(np.array(same, np.uint64).view(np.int64))],
                schema=kept,
            )
        give_back()

    coded = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(encoded, "vec_id long, codes binary, norm double, same long")
    return saved(coded, "codes"), codebooks


def _first_copies(same: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows but for those with ``most`` copies of smaller ids."""
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[place < most])


def _rough_of_blocks(k: int, reranked: int, codebooks):
    def task(left: pa.Table, right: pa.Table):
        books = codebooks.value
        queries = matrix(left.column("v"))
        ids, query_ids = np.asarray(right.column("vec_id")), np.asarray(left.column("vec_id"))
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        norms = np.asarray(right.column("norm"))
        queries = np.pad(queries, ((0, 0), (0, books.words.shape[2] - queries.shape[1])))
        # of copies of a vector those of the smallest ids can be among the best, the query's own rows aside
        own = int(np.unique(ids[np.isin(ids, query_ids)], return_counts=True)[1].max(initial=0))
        kept = _first_copies(np.asarray(right.column("same")), ids, k + own)
        ids, norms = ids[kept], norms[kept]
        packed, first, word = np.unique(codes[kept].view(f"V{codes.shape[1]}").ravel(), return_index=True, return_inverse=True)
        codes, norms, word = codes[kept][first].astype(np.int64), norms[first], word.ravel()
        members = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(codes))
        ends = np.cumsum(sizes)
        out = []
        flat = (codes + np.arange(codes.shape[1]) * books.words.shape[1]).T.copy()
        m = min(len(codes), reranked + own)
        for at in range(0, len(queries), 64):
            for query_id, table in zip(query_ids[at : at + 64].tolist(), books.tables(queries[at : at + 64]), strict=True):
                lookup = 2 * table.ravel()
                rough = norms.copy()
                for column in flat:
                    rough -= lookup[column]
                best_codes = np.argpartition(rough, m - 1)[:m]
                n = sizes[best_codes]
                pick = members[np.arange(n.sum()) + np.repeat(ends[best_codes] - np.cumsum(n), n)]
                other = ids[pick] != query_id
                out.append((np.full(int(other.sum()), query_id), ids[pick][other], np.repeat(rough[best_codes], n)[other]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return task


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sample_rows: int = SAMPLE_ROWS, reranked: int = RERANKED) -> DataFrame:
    """The ``k`` nearest other rows found for each query, by Euclidean distance.

    Returns ``query_id, rank, vec_id, score``; the score is the true distance.
    Queries are the rows whose vec_id is divisible by ``every``.  Ties go to the
    smaller vec_id.  Rows with a null id, a null, empty or zero vector, or a
    null or non-finite component take no part.  A shorter vector counts as
    filled up with 0.  Rows with the query's own id are not its candidates;
    repeated rows are candidates each, and a repeated query is asked once.
    Other columns are ignored.  ``reranked`` is how many distinct rough scores
    of a query are looked at exactly; more find more.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors, zero=False), "vectors")
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    coded, codebooks = index(rows, sample_rows)
    asked = saved(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    r_blocks, q_blocks = max(1, -(-n["n"] // ROWS)), max(1, -(-n["q"] // QUERIES))
    left = in_every(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")), "rb", r_blocks)
    right = in_every(dealt(coded, "rb", r_blocks), "qb", q_blocks)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("rough", pa.float64())])
    found = met(left, right, _rough_of_blocks(k, max(reranked, 4 * k), spark.sparkContext.broadcast(codebooks)), out, "query_id long, vec_id long, rough double")
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("rough"))
    found = found.withColumn("place", place).where(F.col("place") <= max(reranked, 4 * k))
    # rows that repeat an id are all meant, and each once
    found = saved(found.select("query_id", F.col("vec_id").alias("_row")).distinct(), "found")
    pairs = found.join(rows, F.col("_row") == F.col("vec_id")).select("query_id", "vec_id", "v")
    pairs = pairs.join(asked.select(F.col("vec_id").alias("_q"), F.col("v").alias("qv")), F.col("query_id") == F.col("_q"))

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = same_width(matrix(pa.chunked_array([a])), matrix(pa.chunked_array([b])))
        return pa.array(np.sqrt(((x - y) ** 2).sum(1)))

    return ranked(pairs.select("query_id", "vec_id", distance("v", "qv").alias("score")), k, F.col("score").asc())
