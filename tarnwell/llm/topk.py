"""Exact top-k by inner product with no random access.

Rows are dealt into blocks of neighbours.  In a block the dimensions are cut
into a few subspaces, and the rows of each subspace into cells with a centre and
a radius.  That gives a query one sorted list a subspace: the cells by the
largest product with the query that a row of theirs can have.  Lists are read
in order, a stretch at a time, and a row's product in a subspace is computed
when the row is read there, not before.

What has been read bounds every row's score: from above, a part not read is at
most what the list's next cell allows; from below, at least what its last cell
does.  Reading ends when no row outside a small set can still get among the
best k; the scores of that set are then resolved.

A query first reads the block where it lies itself.  Its k-th score there is a
bar for all other blocks, of which it often reads little or nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import every as in_every
from .blocks import matrix, met, one_each, ranked, same_width, usable
from .common import discard, drawn, saved

#: Rows of a block, and queries that meet a block together, about.
ROWS = 12_000
QUERIES = 2_000
#: Centres around which rows are gathered, at most, and rows that they are found from, at most.
CENTRES = 1_024
SAMPLE_ROWS = 8_000
#: Lists that a query has, at most, and cells of each.
LISTS = 4
CELLS = 32
#: How far the lists are read, as shares of their cells, before bounds are compared.
DEPTHS = (0.16, 0.4)
#: Rows that may be left in question when reading ends, for each of k.
IN_QUESTION = 6
#: Queries whose lists are read together.
TOGETHER = 32
#: Sums of products below these are exact in single and in double precision.
EXACT_SINGLE, EXACT = 2.0**24, 2.0**53


def centres(x: np.ndarray, k: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres of the rows (fewer where they coincide)."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, found)
        sizes = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        found = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return found


def nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which centre is nearest to each row."""
    half = (found**2).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ found.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class SubspaceLists:
    """The lists of one block of rows."""

    def __init__(self, rows: np.ndarray, lists: int = LISTS, cells: int = CELLS):
        self.rows = rows
        largest = float(np.abs(rows).max(initial=0))
        self.edges = np.linspace(0, rows.shape[1], min(lists, max(1, rows.shape[1])) + 1).astype(int)
        self.slack = 1e-6 * (1 + largest)
        #: Entries that were read, and entries that all lists of all queries had.
        self.read, self.entries = 0, 0
        self.cells = []
        sample = rows[:: max(1, len(rows) // 2000)]
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            part = np.ascontiguousarray(rows[:, a:b])
            middle = centres(sample[:, a:b].astype(np.float64), cells)
            own = nearest(part.astype(np.float64), middle)
            order = np.argsort(own, kind="stable")
            starts = np.append(np.searchsorted(own[order], np.arange(len(middle))), len(own))
            filled = np.flatnonzero(starts[1:] > starts[:-1])
            spread = np.sqrt(((part - middle[own]) ** 2).sum(1))
            radius = np.array([spread[order[starts[c] : starts[c + 1]]].max() for c in filled])
            bounds = [(starts[c], starts[c + 1]) for c in filled]
            self.cells.append((middle[filled], radius, bounds, order, part[order]))

    def top(self, queries: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query rows that hold its ``k`` best (with ties) of those at its bar or above, and their scores."""
        n, m, lists = len(self.rows), len(queries), len(self.cells)
        bars = np.full(m, -np.inf) if bars is None else bars
        self.entries += lists * m * n
        out: list = [None] * m
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * self.rows.shape[1] < EXACT
        if n <= 4 * k or not exact:
            self.read += lists * m * n
            return [(np.arange(n), self.rows @ q) for q in queries]
        # where a query's lists go on, and what stands at their ends
        places, nexts, floors = [], [], []
        for (a, b), (middle, radius, *_) in zip(zip(self.edges, self.edges[1:], strict=False), self.cells, strict=True):
            own = queries[:, a:b].astype(np.float64)
            product, reach = own @ middle.T, np.sqrt((own**2).sum(1))[:, None] * radius[None, :] + self.slack
            most = product + reach
            order = np.argsort(-most, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
            places.append(place)
            nexts.append(np.take_along_axis(most, order, axis=1))
            floors.append((product - reach).min(1))
        sums, masks = np.zeros((m, n), dtype=self.rows.dtype), np.zeros((m, n), dtype=np.uint8)
        subsets = np.arange(1 << lists)
        unread = np.array([(subsets >> s & 1) == 0 for s in range(lists)], dtype=np.float64)
        below = np.stack(floors, axis=1) @ unread
        open_ = np.flatnonzero(sum(x[:, 0] for x in nexts) >= bars)
        for q in np.setdiff1d(np.arange(m), open_):
            out[q] = np.zeros(0, np.int64), np.zeros(0)
        before = 0.0
        for depth in DEPTHS:
            if not len(open_):
                return out
            above = np.zeros((m, lists))
            for s, (_, _, bounds, order, part) in enumerate(self.cells):
                a, b = self.edges[s], self.edges[s + 1]
                start, stop = int(before * len(bounds)), int(np.ceil(depth * len(bounds)))
                start = int(np.ceil(before * len(bounds)))
                here = places[s][open_]
                for c, (x, y) in enumerate(bounds):
                    who = open_[(here[:, c] >= start) & (here[:, c] < stop)]
                    if len(who):
                        cell = np.ix_(who, order[x:y])
                        sums[cell] += queries[who, a:b] @ part[x:y].T
                        masks[cell] |= 1 << s
                        self.read += len(who) * (y - x)
                above[:, s] = nexts[s][:, stop] if stop < len(bounds) else -np.inf
            above = np.where(np.isfinite(above), above, 0.0) @ unread
            own_masks = masks[open_]
            lower = sums[open_] + np.take_along_axis(below[open_], own_masks, axis=1)
            bar = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k], bars[open_])
            upper = sums[open_] + np.take_along_axis(above[open_], own_masks, axis=1)
            inside = upper >= bar[:, None]
            done = inside.sum(1) <= IN_QUESTION * k
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(inside[i])
                out[open_[i]] = rows, self.rows[rows] @ queries[open_[i]]
            open_, before = open_[~done], depth
        # to the end of the lists: the sums are the scores
        for i in open_:
            self.read += sum(int((y - x)) for s, (_, _, bounds, *_) in enumerate(self.cells) for c, (x, y) in enumerate(bounds) if places[s][i, c] >= int(np.ceil(before * len(bounds))))
        scores = queries[open_] @ self.rows.T
        bar = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k], bars[open_])
        for i, q in enumerate(open_):
            rows = np.flatnonzero(scores[i] >= bar[i])
            out[q] = rows, scores[i, rows]
        return out


def _top_of_blocks(k: int):
    def task(left: pa.Table, right: pa.Table):
        queries, rows = same_width(matrix(left.column("v")), matrix(right.column("v")))
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
        if largest < EXACT:
            kind = np.float32 if largest < EXACT_SINGLE else np.float64
            queries, rows = queries.astype(kind), rows.astype(kind)
        lists = SubspaceLists(rows)
        ids, query_ids = np.asarray(right.column("vec_id")), np.asarray(left.column("vec_id"))
        bars = np.asarray(left.column("bar").fill_null(np.iinfo(np.int64).min)).astype(np.float64)
        # a query's own rows take places too, so that many more are asked for
        own = int(np.unique(ids[np.isin(ids, query_ids)], return_counts=True)[1].max(initial=0))
        out = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, len(queries), TOGETHER):
            part = slice(at, at + TOGETHER)
            for query_id, (found, scores) in zip(query_ids[part], lists.top(queries[part], k + own, bars[part]), strict=True):
                keep = ids[found] != query_id
                found, scores = found[keep], scores[keep]
                order = np.lexsort((ids[found], -scores))[:k]
                out.append((np.full(len(order), query_id), ids[found[order]], scores[order].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return task


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v array<long>``: the floor of ``scale`` times each component."""
    return usable(vectors, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def gathered(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``rows(vec_id, v)`` with ``rb``, the number of a block of neighbours, and the number of blocks.

    Centres are found from at most SAMPLE_ROWS rows; a centre with more rows
    than a block takes has several blocks, among which its rows are dealt out.
    """
    ids = drawn(rows, SAMPLE_ROWS, n, 5, "vec_id")
    sample = matrix(one_each(rows, ids).toArrow().sort_by([("vec_id", "ascending")]).column("v")).astype(np.float64)
    width = sample.shape[1]
    middle = centres(sample, min(CENTRES, max(1, -(-n // ROWS)))) if len(sample) else np.zeros((1, width))
    shared = rows.sparkSession.sparkContext.broadcast(middle)

    @F.arrow_udf("int")
    def centre(vectors: pa.Array) -> pa.Array:
        x = matrix(pa.chunked_array([vectors])).astype(np.float64)
        x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
        return pa.array(nearest(x, shared.value).astype(np.int32))

    placed = saved(rows.withColumn("centre", centre("v")), "placed")
    sizes = {r["centre"]: r["n"] for r in placed.groupBy("centre").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-sizes.get(c, 0) // ROWS)) for c in range(len(middle))]
    first = [sum(parts[:c]) for c in range(len(parts))]
    at = F.col("centre") + 1
    share = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.element_at(F.array(*map(F.lit, parts)), at))
    return placed.select("vec_id", "v", (F.element_at(F.array(*map(F.lit, first)), at) + share).cast("int").alias("rb")), sum(parts)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` highest inner products of each query with every other row.

    Returns ``query_id, rank, vec_id, score``.  Queries are the rows whose
    vec_id is divisible by ``every``.  Ties go to the smaller vec_id.  Rows with
    a null id, a null vector or a null or non-finite component take no part;
    zero and empty vectors score 0.  A shorter vector counts as filled up with
    0.  Rows with the query's own id are not its candidates; repeated rows are
    candidates each, and a repeated query is asked once.  Other columns are
    ignored.
    """
    rows = saved(quantised(vectors, scale), "quantised")
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    placed, r_blocks = gathered(rows, n["n"])
    placed = saved(placed, "blocks")
    discard(rows)
    q_blocks = max(1, -(-n["q"] // QUERIES))
    asked = placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumnRenamed("rb", "home")
    asked = saved(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")), "queries")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    ddl = "query_id long, vec_id long, score long"
    right = in_every(placed, "qb", q_blocks)
    at_home = asked.select("vec_id", "v", "qb", F.col("home").alias("rb"), F.lit(None).cast("long").alias("bar"))
    first = saved(met(at_home, right, _top_of_blocks(k), out, ddl), "first")
    bars = first.groupBy(F.col("query_id").alias("_q")).agg(F.min("score").alias("bar"), F.count("*").alias("_n"))
    bars = bars.select("_q", F.when(F.col("_n") >= k, F.col("bar")).alias("bar"))
    away = in_every(asked, "rb", r_blocks).where(F.col("rb") != F.col("home"))
    away = away.join(bars, F.col("vec_id") == F.col("_q"), "left").select("vec_id", "v", "qb", "rb", "bar")
    found = first.unionByName(met(away, right, _top_of_blocks(k), out, ddl))
    return ranked(found, k, F.col("score").desc())
