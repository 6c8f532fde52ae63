"""Vectors in blocks: every block of queries meets every block of rows once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """Rows with a vector whose components are all finite (and, unless ``zero``, not all 0)."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & ~odd
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def one_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``vec_id, v`` of a bounded set of ids, one row of each however often it occurs."""
    found = rows.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.col("vec_id") == F.col("_id"))
    return found.groupBy("vec_id").agg(F.min("v").alias("v"))


def dealt(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """``rows`` with the number of a block; rows of one id are dealt out too.

    ``rows`` must be a written table: the place of a row in it is part of what decides.
    """
    return rows.withColumn(column, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))


def every(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """``rows`` once for each block."""
    return rows.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def met(left: DataFrame, right: DataFrame, task: Callable[[pa.Table, pa.Table], tuple], out: pa.Schema, ddl: str) -> DataFrame:
    """What ``task`` makes of the rows of both sides with the same ``qb`` and ``rb``."""

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(task(left, right), out, strict=True)], schema=out)
        give_back()
        return found

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(together, ddl)


def ranked(found: DataFrame, k: int, better: Column) -> DataFrame:
    """The ``k`` best of ``found(query_id, vec_id, score)`` for each query, ties by smaller id."""
    order = Window.partitionBy("query_id").orderBy(better, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with 0."""
    lists = column.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten())
    if len(lengths) and (lengths == lengths[0]).all():
        return values.reshape(len(lengths), lengths[0])
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=values.dtype)
    for i, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        out[i, :n] = values[a : a + n]
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, d - a.shape[1]))), np.pad(b, ((0, 0), (0, d - b.shape[1])))
