"""Window functions over positional frames, with NULLs first in either direction."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarnwell.plans.expr import Agg

_EDGE = re.compile(r"(unbounded|current|\d+)\s*(preceding|following|row)?$")


def parse_frame(text: str) -> tuple[int, int]:
    """``rowsBetween`` bounds of a frame; empty text is the whole partition.

    Both edges may be ``unbounded preceding``, ``N preceding``, ``current row``,
    ``N following`` or ``unbounded following``; an edge alone reaches to the
    current row.  Anything else, and an empty frame, raises ``ValueError``.
    """
    low = " ".join(text.lower().split())
    low = low.removeprefix("rows ").removeprefix("between ")
    if not low:
        return Window.unboundedPreceding, Window.unboundedFollowing
    edges = low.split(" and ") if " and " in low else [low, "current row"]
    if len(edges) != 2:
        raise ValueError(f"not a frame: {text!r}")
    bounds = []
    for k, edge in enumerate(edges):
        m = _EDGE.match(edge.strip())
        if not m or (m[1] == "current") != (m[2] in ("row", None)):
            raise ValueError(f"not a frame: {text!r}")
        if m[1] == "current":
            bounds.append(0)
        elif m[1] == "unbounded":
            bounds.append(Window.unboundedPreceding if m[2] == "preceding" else Window.unboundedFollowing)
        else:
            bounds.append(-int(m[1]) if m[2] == "preceding" else int(m[1]))
    if bounds[0] > bounds[1] or bounds[0] == Window.unboundedFollowing or bounds[1] == Window.unboundedPreceding:
        raise ValueError(f"the frame is empty: {text!r}")
    return bounds[0], bounds[1]


@dataclass(frozen=True)
class WindowFunction:
    """``func`` is a ranking function's name, an offset function's, or an aggregate."""

    output: str
    func: str | Agg
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    frame: str = "unbounded preceding and current row"
    arg: str | None = None
    offset: int = 1


def _spec(w: WindowFunction) -> WindowSpec:
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_first() for c, up in w.order_by]
    spec = Window.partitionBy(*w.partition_by)
    return spec.orderBy(*order) if order else spec


_RANKS = {
    "row_number": F.row_number, "rownumber": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank,
    "denserank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
}


def window_column(w: WindowFunction, integral: bool = False) -> Column:
    if isinstance(w.func, str):
        low = w.func.lower()
        if low in _RANKS:
            return _RANKS[low]().over(_spec(w))
        if low == "ntile":
            return F.ntile(w.offset).over(_spec(w))
        if low in ("lag", "lead") and w.arg:
            return getattr(F, low)(w.arg, w.offset).over(_spec(w))
        raise ValueError(f"unknown window function {w.func!r}")
    over = _spec(w).rowsBetween(*parse_frame(w.frame))
    a = w.func
    if a.arg is None:
        if a.func != "count":
            raise ValueError(f"{a.func} needs an argument")
        return F.count("*").over(over)
    x = a.arg.column()
    if a.distinct:
        found = F.collect_set(x).over(over)
        match a.func:
            case "count":
                return F.size(found).cast("long")
            case "sum":
                zero = F.lit(0).cast("long") if integral else F.lit(0.0)
                return F.when(F.size(found) > 0, F.aggregate(found, zero, lambda s, v: s + v))
            case "avg":
                return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, v: s + v) / F.size(found))
        raise ValueError(f"{a.func} has no DISTINCT form in a window")
    match a.func:
        case "sum":
            return F.sum(x).over(over)
        case "count":
            return F.count(x).over(over)
        case "avg" | "mean":
            return F.avg(x).over(over)
        case "min":
            return F.min(x).over(over)
        case "max":
            return F.max(x).over(over)
        case "first" | "any":
            return F.first(x, ignorenulls=True).over(over)
        case "last" | "arbitrary":
            return F.last(x, ignorenulls=True).over(over)
        case "list":
            return F.collect_list(x).over(over)
    raise ValueError(f"unknown aggregate {a.func!r}")


def _whole_partition(w: WindowFunction) -> bool:
    return isinstance(w.func, Agg) and w.func.distinct and parse_frame(w.frame) == (Window.unboundedPreceding, Window.unboundedFollowing)


def _with_distinct(df: DataFrame, w: WindowFunction) -> DataFrame:
    """A DISTINCT aggregate over whole partitions: grouped once and joined back, one value a
    partition instead of a set a row.  NULL is a partition like any other."""
    from tarnwell.operators.relational import aggregate_column

    keys = [f"_w{i}" for i in range(len(w.partition_by))]
    grouped = df.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(w.partition_by, keys, strict=True)])
    found = grouped.agg(aggregate_column(w.func).alias("_found"))
    same = F.lit(True)
    for c, k in zip(w.partition_by, keys, strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    joined = df.join(found, same, "left") if keys else df.join(F.broadcast(found))  # one row
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_found").alias(w.output))


def with_windows(df: DataFrame, functions: list[WindowFunction], k: int | None = None) -> DataFrame:
    """New columns appended; functions over the same partition share one sort.

    With ``k`` an aggregate over a frame of fewer rows is NULL.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = dict(df.dtypes)
    names = [*df.columns, *[w.output for w in functions]]
    for w in functions if k is None else ():
        if _whole_partition(w):
            df = _with_distinct(df, w)
    functions = [w for w in functions if k is not None or not _whole_partition(w)]

    def integral(w: WindowFunction) -> bool:
        names = w.func.arg.names() if isinstance(w.func, Agg) and w.func.arg is not None else ()
        return all(kinds.get(n) in whole for n in names)

    def column(w: WindowFunction) -> Column:
        made = window_column(w, integral(w))
        if k is None or not isinstance(w.func, Agg):
            return made
        return F.when(F.count("*").over(_spec(w).rowsBetween(*parse_frame(w.frame))) >= k, made)

    return df.select("*", *[column(w).alias(w.output) for w in functions]).select(*[F.col(f"`{c}`") for c in names])
