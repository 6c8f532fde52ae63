"""Relational operators on DataFrames, with the engine's own semantics.

NULLs sort last in either direction; join keys come from the left; where both
sides of a join have a column, the right one's values stand at the left one's
place; division by zero is NULL.  Nothing here runs a job but ``quality_check``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.errors import QualityCheckFailed, UnknownColumn
from tarnwell.plans.expr import Agg, Expr


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise UnknownColumn(f"no column {missing[0]!r}; there are {df.columns}")


def project(df: DataFrame, columns: Sequence[str] = (), expressions: dict[str, Expr] | None = None, safe: bool = False) -> DataFrame:
    """Select and reorder columns, then computed ones."""
    require(df, columns)
    for e in (expressions or {}).values():
        require(df, e.names())
    return df.select(*[_c(n) for n in columns], *[e.column(safe).alias(n) for n, e in (expressions or {}).items()])


def filter_(df: DataFrame, predicate: Expr, safe: bool = False) -> DataFrame:
    """Rows for which the predicate is true; NULL is not."""
    require(df, predicate.names())
    return df.where(predicate.column(safe))


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """By ``"name"``, ``"name asc"`` or ``"name desc"``; NULLs last both ways."""
    order = []
    for key in keys:
        name, _, way = key.strip().partition(" ") if key.strip() not in df.columns else (key.strip(), "", "")
        require(df, [name])
        if way.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"not a sort key: {key!r}")
        order.append(_c(name).desc_nulls_last() if way.strip().lower() == "desc" else _c(name).asc_nulls_last())
    return df.orderBy(*order)


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a limit can't be negative")
    return df.limit(n)


def top_k(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Sort and limit in one operator: no task holds more than ``n`` rows."""
    return limit(sort(df, *keys), n)


JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | dict[str, str], how: str = "inner") -> DataFrame:
    """Equi-join; ``on`` names the keys, or maps left to right names.

    NULL keys never match.  Keys are the left side's, so NULL on rows that only
    the right side has.  A side is broadcast only where Spark's statistics or
    adaptive execution find it small.
    """
    kind = JOINS.get(how.lower())
    if kind is None:
        raise ValueError(f"unknown join {how!r}")
    pairs = dict(on) if isinstance(on, dict) else {k: k for k in ([on] if isinstance(on, str) else on)}
    if not pairs:
        raise ValueError("a join needs a key")
    require(left, pairs)
    require(right, pairs.values())
    l, r = left.alias("l"), right.alias("r")
    col = lambda side, n: F.col(f"{side}.`{n}`")
    taken = [c for c in right.columns if c not in pairs.values()]
    columns = [col("r", c).alias(c) if c in taken and c not in pairs else col("l", c).alias(c) for c in left.columns]
    columns += [col("r", c).alias(c) for c in taken if c not in left.columns]
    if kind == "cross":
        return l.crossJoin(r).select(*columns)
    condition = None
    for a, b in pairs.items():
        same = col("l", a) == col("r", b)
        condition = same if condition is None else condition & same
    joined = l.join(r, condition, kind)
    if kind in ("left_semi", "left_anti"):
        return joined.select(*[col("l", c).alias(c) for c in left.columns])
    return joined.select(*columns)


def _slice(time: Column, kind: str, width: float) -> Column:
    """The number of the slice of time that a value falls in; times count in seconds."""
    return F.floor((time.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else time.cast("double")) / F.lit(float(width)))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tolerance: object = None, slice_width: float | None = None) -> DataFrame:
    """To each left row the latest right row of the same keys at or before its time.

    One shuffle by key: both sides are stacked, sorted by time, and the last
    right row is carried forward.  ``tolerance`` is the largest allowed distance
    (a number, or an interval for timestamps); beyond it the right side is NULL.
    Left rows whose key or time is NULL match nothing.

    With ``slice_width`` (in the unit of the time, seconds for timestamps) a key
    is worked on in slices of time, each of which begins with the last right row
    before it; so a key that most rows have is no single task.
    """
    require(left, [*by, left_time])
    require(right, [*by, right_time])
    added = [c for c in right.columns if c not in by and c not in left.columns]
    own = left.select(F.struct(*[_c(c) for c in left.columns]).alias("_l"), *[_c(k).alias(f"_k{i}") for i, k in enumerate(by)], _c(left_time).alias("_t"), F.lit(1).alias("_side"))
    other = right.where(_c(right_time).isNotNull()).select(
        F.struct(*[_c(c) for c in dict.fromkeys([right_time, *added])]).alias("_r"), *[_c(k).alias(f"_k{i}") for i, k in enumerate(by)], _c(right_time).alias("_t"), F.lit(0).alias("_side")
    )
    keys = [f"_k{i}" for i in range(len(by))]
    if slice_width is not None:
        own = own.withColumn("_s", _slice(F.col("_t"), dict(left.dtypes)[left_time], slice_width))
        other = other.withColumn("_s", _slice(F.col("_t"), dict(right.dtypes)[right_time], slice_width))
        # one row a slice: its last right row, and before it that of the slices before
        ends = other.groupBy(*keys, "_s").agg(F.max_by("_r", "_t").alias("_end"))
        ends = ends.unionByName(own.select(*keys, "_s").distinct(), allowMissingColumns=True).groupBy(*keys, "_s").agg(F.first("_end", ignorenulls=True).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_r", F.last("_end", ignorenulls=True).over(before)).where(F.col("_r").isNotNull())
        other = other.unionByName(carried.select("_r", *keys, F.lit(None).cast(other.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"), "_s"))
        keys = [*keys, "_s"]
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    fits = F.col("_t").isNotNull()
    for k in keys[: len(by)]:
        fits = fits & F.col(k).isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("_t") - F.col(f"_m.`{right_time}`") <= F.lit(tolerance))
    return both.where("_side = 1").select("_l.*", *[F.when(fits, F.col(f"_m.`{c}`")).alias(c) for c in added])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Left rows whose ``point`` lies in a right row's ``[low, high)``.

    Both sides are cut into bins of ``width`` and joined on the bin, so the
    work follows the matches instead of the product of the sides.
    """
    if how not in ("inner", "left"):
        raise ValueError("a range join is inner or left")
    binned = right.withColumn("_bin", F.explode(F.sequence(F.floor(_c(low) / width), F.floor(_c(high) / width))))
    l = left.withColumn("_bin", F.floor(_c(point) / width))
    hit = (l["_bin"] == binned["_bin"]) & (l[point] >= binned[low]) & (l[point] < binned[high])
    return l.join(binned, hit, how).drop("_bin")


def aggregate_column(a: Agg) -> Column:
    if a.custom is not None:
        return a.custom(*([a.arg.column()] if a.arg is not None else []))
    name = {"mean": "avg", "any": "first", "arbitrary": "last"}.get(a.func.lower(), a.func.lower())
    if a.arg is None:
        if name != "count" or a.distinct:
            raise ValueError(f"{a.func} needs an argument")
        return F.count(F.lit(1))
    x = a.arg.column()
    order = F.struct(*[_c(n) for n in a.order_by]) if a.order_by else None
    some = x.isNotNull()
    match name:
        case "sum":
            return F.sum_distinct(x) if a.distinct else F.sum(x)
        case "count":
            return F.count_distinct(x) if a.distinct else F.count(x)
        case "avg" if a.distinct:
            return F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0))
        case "avg":
            return F.avg(x)
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "first":
            return F.min_by(F.when(some, x), F.when(some, order)) if a.order_by else F.first(x, ignorenulls=True)
        case "last":
            return F.max_by(F.when(some, x), F.when(some, order)) if a.order_by else F.last(x, ignorenulls=True)
        case "list" if a.order_by:
            found = F.sort_array(F.collect_list(F.when(some, F.struct(order.alias("o"), x.alias("x")))))
            return F.transform(found, lambda p: p["x"])
        case "list":
            return F.collect_list(x)
        case "approx_distinct":
            return F.approx_count_distinct(x, 0.016)
        case "stddev":
            return F.stddev(x)
        case "variance":
            return F.variance(x)
        case "median":
            return F.median(x)
    raise ValueError(f"unknown aggregate {a.func!r}")


def group_by(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg] | None = None) -> DataFrame:
    """One row per distinct keys (NULL is a key); without aggregates just those."""
    require(df, keys)
    for a in (aggs or {}).values():
        require(df, [*(a.arg.names() if a.arg is not None else ()), *a.order_by])
    if not aggs:
        return df.select(*[_c(k) for k in keys]).distinct()
    return df.groupBy(*[_c(k) for k in keys]).agg(*[aggregate_column(a).alias(n) for n, a in aggs.items()])


def aggregate(df: DataFrame, aggs: dict[str, Agg]) -> DataFrame:
    """One row over everything, also where there is nothing."""
    for a in aggs.values():
        require(df, [*(a.arg.names() if a.arg is not None else ()), *a.order_by])
    return df.agg(*[aggregate_column(a).alias(n) for n, a in aggs.items()])


def grouping_sets(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg], kind: str = "rollup", sets: Sequence[Sequence[str]] = (), k: int | None = None) -> DataFrame:
    """``rollup``, ``cube`` or a list of key ``sets``; a key that a row sums over is NULL, and
    ``grouping_id`` tells which.  With ``k`` rows of fewer contributing rows are left out."""
    require(df, [*keys, *[c for s in sets for c in s]])
    if kind == "sets":
        if odd := [c for s in sets for c in s if c not in keys]:
            raise ValueError(f"a set may name the keys only, not {odd[0]!r}")
        grouped = df.groupingSets([[_c(c) for c in s] for s in sets], *[_c(x) for x in keys])
    elif kind in ("rollup", "cube"):
        grouped = getattr(df, kind)(*[_c(x) for x in keys])
    else:
        raise ValueError(f"unknown kind {kind!r}")
    found = grouped.agg(*[aggregate_column(a).alias(n) for n, a in aggs.items()], F.grouping_id().cast("int").alias("grouping_id"), F.count("*").alias("_contributing"))
    return (found if k is None else found.where(F.col("_contributing") >= k)).drop("_contributing")


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[object], agg: Agg) -> DataFrame:
    """One row per keys and one column per value, with the aggregate of the rows that have it.

    The values are given, so that no job has to look for them.
    """
    require(df, [*keys, column])
    return df.groupBy(*[_c(x) for x in keys]).pivot(column, list(values)).agg(aggregate_column(agg))


def union(first: DataFrame, *more: DataFrame) -> DataFrame:
    """UNION ALL by name, in the first one's column order; names and types must agree."""
    for other in more:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"different columns: {first.columns} and {other.columns}")
        odd = [(n, t, dict(other.dtypes)[n]) for n, t in first.dtypes if dict(other.dtypes)[n] != t]
        if odd:
            raise ValueError(f"different types: {odd}")
    out = first
    for other in more:
        out = out.unionByName(other)
    return out


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    b = b.select(*[_c(n) for n in a.columns])
    return a.intersectAll(b) if all_rows else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    b = b.select(*[_c(n) for n in a.columns])
    return a.exceptAll(b) if all_rows else a.subtract(b)


def deduplicate(df: DataFrame, keys: Sequence[str] = (), keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """The first or last row of each key (default: all columns); NULLs are equal.

    ``order_by`` says what first means, and settles hot keys by aggregation: a
    key's rows are reduced before the shuffle.  Without it the order is that in
    which the rows were read, which holds for a plan that reads files and
    filters or projects.
    """
    keys = list(keys) or df.columns
    require(df, [*keys, *order_by])
    if keep not in ("first", "last"):
        raise ValueError(f"unknown strategy {keep!r}")
    if set(keys) == set(df.columns):
        return df.distinct()
    ordered = df if order_by else df.withColumn("_at", F.monotonically_increasing_id())
    order = F.struct(*[_c(n) for n in (order_by or ["_at"])])
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[_c(c) for c in df.columns])
    picked = ordered.groupBy(*[_c(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(row, order).alias("_row"))
    return picked.select("_row.*")


def cast_safe(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast, or fail: malformed text, overflow, cut-off fractions and lost digits raise.

    A number must come back as it was; that holds for whole numbers too, of
    which a double keeps 53 bits only.
    """
    require(df, types)
    kinds = dict(df.dtypes)

    def cast(name: str) -> Column:
        x, to = _c(name), types[name]
        done = x.try_cast(to)
        lost = x.isNotNull() & done.isNull()
        if kinds[name] in ("float", "double") or kinds[name].startswith("decimal"):
            lost = lost | ((done.try_cast(kinds[name]) != x) & ~F.isnan(x.cast("double")))
        elif kinds[name] in ("tinyint", "smallint", "int", "bigint") and to.lower() not in ("string", "boolean"):
            # 2**63 and above would come back as the largest number
            high = F.coalesce(done.try_cast("double") >= F.lit(2.0**63), F.lit(False))
            lost = lost | (x.isNotNull() & (high | ~done.try_cast(kinds[name]).eqNullSafe(x)))
        bad = F.raise_error(F.concat(F.lit(f"cannot cast {name} to {to} without loss: "), x.cast("string")))
        return F.when(lost, bad.cast(to)).otherwise(done).alias(name)

    return df.select(*[cast(n) if n in types else _c(n) for n in df.columns])


def handle_nulls(df: DataFrame, strategy: str, columns: Sequence[str] = (), value: object = None) -> DataFrame:
    """``keep``; ``drop`` rows with a NULL; ``fill`` with a value; ``zero``; ``empty``
    text; ``impute`` numbers by their mean and others by their most frequent value."""
    columns = list(columns) or df.columns
    require(df, columns)
    kinds = dict(df.dtypes)
    number = {n for n in columns if kinds[n] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[n].startswith("decimal")}
    match strategy:
        case "keep":
            return df
        case "drop":
            return df.na.drop(how="any", subset=columns)
        case "fill":
            fill = {n: F.lit(value).cast(kinds[n]) for n in columns}
        case "zero":
            fill = {n: F.lit(0).cast(kinds[n]) for n in number}
        case "empty":
            fill = {n: F.lit("") for n in columns if kinds[n] == "string"}
        case "impute":
            row = df.agg(*[(F.avg(_c(n)) if n in number else F.mode(_c(n))).alias(n) for n in columns]).first()
            fill = {n: F.lit(row[n]).cast(kinds[n]) for n in columns if row[n] is not None}
        case _:
            raise ValueError(f"unknown strategy {strategy!r}")
    return df.select(*[F.coalesce(_c(n), fill[n]).alias(n) if n in fill else _c(n) for n in df.columns])


def quality_failures(df: DataFrame, rules: dict[str, Sequence[str]]) -> list[str]:
    """What fails, from one pass over the data; unknown rules and columns are failures."""
    failures, checks, kinds = [], {}, dict(df.dtypes)
    for name, wanted in rules.items():
        for rule in [wanted] if isinstance(wanted, str) else wanted:
            low = rule.lower()
            if name not in kinds:
                failures.append(f"{name}: no such column")
            elif low in ("not_null", "nonnull", "required"):
                checks[name, "has nulls"] = F.count_if(_c(name).isNull())
            elif low in ("unique", "distinct"):
                checks[name, "repeats"] = F.count(_c(name)) - F.count_distinct(_c(name))
            elif low == "positive":
                x = _c(name)
                if kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal"):
                    checks[name, "is not positive"] = F.count_if(~(x > 0))
                else:
                    failures.append(f"{name}: is not a number")
            else:
                failures.append(f"{name}: unknown rule {rule!r}")
    if checks:
        row = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(checks.values())]).first()
        failures += [f"{n}: {what} ({row[i]} rows)" for i, (n, what) in enumerate(checks) if row[i]]
    return failures


def quality_check(df: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """``df`` itself if every rule holds, else ``QualityCheckFailed`` with all failures."""
    if failures := quality_failures(df, rules):
        raise QualityCheckFailed(failures)
    return df
