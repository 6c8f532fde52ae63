"""Groups too small to show are left out, with evidence of what was."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.relational import aggregate_column, require
from tarnwell.plans.expr import Agg

_COUNT = "_contributing_rows"


@dataclass(frozen=True)
class Suppression:
    """What a guarded aggregate left out; there is one even where that is nothing."""

    k: int
    groups: int
    suppressed: int

    @property
    def shown(self) -> int:
        return self.groups - self.suppressed


def guarded(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg], k: int) -> DataFrame:
    """The aggregate with each group's contributing rows counted in the same pass."""
    if k < 2:
        raise ValueError("k is at least 2")
    require(df, keys)
    columns = [aggregate_column(a).alias(n) for n, a in aggs.items()]
    counted = F.count("*").alias(_COUNT)
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*columns, counted) if keys else df.agg(*columns, counted)


def shown(counted: DataFrame, k: int) -> DataFrame:
    return counted.where(F.col(_COUNT) >= k).drop(_COUNT)


def suppress(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg], k: int) -> DataFrame:
    """Groups of at least ``k`` contributing rows: one shuffle, no second scan."""
    return shown(guarded(df, keys, aggs, k), k)


def evidence(counted: DataFrame, k: int) -> Suppression:
    row = counted.agg(F.count("*").alias("n"), F.count_if(F.col(_COUNT) < k).alias("s")).first()
    return Suppression(k, row["n"], row["s"])
