"""Connected components of an edge list, without gathering any component.

Large-star and small-star steps alternate until the edges are stars around the
smallest node of each component.  Every step is one aggregation and one join on
the node.  What the aggregation gives is written to the shared folder and read
again, so that the join has two plain sides and adaptive execution can split a
hub's edges among tasks; so are the edges of a step, which bounds lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = saved(both.groupBy(F.col("u").alias("k")).agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    joined = both.where("v > u").join(least, F.col("u") == F.col("k"))
    found = saved(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    discard(least)
    return found


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
    moved = down.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = saved(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    discard(least)
    return found


def stars(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of long ids to ``(u, v)``: every node but a component's
    smallest, with that smallest.  Loops and repeated edges do no harm; rows
    with a null take no part; no edges give no rows."""
    now = saved(edges.where("u <> v").select("u", "v"), "edges")
    mark = None
    if now.isEmpty():
        return now
    while True:
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            return now
        mark = (seen["n"], seen["h"])
