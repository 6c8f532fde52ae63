"""Mixing sources to target weights by capped water-filling.

Everything here is DataFrame expressions: one scan measures the documents, the
per-source arithmetic runs over one row per source, and a hash-ordered pass
decides which documents get the fractional repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, word_count

#: Hex digits of the sampling key that make a bucket: 16**3 buckets a source.
BUCKET_DIGITS = 3


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Targets for ``sources(source, weight, source_size)``.

    The total of all sizes is shared by weight.  A source whose share exceeds
    ``max_epochs`` times its size is clamped there and the excess goes to the
    others by weight, until none is above.  Clamping happens in the order of
    cap / weight, so the fixed point is found with running sums instead of a
    loop: a source is clamped exactly if its share of what the sources before
    it left over still exceeds its cap.

    One row per source enters the window, never a row per document.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("position"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    clamped = sources.withColumn("cap", cap).withColumn("clamped", level * F.col("weight") >= F.col("cap"))
    spent = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(F.lit(0.0))).over(whole)
    open_weight = F.sum(F.when(F.col("clamped"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    rest = F.try_divide(F.sum("source_size").over(whole) - spent, open_weight)
    return clamped.withColumn(
        "target", F.when(F.col("clamped"), F.col("cap")).otherwise(rest * F.col("weight"))
    ).drop("cap", "clamped")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds ``position`` (by code point, null last) and ``weight`` 1..cycle, repeating."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("position", position).withColumn("weight", (F.col("position") - 1) % cycle + 1)


def sampling_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded pseudo-random order of documents that any engine can recompute.

    The text has a part in it, so that rows of a repeated or missing id are spread too.
    """
    own = F.coalesce(F.md5(text.cast("binary")), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))


def _measured(docs: DataFrame, seed: int, *columns: Column) -> DataFrame:
    draw = sampling_key(F.col("doc_id"), F.col("text"), seed)
    return docs.select(
        *columns,
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        draw.alias("_draw"),
        F.substring(draw, 1, BUCKET_DIGITS).alias("_bucket"),
    )


def _plan(measured: DataFrame, max_epochs: float, cycle: int) -> DataFrame:
    """One row per source: target, whole repetitions, and where the rest ends."""
    buckets = saved(
        measured.groupBy(F.col("_source").alias("source"), F.col("_bucket").alias("bucket")).agg(
            F.sum("_size").alias("bucket_size")
        ),
        "mix-buckets",
    )
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = saved(
        water_fill(cyclic_weights(sources, cycle), max_epochs)
        .withColumn("whole", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
        .withColumn("quota", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)))
        .select(F.col("source").alias("_s"), "source_size", "target", "whole", "quota"),
        "mix-targets",
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
        .join(targets.select("_s", "quota"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("bucket_size")))
        .select(F.col("source").alias("_l"), F.col("bucket").alias("last_bucket"), "before")
    )
    return saved(
        targets.join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").select(
            "_s",
            F.col("source_size").alias("_source_size"),
            F.col("target").alias("_target"),
            F.col("whole").alias("_whole"),
            F.col("quota").alias("_quota"),
            F.col("last_bucket").alias("_last"),
            F.col("before").alias("_before"),
        ),
        "mix-plan",
    )


def _filled(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``_extra``, the words of a row that the fractional repetition takes."""
    planned = measured.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    on_edge = F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))
    order = Window.partitionBy("_source").orderBy("_draw", "_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_quota") - F.col("_before") - F.coalesce(F.sum("_size").over(order), F.lit(0))
    edge = planned.where(on_edge).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), left)))
    rest = planned.where(~on_edge).withColumn(
        "_extra", F.when(F.col("_bucket") < F.col("_last"), F.col("_size")).otherwise(F.lit(0))
    )
    return rest.unionByName(edge)


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 42, cycle: int = 3) -> DataFrame:
    """How many words of every document the mix takes.

    Returns ``doc_id, size, source_size, target, taken``, one row per input row.

    A document is taken ``floor(target / source_size)`` times whole.  The
    remaining quota of its source is filled in the order of a seeded hash; the
    document on which it runs out is taken in part, so a source's taken words
    are its target rounded to a word.  Hash prefixes make buckets: only the
    bucket in which a quota runs out is ordered row by row, so a source with a
    third of all rows costs no task more than 1/4096 of them.

    Null text: size 0.  Null source: a source of its own, placed last.  Null or
    repeated ``doc_id``: each row is a document of its own.  Empty input:
    empty result.  Other columns are ignored.
    """
    measured = saved(_measured(docs, seed, F.col("doc_id")), "mix-sizes")
    return _filled(measured, _plan(measured, max_epochs, cycle)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, max_epochs: int = 3, seed: int = 42, cycle: int = 3) -> DataFrame:
    """The mix itself: each input row as often as it is taken, all its columns.

    The one document of a source that is taken in part appears if at least half
    of it is.  A document without words follows its source's whole repetitions.
    """
    measured = _measured(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    slim = _measured(docs, seed)
    copies = F.col("_whole") + F.when((F.col("_extra") > 0) & (F.col("_extra") * 2 >= F.col("_size")), 1).otherwise(0)
    return (
        _filled(measured, _plan(slim, max_epochs, cycle))
        .where(copies > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select("_row.*")
    )


MIX_SQL = """
WITH m AS (
  SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM m GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, (CAST(CAST(sum(source_size) OVER () AS BIGINT) AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / CAST(sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            * weight >= cap AS clamped
  FROM c
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE
      (CAST(CAST(sum(source_size) OVER () AS BIGINT) AS DOUBLE)
       - sum(CASE WHEN clamped THEN cap ELSE 0.0::DOUBLE END) OVER ())
      / CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS DOUBLE) * weight END AS target
  FROM l
), q AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM t
), r AS (
  SELECT m.doc_id, m.size, q.source_size, q.target, q.whole,
         CAST(floor(q.target - CAST(q.whole * q.source_size AS DOUBLE) + 0.5) AS BIGINT) AS quota,
         coalesce(CAST(sum(m.size) OVER (PARTITION BY m.source ORDER BY m.draw, m.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM m JOIN q ON m.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, quota - before)) AS BIGINT) AS taken
FROM r
"""
