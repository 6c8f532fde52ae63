"""Event-time windows that mean the same on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, time: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, width: str, keys: tuple[str, ...], value: str, time: str = "ts", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by time window (sliding with ``slide``) and keys.

    With ``late`` a stream forgets windows older than that; a table has all its rows.
    """
    events = timed(events, time)
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    events = timed(events, time)
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
