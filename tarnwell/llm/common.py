"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.  ``bytes.split()``
#: cuts at exactly the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs in one process a
    folder of our own is made; on a cluster its absence is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
        place = tempfile.mkdtemp(prefix="tarnwell-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's switch for deleting the shuffle files of a query when it ends, instead of some time later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    What was shuffled for it is deleted at once: nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_STATE: list = [None, None]


def worker_state(key, make):
    """What a Python worker keeps between tasks: one operator's state, the latest.

    Workers are used again by later stages; without this each would hold the
    stores of every operator it ever ran.
    """
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        _STATE[:] = [key, make()]
    return _STATE[1]


@contextmanager
def uncollected():
    """Without the cyclic garbage collector, which finds nothing in millions of strings but looks at all of them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the system.

    Workers wait for later stages; what they hold then is of no use to anyone.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drawn(df: DataFrame, rows: int, n: int, salt: int, column: str = "doc_id") -> DataFrame:
    """At most ``rows`` distinct ids of ``df``, which has ``n`` rows: the first in the order of a hash.

    Null ids are never drawn.  A bound on the 64-bit hash first leaves about
    four times as many, so that little is shuffled at any size; a sample is
    never empty unless there is nothing to draw from.
    """
    draw = F.xxhash64(column, F.lit(salt))
    ids = df.where(F.col(column).isNotNull()).select(column)
    if n > 4 * rows:
        ids = ids.where(draw <= -(2**63) + (2**64 * 4 * rows) // n)
    return ids.distinct().orderBy(draw, column).limit(rows)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be sent to every task if it has at most ``most`` rows (they are
    counted), else as it is, to be joined as Spark finds best."""
    return F.broadcast(df) if df.count() <= most else df


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
