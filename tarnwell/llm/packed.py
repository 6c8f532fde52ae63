"""Entries by the million as packed arrays: one row a bucket and batch instead of one an entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .common import shuffle_partitions

#: Buckets for each shuffle partition, at least.
BUCKETS_EACH = 4
#: Pairs that are looked at together.
PAIRS = 500_000


def bucket_count(spark: SparkSession, entries: int, most: int) -> int:
    """So many buckets that one has about ``most`` of the entries at most, whatever the partitions."""
    return max(BUCKETS_EACH * shuffle_partitions(spark), -(-entries // most))


def by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``bucket int`` and each column's entries as ``binary``, one row for each bucket that has any."""
    schema = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in columns])
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    parts = [x[order] for x in columns.values()]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    for k in range(0, len(starts), rows):
        cuts = list(zip(starts[k : k + rows].tolist(), ends[k : k + rows].tolist(), strict=True))
        arrays = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[k : k + rows]].astype(np.int32)), *arrays], schema=schema)


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """All entries of a packed column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def across(keys: np.ndarray, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of entries of one key and different classes, each once, some at a time.

    Entries of one key and class never meet, however many there are.
    """
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    changes = keys[1:] != keys[:-1]
    ends = np.append(np.flatnonzero(changes) + 1, len(keys))
    stop = np.repeat(ends, np.diff(np.append(0, ends)))
    ends = np.append(np.flatnonzero(changes | (classes[1:] != classes[:-1])) + 1, len(keys))
    after = np.repeat(ends, np.diff(np.append(0, ends)))
    left = np.flatnonzero(after < stop)
    counts = stop[left] - after[left]
    cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(counts) // PAIRS)))
    for a, b in zip(cuts, np.append(cuts, len(left))[1:], strict=True):
        n = counts[a:b]
        x = np.repeat(left[a:b], n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(after[left[a:b]], n)
        yield order[x], order[y]
