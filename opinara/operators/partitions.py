"""How many parts to cut data into, from the bytes that will be scanned."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

_BYTES_PER_BUCKET = 256 << 20
# Files are compressed, and what a task sorts and sums of a bucket is many times their bytes.
_UNPACKED = 8
# Spark allows 100,000 buckets; beyond this number they grow with the input instead.
MOST_BUCKETS = 50_000
# Below this much per task slot an input may sit in too few splits to keep all slots busy.
_SMALL_PER_SLOT = 64 << 20
# Plans without statistics claim sizes beyond this.
_UNKNOWN_SIZE = 1 << 60


def scanned_bytes(frame: DataFrame) -> int:
    """Sum over the scans of the plan; estimates further up multiply at every join."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _slots(frame: DataFrame) -> int:
    spark = frame.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(partitions, spark.sparkContext.defaultParallelism))


def choose_buckets(frame: DataFrame) -> int:
    """One bucket per task slot at least, more when the input's files call for them.

    The files count as they lie there, before filters; give ``buckets`` where
    only a small part of them is taken.
    """
    size = scanned_bytes(frame)
    if size > _UNKNOWN_SIZE:
        return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return buckets_for(_UNPACKED * size, _slots(frame))


def buckets_for(size: int, slots: int) -> int:
    return min(MOST_BUCKETS, max(slots, math.ceil(size / _BYTES_PER_BUCKET)))


def spread(frame: DataFrame) -> DataFrame:
    """A small input over all task slots; a large one is cut by its files already and stays as it is."""
    slots = _slots(frame)
    return frame.repartition(slots) if scanned_bytes(frame) < slots * _SMALL_PER_SLOT else frame
