"""Tables that cut the lineage of iterative jobs.

Each round of an iteration writes its state as parquet to the folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs the tasks
of one round only, never the chain of rounds.  State that is joined by the
same key in every round is written bucketed, which makes those joins and
aggregations free of shuffles.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for state; a temporary one only in local mode with nothing configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opinara-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/opinara/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on the path's own file system, not on the driver's disk."""
    hadoop_path, filesystem = _filesystem(spark, path)
    return filesystem.exists(hadoop_path)


#: Pointers are numbered; the highest one counts.
_POINTER = "_committed-"


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of the committed versions in a folder."""
    path, filesystem = _filesystem(spark, folder)
    if not filesystem.exists(path):
        return []
    names = [status.getPath().getName() for status in filesystem.listStatus(path)]
    parts = [name[len(_POINTER) :].split("-", 1) for name in names if name.startswith(_POINTER)]
    return sorted((int(number), version) for number, version in parts)


def commit(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the one that counts, by a pointer whose name says which: it is there as a whole or not at all.

    Versions that are no longer named stay, since someone may be reading them.
    """
    last = max((number for number, _ in _pointers(spark, folder)), default=0)
    path, filesystem = _filesystem(spark, f"{folder}/{_POINTER}{last + 1}-{version}")
    filesystem.create(path, True).close()


def committed(spark: SparkSession, folder: str) -> str | None:
    """The version that counts, if any does."""
    found = _pointers(spark, folder)
    return found[-1][1] if found else None


@dataclass
class Stored:
    """A written table; ``drop`` once nothing that is still to run reads it.

    Who reads another's table says ``keep``; the last of its readers to drop it deletes it.
    """

    frame: DataFrame
    path: str
    table: str | None = None
    readers: int = 1

    def keep(self) -> "Stored":
        self.readers += 1
        return self

    def drop(self) -> None:
        self.readers -= 1
        if self.readers > 0:
            return
        spark = self.frame.sparkSession
        if self.table:
            spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        hadoop_path, filesystem = _filesystem(spark, self.path)
        filesystem.delete(hadoop_path, True)


def store(frame: DataFrame, name: str, partition_by: str | None = None) -> Stored:
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path, partitionBy=partition_by, compression="zstd")
    return Stored(spark.read.schema(frame.schema).parquet(path), path)


def store_bucketed(frame: DataFrame, name: str, key: str, buckets: int) -> Stored:
    """Write into hash buckets of ``key``.

    The caller sees to it that ``frame`` is already partitioned by ``key`` into
    ``buckets`` parts, so that each task writes one file.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    table = f"opinara_{name}_{uuid.uuid4().hex}"
    (
        frame.write.format("parquet")
        .option("compression", "zstd")
        .bucketBy(buckets, key)
        .option("path", path)
        .saveAsTable(table)
    )
    return Stored(spark.table(table), path, table)


@contextmanager
def bucket_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Within, a task reads one bucket of a stored table, also where no join or grouping asks for it.

    Else tasks read as many buckets as make up a split, and a bucketed write has to sort them all.
    """
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """Run independent jobs at the same time, so that one fills the slots the other leaves idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in running]
