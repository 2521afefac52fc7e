"""Consecutive row numbers without a one-task window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.sources.state import Stored, store

# monotonically_increasing_id keeps the partition above these bits.
_ROW_BITS = (1 << 33) - 1
#: So many first rows are kept by each task and merged; more are cut from a range sort.
TOP_ROWS = 100_000


@dataclass
class Numbered:
    """Rows with ids, and per partition of the sort its number ``part``, its ``rows`` and sums of measures."""

    frame: DataFrame
    stored: Stored
    rows: int
    parts: list[dict]

    def leading(self, cost: Column, part_costs: list[int], limit: int) -> int:
        """How many rows from the first on cost no more than ``limit`` together, by two levels of prefix sums.

        ``cost`` is of a row and at least 1, ``part_costs`` of the partitions.  Only within the partition
        that passes the limit are rows added up one by one, and no more of them than the limit has units.
        """
        rows = used = 0
        for part, total in zip(self.parts, part_costs, strict=True):
            if used + total > limit:
                inside = self.stored.frame.where((F.col("_part") == part["part"]) & (F.col("_seq") <= limit - used))
                running = F.sum("cost").over(Window.orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0))
                added = inside.select("_seq", cost.alias("cost")).select(running.alias("sum"))
                return rows + added.where(F.col("sum") <= limit - used).count()
            used += total
            rows += part["rows"]
        return rows


def number_rows(frame: DataFrame, order: list[Column], id_column: str, measures: dict[str, Column] | None = None) -> Numbered:
    """Give rows the ids 0 .. n-1 in the stated order.

    A range shuffle sorts the rows; each partition numbers its own and the
    partition sizes give the offsets.  The driver sees one line a partition
    with the row count and the sums of ``measures``.  The order
    must be total, or the ids of equal rows depend on the run.
    """
    spark = frame.sparkSession
    measures = measures or {}
    ranged = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    stored = store(ranged, "numbered")
    sums = [F.sum(expression).alias(name) for name, expression in measures.items()]
    parts = [row.asDict() for row in stored.frame.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), *sums).collect()]
    parts.sort(key=lambda p: p["part"])
    starts, total = [], 0
    for part in parts:
        starts.append((part["part"], total))
        total += part["rows"]
    numbered = (
        stored.frame.join(F.broadcast(spark.createDataFrame(starts, "_part int, _start bigint")), "_part")  # one row per partition
        .withColumn(id_column, F.col("_start") + F.col("_seq"))
        .drop("_part", "_seq", "_start")
    )
    return Numbered(numbered, stored, total, parts)


def first_rows(rows: DataFrame, order: list[Column], n: int, top_rows: int | None = None) -> DataFrame:
    """The first n rows in a total order, whatever n is.

    Few are kept by each task and merged in one; more than ``top_rows`` are
    those of the least numbers of a range sort, and no task has more than its range.
    """
    if n <= (TOP_ROWS if top_rows is None else top_rows):
        return rows.orderBy(*order).limit(n)
    return number_rows(rows, order, "_row_number").frame.where(F.col("_row_number") < n).drop("_row_number")
