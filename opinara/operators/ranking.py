"""Distances between points and cluster centers, and rankings by them.

Points are (doc_id, point), centers (cluster_id, center), both number arrays.
Centers that fit one block of ``block_bytes`` reach every task as one value, so
a point is compared with all of them inside its own row: no pair rows, no
shuffle of points.  More centers are a table of blocks (``center_blocks``) that
points join, as far as the triangle inequality does not rule a block out.

A point can be ranked if it has an id, the centers' length, and neither NULL
nor NaN nor infinite components; any other is left out everywhere.  A center
that is not of this kind raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.numeric import squared_distance
from opinara.operators import center_blocks
from opinara.operators.center_blocks import Fold
from opinara.operators.rowids import first_rows

BLOCK_BYTES = 32 << 20
_CENTER_OVERHEAD = 64
#: Entries that a task ranks by folding: n times the centers of a block.
FOLD_CELLS = 1 << 20


def _finite(values: str) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _size_of(centers: DataFrame) -> tuple[int, int]:
    """Number and length of the centers, all of which have to be usable."""
    right = F.col("cluster_id").isNotNull() & F.col("center").isNotNull() & _finite("center")
    size = centers.agg(
        F.count("*").alias("n"),
        F.count(F.when(right, 1)).alias("right"),
        F.max(F.size("center")).alias("width"),
        F.min(F.size("center")).alias("least"),
    ).first()
    if not size["n"]:
        raise ValueError("there are no centers")
    if size["right"] < size["n"]:
        raise ValueError("a center has no id, or a component that is NULL or not finite")
    if size["width"] != size["least"]:
        raise ValueError("the centers differ in length")
    return size["n"], size["width"]


def usable(points: DataFrame, width: int) -> DataFrame:
    """The points that can be ranked."""
    return points.select("doc_id", "point").where(F.col("doc_id").isNotNull() & F.col("point").isNotNull() & (F.size("point") == width) & _finite("point"))


def _fits(n: int, width: int, block_bytes: int) -> bool:
    return n * (8 * width + _CENTER_OVERHEAD) <= block_bytes


def _value(centers: DataFrame) -> Column:
    """All centers as one array value, by a scalar subquery."""
    entry = F.struct("cluster_id", F.col("center").cast("array<double>").alias("center"))
    return centers.agg(F.sort_array(F.collect_list(entry)).alias("centers")).scalar()


def _entries(sign: int) -> Column:
    """The entries (key, cluster_id) of all centers beside a point.

    The key is the distance, negative where far (-1) centers come first; ties go to the lower id.
    """

    def entry(c: Column) -> Column:
        distance = squared_distance(F.col("point"), c["center"])
        return F.struct((distance * sign).alias("key"), c["cluster_id"].alias("cluster_id"))

    return F.transform("centers", entry)


def _nth_center(points: DataFrame, centers: DataFrame, n: int, sign: int, block_bytes: int) -> DataFrame:
    count, width = _size_of(centers)
    if not 1 <= n <= count:
        raise ValueError(f"n must be in 1 .. {count}, the number of centers")
    points = usable(points, width)
    if _fits(count, width, block_bytes):
        best = F.array_min(_entries(sign)) if n == 1 else F.slice(F.array_sort(_entries(sign)), 1, n)
        found = points.select("doc_id", "point", _value(centers).alias("centers")).select("doc_id", best.alias("best"))
    else:
        blocks = center_blocks.build(centers, count, width, block_bytes)
        # At most n entries per block and document meet here.
        entry = F.struct("key", "cluster_id")
        merged = F.min(entry) if n == 1 else F.slice(F.array_sort(F.collect_list(entry)), 1, n)
        found = blocks.ranked(points, n, sign, FOLD_CELLS).groupBy("doc_id").agg(merged.alias("best"))
    chosen = found.select("doc_id", (F.col("best") if n == 1 else F.element_at("best", n)).alias("chosen"))
    return chosen.select("doc_id", "chosen.cluster_id", (F.col("chosen.key") * sign).alias("distance"))


def center_distances(points: DataFrame, centers: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, cluster_id, distance) of every point to every center."""
    count, width = _size_of(centers)
    points = usable(points, width)
    if _fits(count, width, block_bytes):
        beside = points.select("doc_id", "point", _value(centers).alias("centers"))
    else:
        blocks = center_blocks.build(centers, count, width, block_bytes)
        beside = blocks.met(blocks.every(points))
    distance = squared_distance(F.col("point"), F.col("c.center")).alias("distance")
    return beside.select("doc_id", "point", F.explode("centers").alias("c")).select("doc_id", "c.cluster_id", distance)


def furthest_nth_cluster(
    points: DataFrame, centers: DataFrame, n: int = 1, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, cluster_id, distance): the n-th furthest center of each point, ties by the lower id."""
    return _nth_center(points, centers, n, -1, block_bytes)


def nearest_center(points: DataFrame, centers: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, cluster_id, distance): the cluster each point belongs to."""
    return _nth_center(points, centers, 1, 1, block_bytes)


def within_set_error(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One row (wssse): sum of the squared distances to the nearest center."""
    return nearest_center(points, centers).agg(F.sum("distance").alias("wssse"))


def _nearest_of_partition(points: DataFrame, block: list, n: int, cells: int) -> DataFrame:
    """(cluster_id, doc_id, distance): for each center of a block the n closest points of each partition."""
    ids = np.array([r["cluster_id"] for r in block], np.int64)
    matrix = np.array([r["center"] for r in block], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(ids, matrix, n, cells)
        for batch in batches:
            names = batch.column(0).to_numpy()
            fold.add(names, batch.column(1).flatten().to_numpy().reshape(len(names), matrix.shape[1]))
        yield fold.batch()

    return points.mapInArrow(nearest, "cluster_id bigint, doc_id bigint, distance double")


def closest_nth_points(
    points: DataFrame, centers: DataFrame, n: int = 1, block_bytes: int = BLOCK_BYTES, fold_cells: int = FOLD_CELLS
) -> DataFrame:
    """(cluster_id, doc_id, distance): for each center its n-th closest point, ties by the lower doc id.

    Each task keeps the n closest points of its centers as it goes, and only
    these are shuffled and ranked; no pair of point and center is sorted.
    Centers of one block come to every task, more are met block by block in the
    tasks that hold them.  Where n times the centers of a block is above
    ``fold_cells``, pairs are ranked by a window instead, whose row limit is
    applied inside each partition first.
    """
    if n < 1:
        raise ValueError("n counts from 1")
    count, width = _size_of(centers)
    points = usable(points.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("point").cast("array<double>").alias("point")), width)
    in_a_block = count if _fits(count, width, block_bytes) else center_blocks.PER_BLOCK
    if n * in_a_block > fold_cells:
        near = center_distances(points, centers, block_bytes)
    elif _fits(count, width, block_bytes):
        block = centers.select(F.col("cluster_id").cast("long"), F.col("center").cast("array<double>")).collect()
        near = _nearest_of_partition(points, block, n, fold_cells)
    else:
        near = center_blocks.build(centers, count, width, block_bytes).closest(points, n, fold_cells)
    order = Window.partitionBy("cluster_id").orderBy(F.col("distance"), F.col("doc_id"))
    ranked = near.withColumn("rank", F.row_number().over(order))
    nth = ranked.where(F.col("rank") <= n).where(F.col("rank") == n)
    return nth.select("cluster_id", "doc_id", "distance")


def closest_nth_point(points: DataFrame, centers: DataFrame, cluster_id: int, n: int = 1) -> DataFrame:
    """(doc_id, distance): the n-th closest point to one center, which must exist exactly once."""
    if n < 1:
        raise ValueError("n counts from 1")
    wanted = centers.where(F.col("cluster_id") == cluster_id)
    if len(wanted.take(2)) != 1:
        raise ValueError(f"cluster {cluster_id} is not in the centers exactly once")
    _, width = _size_of(wanted)
    center = wanted.agg(F.first("center")).scalar().alias("center")
    placed = usable(points, width).select("doc_id", "point", center)
    distances = placed.select("doc_id", squared_distance(F.col("point"), F.col("center")).alias("distance"))
    return nth_row(distances, [("distance", True), ("doc_id", True)], n)


def nth_row(rows: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The n-th row in the order given as (column, ascending), by two selections of first rows."""
    if rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    forward = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    backward = [F.col(c).desc() if up else F.col(c).asc() for c, up in order]
    return first_rows(rows, forward, n).orderBy(*backward).limit(1)


def most_useful(scored: DataFrame, n: int = 1, score: str = "prediction", top_rows: int | None = None) -> DataFrame:
    """The n rows with the highest score, ties by the lower doc id; any number (``first_rows``)."""
    return first_rows(scored, [F.col(score).desc(), F.col("doc_id").asc()], n, top_rows)


def most_useful_per(scored: DataFrame, group: str, score: str = "prediction") -> DataFrame:
    """(group, doc_id, score): the row with the highest score of each group; partial maxima, no group in one task."""
    best = F.max_by(F.struct("doc_id", score), F.struct(F.col(score), -F.col("doc_id"))).alias("best")
    return scored.groupBy(group).agg(best).select(group, "best.*")
