"""Many centers as a table of blocks, met by points without passing the driver.

Centers are dealt to the nearest of some pivots, drawn from among them by a
hash of their ids, and a pivot's centers are cut into blocks of bounded size.
A directory has one line a block: pivot, radius and number of centers.  By the
triangle inequality a point at distance d of a pivot has no center of the block
nearer than d - radius and none further than d + radius, so it only has to meet
the blocks that can hold its nearest (or furthest) ones; a block only meets the
points that can be among the closest of one of its centers.

Points and blocks meet in a join by block and salt: each block is repeated for
every salt and each point has one, so a block that most points need is spread.
The directory is bounded by ``block_bytes`` (blocks grow with the number of
centers instead).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.numeric import let, squared_distance
from opinara.sources.state import Stored, store

#: Centers of a block, where the directory does not call for more; copies of a block.
PER_BLOCK, SALTS = 256, 8
_OVERHEAD = 64
#: Wider than distances can be wrong by rounding, relative and absolute.
_SLIP = 1e-9
_KEY = ["pivot_id", "sub", "salt"]


class Fold:
    """The n closest points of each center among those seen so far, ties by the lower id.

    Distances are summed one dimension after the other, as ``squared_distance`` does, and no more than ``cells`` at a time.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, n: int, cells: int):
        self.ids, self.columns, self.n = ids, matrix.T.copy(), n
        self.step = max(1, cells // max(1, len(ids)))
        self.best = np.full((n, len(ids)), np.inf)
        self.docs = np.full((n, len(ids)), np.iinfo(np.int64).max)
        self.found = 0

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        for start in range(0, len(names), self.step):
            part = values[start : start + self.step]
            distance = np.zeros((len(part), len(self.ids)))
            for i in range(len(self.columns)):
                difference = part[:, i, None] - self.columns[i]
                distance += difference * difference
            self.found += len(part)
            near = (distance <= self.best[-1]).any(axis=1)
            both = np.concatenate([self.best, distance[near]])
            named = np.repeat(names[start : start + self.step][near][:, None], len(self.ids), axis=1)
            of = np.concatenate([self.docs, named])
            order = np.lexsort((of, both), axis=0)[: self.n]
            self.best, self.docs = np.take_along_axis(both, order, 0), np.take_along_axis(of, order, 0)

    def batch(self) -> pa.RecordBatch:
        """(cluster_id, doc_id, distance)."""
        kept = min(self.n, self.found)
        arrays = [np.tile(self.ids, kept), self.docs[:kept].ravel(), self.best[:kept].ravel()]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["cluster_id", "doc_id", "distance"])


@dataclass
class CenterBlocks:
    """Blocks (pivot_id, sub, pivot, radius, n, centers) in a stored table."""

    stored: Stored

    def directory(self) -> Column:
        """All lines but the centers, as one value."""
        line = F.struct("pivot_id", "sub", "pivot", "radius", "n")
        return self.stored.frame.agg(F.sort_array(F.collect_list(line)).alias("lines")).scalar()

    def _beside(self, points: DataFrame, directory: Column) -> DataFrame:
        """The points with ``lines``: for each block the least and the largest distance that its centers can have."""
        placed = points.select("doc_id", "point", directory.alias("_directory"))

        def line(b: Column) -> Column:
            distance = F.sqrt(squared_distance(F.col("point"), b["pivot"]))
            return let(
                distance,
                lambda d: F.struct(
                    F.greatest(F.lit(0.0), (d - b["radius"]) * (1 - _SLIP) - _SLIP).alias("low"),
                    ((d + b["radius"]) * (1 + _SLIP) + _SLIP).alias("high"),
                    b["pivot_id"].alias("pivot_id"),
                    b["sub"].alias("sub"),
                ),
            )

        return placed.select("doc_id", "point", F.transform("_directory", line).alias("lines"))

    def needed(self, points: DataFrame, n: int, sign: int) -> DataFrame:
        """(doc_id, point, pivot_id, sub): each point beside the blocks that can have one of its n nearest (1) or furthest (-1) centers.

        Every block has a center at most ``high`` away and at least ``low``, so the n-th of these bounds the n-th center.
        """
        lines = self._beside(points, self.directory())
        if sign > 0:
            bound = F.get(F.array_sort(F.transform("lines", lambda b: b["high"])), F.lit(n - 1))
            keep = lambda b, edge: edge.isNull() | (b["low"] <= edge)
        else:
            bound = F.get(F.sort_array(F.transform("lines", lambda b: b["low"]), asc=False), F.lit(n - 1))
            keep = lambda b, edge: edge.isNull() | (b["high"] >= edge)
        kept = lines.withColumn("edge", bound).select(
            "doc_id", "point", F.explode(F.filter("lines", lambda b: keep(b, F.col("edge")))).alias("b")
        )
        return kept.select("doc_id", "point", "b.pivot_id", "b.sub")

    def every(self, points: DataFrame) -> DataFrame:
        """(doc_id, point, pivot_id, sub): each point beside all blocks."""
        keys = self.stored.frame.agg(F.collect_list(F.struct("pivot_id", "sub"))).scalar()
        return points.select("doc_id", "point", F.explode(keys).alias("b")).select("doc_id", "point", "b.pivot_id", "b.sub")

    def met(self, pairs: DataFrame) -> DataFrame:
        """(doc_id, point, centers) of points beside blocks."""
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        copies = self.stored.frame.select("pivot_id", "sub", "centers", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return salted.join(copies, _KEY).select("doc_id", "point", "centers")

    def ranked(self, points: DataFrame, n: int, sign: int, cells: int) -> DataFrame:
        """(doc_id, key, cluster_id): of each point the n nearest (1) or furthest (-1) centers of every block it needs; the key is distance times sign."""
        kind = points.schema["doc_id"].dataType
        seen = self.needed(points, n, sign).select(
            "pivot_id",
            "sub",
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("bigint").alias("cluster_id"),
            "doc_id",
            F.col("point").cast("array<double>").alias("vector"),
        )
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        own = self.stored.frame.select("pivot_id", "sub", copies, F.explode("centers").alias("c")).select(
            *_KEY, F.lit(0).alias("kind"), F.col("c.cluster_id").alias("cluster_id"), F.lit(None).cast(kind).alias("doc_id"), F.col("c.center").alias("vector")
        )
        rows = own.unionByName(seen).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind")
        return rows.mapInArrow(_rank_centers(n, sign, cells), f"doc_id {kind.simpleString()}, key double, cluster_id bigint")

    def closest(self, points: DataFrame, n: int, cells: int) -> DataFrame:
        """(cluster_id, doc_id, distance): of each center the n closest points of every block and salt."""
        directory = self.directory()
        bounds = self._beside(points, directory).select("doc_id", F.explode("lines").alias("b")).select("doc_id", "b.*")
        # The n-th point by its largest distance bounds the n-th point of every center of the block.
        order = Window.partitionBy("pivot_id", "sub").orderBy("high", "doc_id")
        nth = bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).where(F.col("rank") == n)
        edges = store(nth.select("pivot_id", "sub", F.col("high").alias("edge")), "block_edges").frame
        lines = self.stored.frame.join(edges, ["pivot_id", "sub"], "left").select(
            F.struct("pivot_id", "sub", "pivot", "radius", "n", "edge").alias("line")
        )
        given = lines.agg(F.sort_array(F.collect_list("line")).alias("lines")).scalar()

        def can(b: Column) -> Column:
            return b["edge"].isNull() | ((F.sqrt(squared_distance(F.col("point"), b["pivot"])) - b["radius"]) * (1 - _SLIP) - _SLIP <= b["edge"])

        chosen = points.select("doc_id", "point", given.alias("_lines")).select("doc_id", "point", F.explode(F.filter("_lines", can)).alias("b"))
        seen = chosen.select(
            "b.pivot_id",
            "b.sub",
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
            F.lit(1).alias("kind"),
            F.col("doc_id").alias("id"),
            F.col("point").alias("vector"),
        )
        own = self.stored.frame.select("pivot_id", "sub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.explode("centers").alias("c"))
        rows = own.select(*_KEY, F.lit(0).alias("kind"), F.col("c.cluster_id").alias("id"), F.col("c.center").alias("vector")).unionByName(seen)
        return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "kind").mapInArrow(_fold_cells(n, cells), "cluster_id bigint, doc_id bigint, distance double")


def _fold_cells(n: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block and salt: its centers, which come first and are bounded, meet the points as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, fold = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            ids = batch.column(4).to_numpy()
            values = batch.column(5).flatten().to_numpy().reshape(len(ids), -1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(ids)]):
                key = tuple(keys[begin, :3])
                if key != current:
                    if fold is not None and fold.found:
                        yield fold.batch()
                    current, held, fold = key, [], None
                if keys[begin, 3] == 0:
                    held.append((ids[begin:end], values[begin:end]))
                    continue
                if fold is None:
                    fold = Fold(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), n, cells)
                    held = []
                fold.add(ids[begin:end], values[begin:end])
        if fold is not None and fold.found:
            yield fold.batch()

    return run


def _rank_centers(n: int, sign: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block and salt: its centers, which come first and are bounded, are ranked for the points as they pass."""

    def ranked(points: np.ndarray, ids: np.ndarray, centers: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, cluster_id) of the n first centers of each point.

        A matrix product rules out centers that cannot be among them however it rounds; the distances of the
        others are summed one dimension after the other, as ``squared_distance`` does.
        """
        with np.errstate(all="ignore"):
            own = (points * points).sum(axis=1)
            rough = sign * (own[:, None] - 2.0 * (points @ centers.T) + norms)
            slip = _SLIP * (own + norms.max()) * 4.0 + np.finfo(float).tiny
        if n >= len(ids) or not (np.isfinite(rough).all() and np.isfinite(slip).all()):
            row, at = np.divmod(np.arange(len(points) * len(ids)), len(ids))
        else:
            edge = np.partition(rough, n - 1, axis=1)[:, n - 1] + slip
            row, at = np.nonzero(rough <= edge[:, None])
        distance = np.zeros(len(row))
        with np.errstate(over="ignore"):
            for i in range(points.shape[1]):
                difference = points[row, i] - centers[at, i]
                distance += difference * difference
        key = distance * sign
        order = np.lexsort((ids[at], key, row))
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < n
        return row[kept], key[order][kept], ids[at][order][kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            ids = batch.column(4).fill_null(0).to_numpy()
            values = batch.column(6).flatten().to_numpy().reshape(len(ids), -1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(ids)]):
                key = tuple(keys[begin, :3])
                if key != current:
                    current, held, block = key, [], None
                if keys[begin, 3] == 0:
                    held.append((ids[begin:end], values[begin:end]))
                    continue
                if block is None:
                    centers = np.concatenate([h[1] for h in held])
                    with np.errstate(over="ignore"):
                        block, held = (np.concatenate([h[0] for h in held]), centers, (centers * centers).sum(axis=1)), []
                step = max(1, cells // len(block[0]))
                for start in range(begin, end, step):
                    row, distance, cluster = ranked(values[start : min(end, start + step)], *block)
                    docs = batch.column(5).take(pa.array(start + row))
                    yield pa.RecordBatch.from_arrays([docs, pa.array(distance), pa.array(cluster)], ["doc_id", "key", "cluster_id"])

    return run


def build(centers: DataFrame, count: int, width: int, block_bytes: int, per_block: int | None = None) -> CenterBlocks:
    """Blocks of (cluster_id, center) rows, all of the same width; ``count`` is their number."""
    row = 8 * width + _OVERHEAD
    per_block = max(per_block or PER_BLOCK, math.ceil(count * row / block_bytes))
    pivots = max(1, math.ceil(count / per_block))
    centers = centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("center").cast("array<double>").alias("center"))
    drawn = centers.orderBy(F.xxhash64("cluster_id"), "cluster_id").limit(pivots)
    entry = F.struct(F.col("cluster_id").alias("pivot_id"), F.col("center").alias("pivot"))
    given = drawn.agg(F.sort_array(F.collect_list(entry)).alias("pivots")).scalar()

    def key(p: Column) -> Column:
        distance = squared_distance(F.col("center"), p["pivot"])
        return F.struct(distance.alias("distance"), p["pivot_id"].alias("pivot_id"), p["pivot"].alias("pivot"))

    placed = centers.select("cluster_id", "center", given.alias("_pivots")).select(
        "cluster_id", "center", F.array_min(F.transform("_pivots", key)).alias("p")
    )
    own = store(placed.select("cluster_id", "center", "p.*"), "center_pivots")
    parts = own.frame.groupBy("pivot_id").agg(F.ceil(F.count("*") / F.lit(per_block)).cast("int").alias("parts"))
    cut = own.frame.join(parts, "pivot_id").withColumn("sub", F.pmod(F.xxhash64("cluster_id"), F.col("parts")).cast("int"))
    blocks = cut.groupBy("pivot_id", "sub").agg(
        F.first("pivot").alias("pivot"),
        F.sqrt(F.max("distance")).alias("radius"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("cluster_id", "center"))).alias("centers"),
    )
    stored = store(blocks, "center_blocks")
    own.drop()
    return CenterBlocks(stored)
