"""K-means as rounds of table jobs, for one set of points or for every group of them at the same time.

A round finds the nearest center of its group for each point and sums the points
by (group, cluster, component).  Only partial sums are shuffled, so a group that
has most of the points is spread over all tasks.  The centers of many groups are
a table, packed into one row a group that points join; up to ``SMALL_CELLS``
numbers are handed to the tasks as values instead, which spares a table a round.

The result is a function of the points and the seed alone, however they are
partitioned: points are drawn by hashes of their ids, ties go to the lower
cluster, and values are rounded to a grid on which every sum is exact in
doubles, so no order of adding matters (whole numbers, such as term
frequencies, are on it already).

Two starts: ``hash`` takes the k points of the least hashes; ``parallel`` is
k-means||: a first point, rounds that draw points by their share of the cost,
and a weighted k-means++ over the drawn ones, each weighted by the points
nearest to it.

Points are (group_id, doc_id, entries), the entries of the non-zero components
(i, v) in order.  A group of fewer different points than k has fewer clusters.
A cluster that loses all its points keeps its center.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.numeric import let
from opinara.functions.text import hash32, hash_unit
from opinara.sources.state import Stored, store

# Number of clusters, rounds.
CLUSTERS = 5
ITERATIONS = 10
#: Rounds of draws of the parallel start, and points that one of them draws, in multiples of k.
START_ROUNDS, OVERSAMPLING = 2, 2.0
#: Rounds of the weighted k-means over the drawn points.
_LOCAL_ROUNDS = 30

#: Components of all centers that may come to the driver; more are a table.
SMALL_CELLS = 1 << 20

#: Group of points that are not grouped.
ALL = "all"

_ENTRIES = "array<struct<i:int,v:double>>"
_CENTERS = "array<struct<cluster_id:bigint,norm:double,center:array<double>>>"
# Doubles hold whole numbers up to 2^53; one bit is kept for rounding.
_EXACT_BITS = 52


def points_of_arrays(rows: DataFrame, point: Column, group: Column | None = None) -> DataFrame:
    """Points from a column of number arrays; rows without an id, or with a NULL or non-finite component, are left out."""
    entries = let(point.cast("array<double>"), vector_entries).alias("entries")
    points = rows.select((F.lit(ALL) if group is None else group).alias("group_id"), "doc_id", entries)
    return points.where(F.col("doc_id").isNotNull() & F.col("entries").isNotNull())


def _finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def points_of_vectors(vectors: DataFrame, column: str = "features", group: Column | None = None) -> DataFrame:
    """Points from a column of ML vectors, which Arrow shows as they are stored; the rows left out are those of ``points_of_arrays``."""
    rows = vectors.select((F.lit(ALL) if group is None else group).alias("group_id"), "doc_id", F.col(column).alias("vector"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("vector").isNotNull())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(2)
            values, indices = vector.field("values"), vector.field("indices")
            lengths = np.diff(values.offsets.to_numpy())
            flat, at = values.flatten().to_numpy(), np.zeros(0, np.int32)
            sparse = vector.field("type").to_numpy() == 0
            if len(flat):
                at = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                at[np.repeat(sparse, lengths)] = indices.flatten().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            right = np.ones(len(lengths), bool)
            right[row[~np.isfinite(flat)]] = False
            kept = right[row] & (flat != 0)
            entries = _entry_lists(np.bincount(row[kept], minlength=len(lengths)), at[kept], flat[kept])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), entries], ["group_id", "doc_id", "entries"])
            yield out.filter(pa.array(right))

    return rows.mapInArrow(unpack, f"{_kinds(rows)}, entries {_ENTRIES}")


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in ("group_id", "doc_id"))


def _entry_lists(lengths: np.ndarray, at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(values)], ["i", "v"]))


@dataclass
class _Rows:
    """The entries of a batch: the row, index and value of each, and the rows' norms, added up one after the other."""

    n: int
    row: np.ndarray
    at: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, entries: pa.ListArray) -> "_Rows":
        lengths = np.diff(entries.offsets.to_numpy())
        flat = entries.flatten()
        at, values = (np.asarray(flat.field(name)) for name in ("i", "v"))
        return cls(len(lengths), np.repeat(np.arange(len(lengths)), lengths), at, values)

    def sums(self, terms: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=terms, minlength=self.n)

    def norms(self) -> np.ndarray:
        return self.sums(self.values * self.values)


def array_of(vector: str) -> Column:
    """A vector column as arrays; NULL where it is NULL, which the library's function does not take."""
    return F.when(F.col(vector).isNotNull(), vector_to_array(vector))


def points_of_terms(packed: DataFrame, group: Column | None = None) -> DataFrame:
    """Points from ``packed_tf`` rows; documents without words, whose terms are NULL, are the zero vector."""
    entries = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<bucket:bigint,tf:bigint>>")),
        lambda t: F.struct(t["bucket"].cast("int").alias("i"), t["tf"].cast("double").alias("v")),
    )
    return packed.select((F.lit(ALL) if group is None else group).alias("group_id"), "doc_id", entries.alias("entries"))


# -- columns ---------------------------------------------------------------------------


def _dense(entries: Column, width: int) -> Column:
    """The whole array of ordered entries, in one pass: zeros up to each entry, then its value."""

    def filled(given: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(given, lambda e: e["i"]))
        pieces = F.zip_with(
            given, F.slice(before, 1, F.size(given)), lambda e, last: F.concat(F.array_repeat(F.lit(0.0), e["i"] - last - 1), F.array(e["v"]))
        )
        return F.concat(F.flatten(pieces), F.array_repeat(F.lit(0.0), F.lit(width - 1) - F.element_at(before, -1)))

    return let(entries, filled)


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)


def _norm(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["v"] * e["v"])


def _distances(centers: Column, entries: Column, norm: Column) -> Column:
    """(distance, cluster_id) of every center."""

    def key(c: Column) -> Column:
        product = F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["v"] * F.coalesce(F.get(c["center"], e["i"]), F.lit(0.0)))
        return F.struct(F.greatest(F.lit(0.0), norm - 2 * product + c["norm"]).alias("distance"), c["cluster_id"].alias("cluster_id"))

    return F.transform(centers, key)


def nearest(centers: Column, entries: Column, norm: Column) -> Column:
    """(distance, cluster_id) of the nearest center; ties by the lower id."""
    return F.array_min(_distances(centers, entries, norm))


def furthest(centers: Column, entries: Column, norm: Column) -> Column:
    """(distance, cluster_id) of the furthest center; ties by the lower id."""
    keys = F.transform(_distances(centers, entries, norm), lambda d: F.struct((-d["distance"]).alias("near"), d["cluster_id"].alias("cluster_id")))
    return let(F.array_min(keys), lambda d: F.struct((-d["near"]).alias("distance"), d["cluster_id"].alias("cluster_id")))


def vector_entries(vector: Column) -> Column:
    """The non-zero entries of a number array; NULL for an array that is NULL or has a component that is NULL or not finite."""
    indexed = F.transform(vector, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.when(_finite(vector), F.filter(indexed, lambda e: e["v"] != 0).cast(_ENTRIES))


def _grid(total: float) -> float:
    """Steps to a unit of the finest grid on which sums up to ``total`` are exact."""
    return 2.0 ** (_EXACT_BITS - math.ceil(math.log2(max(total, 1e-300))))


# -- the rounds ------------------------------------------------------------------------


def assign(points: DataFrame, packed: DataFrame) -> DataFrame:
    """The points with ``nearest``; points of groups without centers are left out."""
    found = nearest(F.col("centers"), F.col("entries"), F.col("norm"))
    return points.join(packed, "group_id").withColumn("nearest", found).drop("centers")


def _pack(centers: DataFrame) -> DataFrame:
    """One row a group: its centers by id; (group_id, cluster_id, center) rows, k a group."""
    entry = let(
        F.struct("cluster_id", "center"),
        lambda c: F.struct(c["cluster_id"].cast("bigint").alias("cluster_id"), _squares(c["center"]).alias("norm"), c["center"].alias("center")),
    )
    return centers.groupBy("group_id").agg(F.sort_array(F.collect_list(entry)).cast(_CENTERS).alias("centers"))


def move(points: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """The packed centers after a round: each in the middle of its points."""
    # The points are counted as one more component, which comes first.
    counted = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("v"))), F.col("entries"))
    rows = assign(points, packed).select("group_id", "nearest.cluster_id", F.explode(counted).alias("e"))
    sums = rows.groupBy("group_id", "cluster_id", F.col("e.i").alias("i")).agg(F.sum("e.v").alias("v"))
    gathered = sums.groupBy("group_id", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("sums"))
    n = F.col("sums")[0]["v"]
    mean = F.transform(F.slice("sums", 2, F.size("sums")), lambda e: F.struct(e["i"].alias("i"), (e["v"] / n).alias("v")))
    moved = _pack(gathered.select("group_id", "cluster_id", _dense(mean, width).alias("center"))).withColumnRenamed("centers", "moved")
    latest = F.transform(
        "centers",
        lambda c: F.coalesce(F.get(F.filter(F.coalesce("moved", F.array().cast(_CENTERS)), lambda m: m["cluster_id"] == c["cluster_id"]), F.lit(0)), c),
    )
    return packed.join(moved, "group_id", "left").select("group_id", latest.alias("centers"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _Rows.of(batch.column(2))
        most, whole, last = np.zeros(rows.n), np.ones(rows.n, bool), np.full(rows.n, -1, np.int32)
        np.maximum.at(most, rows.row, np.abs(rows.values))
        np.maximum.at(last, rows.row, rows.at)
        whole[rows.row[rows.values != np.rint(rows.values)]] = False
        arrays = [*batch.columns, pa.array(rows.norms()), pa.array(most), pa.array(whole), pa.array(last)]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "norm", "most", "whole", "last"])


def _round_to(grid: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows.of(batch.column(2))
            rows.values = np.rint(rows.values * grid) / grid
            entries = _entry_lists(np.bincount(rows.row, minlength=rows.n), rows.at, rows.values)
            arrays = [batch.column(0), batch.column(1), entries, pa.array(rows.norms())]
            yield pa.RecordBatch.from_arrays(arrays, ["group_id", "doc_id", "entries", "norm"])

    return run


@dataclass
class Prepared:
    """Points (group_id, doc_id, entries, norm) in a stored table, the number of components and of groups, and the grid of distances."""

    stored: Stored
    points: DataFrame
    width: int
    groups: int
    distance_grid: float


# -- few centers -----------------------------------------------------------------------
#
# Centers of few groups come to the tasks as values and the sums of a round back to the driver; both are bounded by
# ``SMALL_CELLS``.  The additions are the same, one after the other, so the centers are too, to the last bit.


class _Held:
    """The centers of all groups as matrices by group."""

    def __init__(self, centers: dict):
        self.centers = centers
        self.norms = {g: np.array([np.cumsum(row * row)[-1] if len(row) else 0.0 for row in m]) for g, m in centers.items()}

    def distances(self, group, rows: _Rows, norms: np.ndarray) -> np.ndarray:
        """(center, row)."""
        out = []
        for center, norm in zip(self.centers[group], self.norms[group]):
            product = rows.sums(rows.values * center[rows.at])
            out.append(np.maximum(0.0, norms - 2 * product + norm))
        return np.stack(out)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Per group that has centers: its rows of the batch, their entries, cluster and distance to its center."""
        codes = batch.column(0).dictionary_encode()
        groups, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        for c, group in enumerate(groups):
            if group not in self.centers:
                continue
            own = batch if len(groups) == 1 else batch.filter(pa.array(code == c))
            rows = _Rows.of(own.column(2))
            distances = self.distances(group, rows, own.column(3).to_numpy())
            cluster = distances.argmin(axis=0)
            yield group, own, rows, cluster, distances[cluster, np.arange(rows.n)]

    def sums(self, points: DataFrame, width: int) -> dict:
        """By group: sums (cluster, component) of the points nearest to each center, and their numbers."""
        kind = points.schema["group_id"]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict = {}
            for batch in batches:
                for group, _, rows, cluster, _ in self.parts(batch):
                    size = len(self.centers[group]) * (width + 1)
                    cells = cluster[rows.row] * (width + 1) + rows.at
                    counts = cluster * (width + 1) + width
                    found = np.bincount(cells, rows.values, size) + np.bincount(counts, minlength=size)
                    totals[group] = totals[group] + found if group in totals else found
            for group, total in totals.items():
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(cells)), pa.array(cells), pa.array(total[cells])], ["group_id", "cell", "v"])

        schema = f"group_id {kind.dataType.simpleString()}, cell bigint, v double"
        table = points.mapInArrow(add, schema).groupBy("group_id", "cell").agg(F.sum("v").alias("v")).toArrow()
        out = {g: np.zeros(len(m) * (width + 1)) for g, m in self.centers.items()}
        if table.num_rows:
            codes = table.column("group_id").combine_chunks().dictionary_encode()
            cells, values = table.column("cell").to_numpy(), table.column("v").to_numpy()
            for c, group in enumerate(codes.dictionary.to_pylist()):
                own = codes.indices.to_numpy() == c
                out[group][cells[own]] = values[own]
        return {g: (v.reshape(-1, width + 1)[:, :width], v.reshape(-1, width + 1)[:, width]) for g, v in out.items()}

    def moved(self, points: DataFrame, width: int) -> "_Held":
        after = {}
        for group, (total, n) in self.sums(points, width).items():
            after[group] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], self.centers[group])
        return _Held(after)

    def same(self, other: "_Held") -> bool:
        return all(np.array_equal(m, other.centers[g]) for g, m in self.centers.items())

    def table(self, points: DataFrame) -> DataFrame:
        """(group_id, cluster_id, center)."""
        rows = [(g, c, center.tolist()) for g, m in self.centers.items() for c, center in enumerate(m)]
        kind = points.schema["group_id"].dataType.simpleString()
        return points.sparkSession.createDataFrame(rows, f"group_id {kind}, cluster_id bigint, center array<double>")


def _matrices(drawn: DataFrame, width: int) -> dict:
    """Dense matrices by group of (group_id, place, entries) rows, in the order of places."""
    out: dict = {}
    for row in sorted(drawn.collect(), key=lambda r: r["place"]):
        center = np.zeros(width)
        for e in row["entries"]:
            center[e["i"]] = e["v"]
        out.setdefault(row["group_id"], []).append(center)
    return {g: np.stack(m) for g, m in out.items()}


@dataclass
class Clustering:
    """Centers by group and the points they were fitted to."""

    packed: Stored
    points: Stored
    width: int
    rounds: int

    @property
    def centers(self) -> DataFrame:
        """(group_id, cluster_id, center)."""
        return self.packed.frame.select("group_id", F.explode("centers").alias("c")).select("group_id", "c.cluster_id", "c.center")

    def assigned(self, points: DataFrame | None = None) -> DataFrame:
        """(group_id, doc_id, cluster_id, distance) of the points fitted to, or of others."""
        placed = assign(self.points.frame if points is None else _with_norm(points), self.packed.frame)
        return placed.select("group_id", "doc_id", "nearest.cluster_id", "nearest.distance")

    def cost(self) -> DataFrame:
        """(group_id, n, cost): points and the sum of their squared distances."""
        return self.assigned().groupBy("group_id").agg(F.count("*").alias("n"), F.sum("distance").alias("cost"))

    def furthest(self, doc_ids: DataFrame) -> DataFrame:
        """(group_id, doc_id, cluster_id, distance): of some of the points, the center of their group that is furthest."""
        placed = self.points.frame.join(doc_ids.select("doc_id"), "doc_id", "left_semi").join(self.packed.frame, "group_id")
        found = placed.select("group_id", "doc_id", furthest(F.col("centers"), F.col("entries"), F.col("norm")).alias("f"))
        return found.select("group_id", "doc_id", "f.cluster_id", "f.distance")

    def closest(self, chosen: DataFrame) -> DataFrame:
        """(group_id, cluster_id, doc_id, distance): for each (group_id, cluster_id) the closest point of the whole group.

        Least entries are found within partitions first, so no group meets in one task; ties go to the lower id.
        """
        one = F.filter("centers", lambda c: c["cluster_id"] == F.col("cluster_id"))
        wanted = chosen.join(self.packed.frame, "group_id").select("group_id", "cluster_id", one.alias("one")).where(F.size("one") == 1)
        near = self.points.frame.join(wanted, "group_id").select(
            "group_id",
            "cluster_id",
            F.struct(nearest(F.col("one"), F.col("entries"), F.col("norm"))["distance"].alias("distance"), "doc_id").alias("found"),
        )
        best = near.groupBy("group_id", "cluster_id").agg(F.min("found").alias("found"))
        return best.select("group_id", "cluster_id", "found.doc_id", "found.distance")

    def drop(self) -> None:
        self.packed.drop()
        self.points.drop()


def _with_norm(points: DataFrame) -> DataFrame:
    return points.select("group_id", "doc_id", "entries", _norm(F.col("entries")).alias("norm"))


class KMeans:
    """Clusterings of all groups of points in one set of rounds."""

    def __init__(self, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = 0, start: str = "parallel", start_rounds: int = START_ROUNDS):
        if start not in ("hash", "parallel"):
            raise ValueError(f"unknown start: {start}")
        if k < 1:
            raise ValueError("k counts from 1")
        self.k, self.iterations, self.seed, self.start, self.start_rounds = k, iterations, seed, start, start_rounds

    def fit(self, points: DataFrame, width: int | None = None) -> Clustering:
        """Cluster each group; ``width`` is the number of components where it is not one more than the largest index.

        Stops before ``iterations`` rounds when no center of any group moves.
        """
        held = self.prepare(points, width)
        small = held.groups * self.k * max(held.width, 1) <= SMALL_CELLS
        found, rounds = self._small_rounds(held) if small else self._table_rounds(held)
        return Clustering(found, Stored(held.points, held.stored.path), held.width, rounds)

    def _small_rounds(self, held: "Prepared") -> tuple[Stored, int]:
        if self.start == "hash":
            centers = _Held(_matrices(self._first(held.points, self.k), held.width))
        else:
            centers = _Held(_matrices_of_centers(self._parallel_start(held).collect()))
        rounds, still = 0, False
        while rounds < self.iterations and not still:
            following = centers.moved(held.points, held.width)
            still = following.same(centers)
            centers = following
            rounds += 1
        return store(_pack(centers.table(held.points)), "kmeans_centers"), rounds

    def _table_rounds(self, held: "Prepared") -> tuple[Stored, int]:
        start = self._hash_start(held.points, held.width, self.k) if self.start == "hash" else _pack(self._parallel_start(held))
        found, rounds, still = store(start, "kmeans_centers"), 0, False
        while rounds < self.iterations and not still:
            following = store(move(held.points, found.frame, held.width), "kmeans_centers")
            before = found.frame.withColumnRenamed("centers", "before")
            still = following.frame.join(before, "group_id").where(F.col("centers") != F.col("before")).isEmpty()
            found.drop()
            found = following
            rounds += 1
        return found, rounds

    def prepare(self, points: DataFrame, width: int | None = None) -> "Prepared":
        """The points on their grid, written once, and what is known of them; points of the NULL group are left out."""
        points = points.select("group_id", "doc_id", "entries").where("group_id IS NOT NULL")
        schema = f"{_kinds(points)}, entries {_ENTRIES}, norm double"
        held = store(points.mapInArrow(_measure, schema + ", most double, whole boolean, last int"), "kmeans_points")
        size = held.frame.agg(
            F.count("*").alias("n"),
            F.count_distinct("group_id").alias("groups"),
            F.max("most").alias("most"),
            F.max("norm").alias("norm"),
            F.min("whole").alias("whole"),
            F.max("last").alias("last"),
        ).first()
        found = 1 + (-1 if size["last"] is None else size["last"])
        if width is not None and found > width:
            raise ValueError(f"a component beyond the {width} stated")
        n, most = max(size["n"], 1), size["most"] or 1.0
        if size["whole"] is False or n * most > 2.0**_EXACT_BITS:
            given, grid = held, _grid(n * most)
            held = store(given.frame.select("group_id", "doc_id", "entries").mapInArrow(_round_to(grid), schema), "kmeans_points")
            given.drop()
        # Two points are at most twice the greatest length apart.
        distances = _grid(n * 4 * (size["norm"] or 1.0))
        return Prepared(held, held.frame.select("group_id", "doc_id", "entries", "norm"), width if width is not None else found, size["groups"], distances)

    # -- starts ------------------------------------------------------------------------

    def _first(self, points: DataFrame, n: int) -> DataFrame:
        """The n points of the least hashes of each group, as (group_id, doc_id, entries, place); ranked within partitions first."""
        name = F.concat(F.col("doc_id").cast("string"), F.lit(f":{self.seed}"))
        order = Window.partitionBy("group_id").orderBy(hash32(name), "doc_id")
        ranked = points.select("group_id", "doc_id", "entries", F.row_number().over(order).alias("place"))
        return ranked.where(F.col("place") <= n)

    def _hash_start(self, points: DataFrame, width: int, n: int) -> DataFrame:
        first = self._first(points, n)
        return _pack(first.select("group_id", (F.col("place") - 1).alias("cluster_id"), _dense(F.col("entries"), width).alias("center")))

    def drawn(self, held: "Prepared") -> DataFrame:
        """(group_id, doc_id, entries, place, weight): the points that the parallel start draws and how many are nearest to each."""
        first = self._first(held.points, 1).withColumn("place", F.lit(0).cast("bigint"))
        picked = store(first, "kmeans_drawn")
        for number in range(1, self.start_rounds + 1):
            following = store(picked.frame.unionByName(self._draw(held, picked.frame, number)), "kmeans_drawn")
            picked.drop()
            picked = following
        near = self._near(held, picked.frame)
        weights = near.groupBy("group_id", F.col("cluster_id").alias("place")).agg(F.count("*").alias("weight"))
        return picked.frame.join(weights, ["group_id", "place"])

    def _near(self, held: "Prepared", drawn: DataFrame) -> DataFrame:
        """(group_id, doc_id, cluster_id, distance): the nearest drawn point of each point."""
        expected = 1 + self.start_rounds * OVERSAMPLING * self.k
        if held.groups * expected * max(held.width, 1) > SMALL_CELLS:
            packed = _pack(drawn.select("group_id", F.col("place").alias("cluster_id"), _dense(F.col("entries"), held.width).alias("center")))
            return assign(held.points, packed).select("group_id", "doc_id", "nearest.cluster_id", "nearest.distance")
        centers = _Held(_matrices(drawn, held.width))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, own, _, cluster, distance in centers.parts(batch):
                    arrays = [own.column(0), own.column(1), pa.array(cluster.astype(np.int64)), pa.array(distance)]
                    yield pa.RecordBatch.from_arrays(arrays, ["group_id", "doc_id", "cluster_id", "distance"])

        return held.points.mapInArrow(measure, f"{_kinds(held.points)}, cluster_id bigint, distance double")

    def _draw(self, held: "Prepared", picked: DataFrame, number: int) -> DataFrame:
        """Points, each drawn by its share of the group's cost; places go on in the order of ids."""
        share = F.rint(F.col("distance") * F.lit(held.distance_grid)) / F.lit(held.distance_grid)
        near = store(self._near(held, picked).select("group_id", "doc_id", share.alias("distance")), "kmeans_near").frame
        costs = near.groupBy("group_id").agg(F.sum("distance").alias("cost"))
        places = picked.groupBy("group_id").agg(F.max("place").alias("last"))
        luck = hash_unit(F.concat(F.col("doc_id").cast("string"), F.lit(f":{self.seed}:{number}")))
        chosen = near.join(costs.join(places, "group_id"), "group_id").where(
            luck * F.col("cost") < F.lit(OVERSAMPLING * self.k) * F.col("distance")
        )
        place = F.col("last") + F.row_number().over(Window.partitionBy("group_id").orderBy("doc_id"))
        placed = chosen.select("group_id", "doc_id", place.cast("bigint").alias("place"))
        return held.points.select("group_id", "doc_id", "entries").join(placed, ["group_id", "doc_id"])

    def _parallel_start(self, held: "Prepared") -> DataFrame:
        """(group_id, cluster_id, center): about ``OVERSAMPLING * k`` points a round are drawn in each group; they meet in one task a group."""
        drawn = store(self.drawn(held), "kmeans_weighted").frame
        k, seed, width = self.k, self.seed, held.width

        def choose(table: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            matrix = np.zeros((table.num_rows, width))
            for row, entries in zip(matrix, table.column("entries").to_pylist()):
                row[[e["i"] for e in entries]] = [e["v"] for e in entries]
            group = table.column("group_id")[0]
            centers = weighted_kmeans(matrix, np.array(table.column("weight"), float), k, [seed, zlib.crc32(str(group.as_py()).encode())])
            return pa.table(
                {
                    "group_id": pa.array([group.as_py()] * len(centers), group.type),
                    "cluster_id": pa.array(range(len(centers)), pa.int64()),
                    "center": pa.array(centers.tolist(), pa.list_(pa.float64())),
                }
            )

        kind = drawn.schema["group_id"].dataType.simpleString()
        grouped = drawn.select("group_id", "place", "weight", "entries").groupBy("group_id")
        return grouped.applyInArrow(choose, f"group_id {kind}, cluster_id bigint, center array<double>")


def _matrices_of_centers(rows: list) -> dict:
    out: dict = {}
    for row in sorted(rows, key=lambda r: r["cluster_id"]):
        out.setdefault(row["group_id"], []).append(row["center"])
    return {g: np.array(m) for g, m in out.items()}


def weighted_kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: list[int]) -> np.ndarray:
    """k centers of weighted points: k-means++ draws, then rounds until nothing moves; fewer where fewer points differ."""
    different, back = np.unique(points, axis=0, return_inverse=True)
    if len(different) <= k:
        # In the order in which they were drawn.
        return points[np.sort(np.unique(back.ravel(), return_index=True)[1])]
    random = np.random.default_rng(seed)
    chosen = [int(random.choice(len(points), p=weights / weights.sum()))]
    distance = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        share = weights * distance
        chosen.append(int(random.choice(len(points), p=share / share.sum())))
        distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centers = points[chosen].copy()
    for _ in range(_LOCAL_ROUNDS):
        own = np.stack([((points - c) ** 2).sum(axis=1) for c in centers]).argmin(axis=0)
        moved = np.stack([np.average(points[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centers[c] for c in range(k)])
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers
