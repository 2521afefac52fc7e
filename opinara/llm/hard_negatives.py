"""Hard negatives for embeddings, by coordinate pruning within length buckets.

A search asks for the rows of the highest inner product with each anchor, above
a threshold that rises as rows are found.  All rows are dealt into slots by a
hash of their id, so a slot has a bounded number of rows whatever the labels;
every anchor goes to every slot, where a task holds the slot's index and streams
the anchors past it.  The index of a slot is one of length buckets: its vectors
by falling length, cut where the length or the number of rows calls for it, and
for every coordinate of a bucket the list of its (normalised) values, sorted.

An anchor of length a meets a bucket of greatest length b only while a * b can
reach the threshold.  There the threshold is an angle t; a vector within t of
the anchor has, at a coordinate whose axis is at angle f to the anchor, a value
between cos(f + t) and cos(f - t).  These feasible ranges of the anchor's focus
coordinates, its largest ones, are cut out of the sorted lists; rows in all of
them are candidates and their integer inner products are computed exactly.  The
ranges are widened by more than rounding can err, so nothing is lost.

``positives`` searches the rows of the anchor's label, ``negatives`` the others,
within bounds that each positive's score sets.  Of each slot only the best rows
of an anchor leave it; ranking them is the only other shuffle.

Defined cases: rows with a NULL id, label or vector, or with a NULL or
non-finite component, take no part (a table without usable rows gives none);
vectors of different lengths are filled up with zeros; rows that repeat an id
count once, with the least (label, vector); ties go to the smaller id; other
columns are ignored, whatever their names.  Inner products have to fit 63 bits,
or the rounding raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.sources.state import store

#: Components of a slot; rows of a bucket, and least ratio of lengths within one.
SLOT_CELLS, BUCKET_ROWS, BUCKET_RATIO = 1 << 20, 2048, 0.85
#: Coordinates of an anchor whose feasible ranges are intersected.
FOCUS = 4
#: Wider than the rounding of angles and values.
SLIP = 1e-6
#: Whole numbers up to this are exact as doubles.
_EXACT = 1 << 53


@dataclass
class Vectors:
    """Rounded rows ``vec_id``, ``label``, ``vector`` (of ``width`` whole numbers) in ``slots`` slots."""

    frame: DataFrame
    width: int
    largest: int
    slots: int

    @property
    def dtype(self) -> type:
        """Doubles where every sum is exact in them, whole numbers elsewhere."""
        return np.float64 if self.width * self.largest**2 < _EXACT else np.int64


def rounded(rows: DataFrame, label: Column, scale: float = 256.0) -> Vectors:
    """The usable rows of (vec_id, embedding, label) with components floor(scale * x); written once."""
    vector = F.col("embedding").cast("array<double>")
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("given")).filter(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("given").isNotNull()
        & F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # A double beyond the range of long would be cut to it, so it is looked at before.
    whole = F.transform("given", lambda x: F.floor(x * scale))
    most = F.array_max(F.transform("given", lambda x: F.abs(x * scale)))
    least = usable.select("vec_id", F.struct("label", whole.alias("vector"), most.alias("most")).alias("row"))
    kept = store(least.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*"), "rounded_vectors").frame
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max("most").alias("most")).first()
    width, largest = size["width"] or 0, (size["most"] or 0.0) + 1
    if width * largest * largest >= 2.0**63:
        raise ValueError("inner products of these components do not fit 63 bits")
    slots = max(1, math.ceil(size["n"] * max(width, 1) / SLOT_CELLS))
    return Vectors(kept.drop("most"), width, int(largest), slots)


def _matrix(column: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((len(column), width), dtype)
    lengths = np.diff(column.offsets.to_numpy())
    inside = np.arange(width) < lengths[:, None]
    out[inside] = column.flatten().to_numpy()
    return out


class Bucket:
    """Rows of similar length, and the sorted list of each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.rows, self.longest = ids, labels, rows, float(lengths[0])
        unit = rows / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0).astype(np.int32).T.copy()
        self.values = np.take_along_axis(unit, self.order.T, 0).T.copy()
        self.zeros = lengths[-1] == 0

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates are all feasible for vectors within this cosine; None for all rows."""
        if self.zeros or cosine <= -1:
            return None
        reach = math.acos(min(1.0, cosine))
        met, lists = np.zeros(len(self.ids), np.int8), 0
        for f in focus:
            angle = math.acos(max(-1.0, min(1.0, unit[f])))
            low = math.cos(min(math.pi, angle + reach)) - SLIP
            high = math.cos(max(0.0, angle - reach)) + SLIP
            begin, end = np.searchsorted(self.values[f], (low, high))
            if end - begin < len(self.ids):
                met[self.order[f, begin:end]] += 1
                lists += 1
        return np.flatnonzero(met == lists) if lists else None


def buckets_of(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[Bucket]:
    """All rows by falling length, cut into buckets."""
    lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, labels, rows, lengths = ids[order], labels[order], rows[order], lengths[order]
    out, begin = [], 0
    while begin < len(ids):
        # Lengths fall, so the rows of the bucket are those before the first that is too short.
        short = int(np.searchsorted(-lengths, -lengths[begin] * BUCKET_RATIO, side="right"))
        end = min(begin + BUCKET_ROWS, max(short, begin + 1))
        out.append(Bucket(*(a[begin:end] for a in (ids, labels, rows, lengths))))
        begin = end
    return out


def best_rows(
    buckets: list[Bucket], anchor: np.ndarray, least: Callable[[], float], take: Callable[[np.ndarray, np.ndarray, np.ndarray], None]
) -> None:
    """Hand to ``take`` (ids, labels, scores) of all rows that can reach the threshold ``least()``, which may rise."""
    length = math.sqrt(float((anchor.astype(np.float64) ** 2).sum()))
    unit = anchor / length if length else anchor.astype(np.float64)
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    for bucket in buckets:
        threshold, product = least(), length * bucket.longest
        if product + SLIP * max(product, 1) < threshold:
            if threshold > 0:
                return  # the buckets to come are shorter still
            continue
        found = None
        if product and threshold != -math.inf:
            # The shortest row of the bucket has the widest angle where the threshold is not above zero.
            cosine = threshold / product if threshold > 0 else -1.0
            found = bucket.candidates(unit, focus, cosine - SLIP)
        if found is None:
            take(bucket.ids, bucket.labels, bucket.rows @ anchor)
        elif len(found):
            take(bucket.ids[found], bucket.labels[found], bucket.rows[found] @ anchor)


def _merge(kept: tuple, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple:
    ids, scores = np.concatenate([kept[0], ids]), np.concatenate([kept[1], scores])
    if len(ids) > most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        ids, scores = ids[scores >= edge], scores[scores >= edge]
    order = np.lexsort((ids, -scores))[:most]
    return ids[order], scores[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0))


def _search(vectors: Vectors, anchors: DataFrame, search: Callable, schema: str) -> DataFrame:
    """Run ``search(slot, anchor row)`` over every slot for every anchor.

    ``anchors``: vec_id, label, vector, ``asked`` (what the search needs to know).  A slot's rows come
    first and stay in the task, at most about ``SLOT_CELLS`` components; the anchors pass by.
    """
    width, dtype, slots = vectors.width, vectors.dtype, vectors.slots
    rows = vectors.frame.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"),
        F.lit(0).alias("kind"),
        "vec_id",
        "label",
        "vector",
        F.lit(None).cast("array<bigint>").alias("asked"),
    )
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), "vec_id", "label", "vector", "asked")
    dealt = rows.unionByName(asking).repartition("slot").sortWithinPartitions("slot", "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index, out = None, [], None, []

        def answer() -> pa.RecordBatch:
            columns = [np.concatenate([part[i] for part in out]).astype(np.int64) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            slot, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, labels = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            matrix = _matrix(batch.column(4), width, dtype)
            # Runs of one slot and kind.
            cuts = np.flatnonzero((np.diff(slot) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(slot)]):
                if slot[begin] != current:
                    current, held, index = slot[begin], [], None
                if kind[begin] == 0:
                    held.append((ids[begin:end], labels[begin:end], matrix[begin:end]))
                    continue
                if index is None:
                    index = search.index(held)
                    held = []
                asked = batch.column(5)
                for i in range(begin, end):
                    found = search(index, int(ids[i]), int(labels[i]), matrix[i], asked[i].as_py())
                    if found and len(found[0]):
                        out.append(found)
            if out:
                yield answer()
                out = []

    return dealt.mapInArrow(run, schema)


def _whole(held: list) -> tuple:
    return tuple(np.concatenate([part[i] for part in held]) for i in range(3)) if held else ()


class _Positives:
    def __init__(self, most: int):
        self.most = most

    def index(self, held: list) -> dict[int, list[Bucket]]:
        """Buckets by label."""
        if not held:
            return {}
        ids, labels, rows = _whole(held)
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        return {int(labels[part[0]]): buckets_of(ids[part], labels[part], rows[part]) for part in np.split(order, cuts)}

    def __call__(self, index: dict, anchor_id: int, label: int, anchor: np.ndarray, asked: list) -> tuple:
        kept = _NONE

        def take(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
            nonlocal kept
            other = ids != anchor_id
            kept = _merge(kept, ids[other], scores[other], self.most)

        best_rows(index.get(label, []), anchor, lambda: kept[1][-1] if len(kept[0]) == self.most else -math.inf, take)
        return np.full(len(kept[0]), anchor_id), *kept


def positives(vectors: Vectors, anchors: DataFrame, most: int = 5) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``positive_score``: the best other rows of each anchor's label."""
    near = _search(
        vectors,
        anchors.withColumn("asked", F.lit(None).cast("array<bigint>")),
        _Positives(most),
        "anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


class _Negatives:
    def __init__(self, most: int, low: int, high: int):
        self.most, self.low, self.high = most, low, high

    def index(self, held: list) -> list[Bucket]:
        return buckets_of(*_whole(held)) if held else []

    def __call__(self, index: list, anchor_id: int, label: int, anchor: np.ndarray, asked: list) -> tuple:
        """``asked``: the scores of the anchor's positives, each once."""
        bounds = [(-(-self.low * p // 100), self.high * p // 100) for p in asked]
        kept = [_NONE for _ in asked]

        def least() -> float:
            floors = [max(low, k[1][-1]) if len(k[0]) == self.most else low for (low, high), k in zip(bounds, kept) if low <= high]
            return min(floors, default=math.inf)

        def take(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
            other = labels != label
            ids, scores = ids[other], scores[other]
            for i, (low, high) in enumerate(bounds):
                fit = (scores >= low) & (scores <= high)
                if fit.any():
                    kept[i] = _merge(kept[i], ids[fit], scores[fit], self.most)

        best_rows(index, anchor, least, take)
        sizes = [len(k[0]) for k in kept]
        return (
            np.full(sum(sizes), anchor_id),
            np.repeat(np.array(asked, np.int64), sizes),
            np.concatenate([k[0] for k in kept]),
            np.concatenate([k[1] for k in kept]),
        )


def negatives(vectors: Vectors, anchors: DataFrame, found: DataFrame, most: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and positive of ``found``: its ``rank``, ``negative_id`` and ``negative_score`` among the rows of other labels.

    A negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    scores = found.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))
    asking = anchors.join(scores, anchors["vec_id"] == scores["anchor_id"]).select("vec_id", "label", "vector", "asked")
    near = _search(
        vectors,
        asking,
        _Negatives(most, low, high),
        "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return found.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def mine(vectors: Vectors, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows that the condition ``anchor`` picks; their positives are written in between."""
    anchors = vectors.frame.filter(anchor)
    found = store(positives(vectors, anchors, n_positives), "positives").frame
    return negatives(vectors, anchors, found, n_negatives, low, high)
