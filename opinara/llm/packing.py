"""Packing of documents into fixed-length sequences by bin completion.

Documents become token pieces of at most ``capacity``.  Pieces of the same
length are interchangeable, so the search works on the number of pieces of each
length: at most ``capacity`` numbers, however large the corpus.  Bin completion
takes the largest piece left and completes its bin by one of the undominated
fillings, the fullest first; a filling is applied to as many bins at once as
the counts allow.  The waste of a partial solution is bounded by that of the
best one known (best-fit decreasing to start with), and the search ends when
the number of bins meets the lower bound or the node budget is spent.

The chosen fillings say which ranks of each length go where.  Pieces get their
rank within their length by a numbering that is split over many groups, and
find their place by one lookup; texts and pieces are never gathered.

Defined cases: NULL counts as the empty text, whose only id is the end mark;
NULL or repeated ids are separate documents of their own; identical pieces are
interchangeable; an empty table gives no rows; columns other than the two named
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.columns import gather, whole
from opinara.sources.state import store

CAPACITY = 2048
#: The bound on chunks that a worker remembers.
REMEMBERED = 1_000_000
#: States that the search may visit before it settles for its best solution.
NODES = 6_000
#: Undominated fillings that are kept of those found for a bin.
FILLINGS = 4

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Places(dict):
    """Numbers chunks as they are met, and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        at = self[chunk] = len(self)
        self.new.append(chunk)
        return at


class ChunkEncoder:
    """Ids of a text by a public tokenizer, meeting each distinct chunk once.

    Chunks are what stands between ASCII white space.  The tokenizer drops white
    space, lets no token and no composition of characters reach across it, and
    so gives a text the ids of its chunks one after another.  A chunk of letters
    goes to the tokenizer's model directly, with a closing mark apart; any other
    chunk takes the tokenizer's whole way.
    """

    _BYTES = _byte_characters()
    #: Letters below this are alike in every version of Unicode that counts here.
    _PLAIN = "\u0530"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?"}
        self._forget()

    def _forget(self):
        self.place = _Places()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _ids_of_letters(self, chunk: bytes) -> list[int] | None:
        body, end = chunk.decode(), []
        if len(body) > 1 and body[-1] in self.marks:
            body, end = body[:-1], self.marks[body[-1]]
        if not body.isalpha():
            return None
        if body.isascii():
            spelled = body.lower()
        else:
            if max(body) >= self._PLAIN or not is_normalized("NFC", body):
                return None
            low = "".join([c.lower() for c in body])
            if not low.isalpha():
                return None
            spelled = "".join([self._BYTES[b] for b in low.encode()])
        return [t.id for t in self.model.tokenize(spelled)] + end

    def _learn(self, chunks: list[bytes]):
        found = [self._ids_of_letters(c) for c in chunks]
        others = [i for i, ids in enumerate(found) if ids is None]
        if others:
            encoded = self.tokenizer.encode_batch_fast([chunks[i].decode() for i in others], add_special_tokens=False)
            for i, one in zip(others, encoded):
                found[i] = one.ids
        lengths = np.array([len(ids) for ids in found], np.int64)
        flat = np.array([i for ids in found for i in ids], np.uint32)
        first = len(self.place) - len(chunks)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.place) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(chunks)] = lengths
        self.used += len(flat)

    def encode(self, text: str) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        places = np.array([place[c] for c in text.encode().split()], np.int64)
        if place.new:
            self._learn(place.new)
            place.new = []
        return gather(self.flat, self.starts[places], self.lengths[places])


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Each document's ids and the end mark, cut into pieces of ``capacity``; the last may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode(value.as_py()), end).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, n, start, len(part), crc32(part.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(cut, _PIECES)


@dataclass
class Pattern:
    """``copies`` bins, each filled with ``items``, pairs of a length and how often it occurs."""

    items: list[tuple[int, int]]
    copies: int


def _largest_below(counts: np.ndarray) -> np.ndarray:
    """For each room, the largest length present that fits it; 0 if none."""
    lengths = np.where(counts > 0, np.arange(len(counts)), 0)
    return np.maximum.accumulate(lengths)


def _best_pairs(counts: np.ndarray, below: np.ndarray, room: int, keep: int) -> list[tuple[int, ...]]:
    """For every first piece the largest second that fits, the fullest pairs first; of equal ones that with the largest piece."""
    first = np.flatnonzero(counts[: room + 1])[::-1]
    second = below[room - first]
    short = (second == first) & (counts[first] < 2)
    second = np.where(short, below[np.minimum(room - first, first - 1)], second)
    first, second = first[second <= first], second[second <= first]
    order = np.argsort(-(first + second), kind="stable")[:keep]
    return [(int(a), int(b)) if b else (int(a),) for a, b in zip(first[order], second[order])]


def fillings(counts: np.ndarray, room: int, keep: int = FILLINGS, branch: int = 2) -> list[tuple[int, ...]]:
    """Complete fillings of ``room`` from the pieces present, fullest first, without dominated ones.

    A filling is dominated when another one has a single piece where it has
    several of no greater sum: one piece that fills the room dominates all
    others, and of equally full fillings the one with fewer, larger pieces comes
    first.  A filling to which a piece could be added is not complete.
    """
    below = _largest_below(counts)
    most = int(below[room])
    if not most:
        return [()]
    if most == room:
        return [(room,)]
    found: list[tuple[int, ...]] = []
    # Far more room than the largest piece takes: such pieces come first, as often as two more must fit.
    if room > 3 * most:
        n = min(int(counts[most]), room // most - 2)
        rest = counts.copy()
        rest[most] -= n
        return [(most,) * n + f for f in fillings(rest, room - n * most, keep, branch)]
    for pair in _best_pairs(counts, below, room, keep):
        left = room - sum(pair)
        if not left or not below[left]:
            found.append(pair)
            continue
        rest = counts.copy()
        for piece in pair:
            rest[piece] -= 1
        more = fillings(rest, left, keep if branch else 1, branch - 1) if branch else [_fullest(rest, left)]
        found += [pair + f for f in more]
    unique = dict.fromkeys(tuple(sorted(f, reverse=True)) for f in found)
    return sorted(unique, key=lambda f: (-sum(f), len(f), [-x for x in f]))[:keep]


def _fullest(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """Always the largest piece that fits."""
    left, chosen = counts.copy(), []
    while most := int(_largest_below(left[: room + 1])[-1]):
        chosen.append(most)
        left[most] -= 1
        room -= most
    return tuple(chosen)


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the largest piece left, then always the largest that fits."""
    left, out = counts.copy(), []
    while left.any():
        items: dict[int, int] = {}
        room = capacity
        used = left.copy()
        while (most := int(_largest_below(used[: room + 1])[-1])):
            n = min(int(used[most]), room // most)
            items[most] = n
            used[most] -= n
            room -= most * n
        copies = min(int(left[k]) // n for k, n in items.items())
        for k, n in items.items():
            left[k] -= n * copies
        out.append(Pattern(sorted(items.items(), reverse=True), copies))
    return out


def bins(patterns: list[Pattern]) -> int:
    return sum(p.copies for p in patterns)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound: pieces too large to share, and the waste they force."""
    lengths = np.arange(len(counts))
    best = -(-int((counts * lengths).sum()) // capacity)
    for small in range(0, capacity // 2 + 1):
        large = counts[lengths > capacity - small].sum()
        middle = (lengths > capacity / 2) & (lengths <= capacity - small)
        low = (lengths >= max(small, 1)) & (lengths <= capacity / 2)
        n = int(counts[middle].sum())
        spare = n * capacity - int((counts * lengths)[middle].sum())
        need = int((counts * lengths)[low].sum()) - spare
        best = max(best, int(large) + n + max(0, -(-need // capacity)))
    return best


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Branch and bound over fillings; ``counts[n]`` pieces have length n."""
    counts = counts.astype(np.int64)
    best = best_fit(counts, capacity)
    least = lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    # Siblings share the counts they start from, so memory follows the depth of the search alone.
    stack: list[tuple] = [(counts, None, (), 0)]  # counts before the pattern, pattern, patterns before it (linked), waste
    while stack and nodes and bins(best) > least:
        nodes -= 1
        before, pattern, path, waste = stack.pop()
        # A better solution has one bin less at most, so no more waste than this.
        allowed = (bins(best) - 1) * capacity - total
        if waste > allowed:
            continue
        left = before
        if pattern:
            left, path = before.copy(), (path, pattern)
            for length, n in pattern.items:
                left[length] -= n * pattern.copies
        if not left.any():
            best = []
            while path:
                best.append(path[1])
                path = path[0]
            best.reverse()
            continue
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        options = []
        for filling in fillings(rest, capacity - largest):
            items, n = np.unique(np.array((largest, *filling), int), return_counts=True)
            copies = int((left[items] // n).min())
            lost = capacity - int((items * n).sum())
            if lost:
                copies = min(copies, max(1, (allowed - waste) // lost))
            if waste + lost * copies <= allowed:
                made = Pattern(sorted(zip(items.tolist(), n.tolist()), reverse=True), copies)
                options.append((left, made, path, waste + lost * copies))
        stack += reversed(options)  # the fullest filling is tried first
    return best


@dataclass
class Places:
    """Where the r-th piece of each length goes, as runs of ranks."""

    keys: np.ndarray
    repeats: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray

    _SHIFT = 40

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Places:
        runs, next_rank, sequence = [], {}, 0
        for pattern in patterns:
            offset = 0
            for length, n in pattern.items:
                rank = next_rank.get(length, 0)
                runs.append(((length << cls._SHIFT) + rank, n, sequence, offset))
                next_rank[length] = rank + n * pattern.copies
                offset += length * n
            sequence += pattern.copies
        runs.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*runs) if runs else ((), (), (), ()))))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length << self._SHIFT) + rank
        run = np.searchsorted(self.keys, wanted, side="right") - 1
        copy, slot = np.divmod(wanted - self.keys[run], self.repeats[run])
        return self.sequences[run] + copy, self.offsets[run] + slot * length


def ranked(found: DataFrame, key: str, order: list[str], groups: int) -> DataFrame:
    """``rank`` from 0 within ``key``, numbered in ``groups`` parts by a hash so that no key is one task's."""
    parts = found.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = parts.groupBy(key, "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy(key, "part").orderBy(*order)
    numbered = parts.withColumn("rank", F.row_number().over(inner) - 1)
    return numbered.join(starts, [key, "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    found = store(pieces(docs, path, id, text, capacity), "pieces").frame
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row per length
        counts[row["length"]] = row["n"]
    places = Places.of(complete_bins(counts, capacity, nodes))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked(found, "length", ["doc_id", "piece", "ids_crc32"], groups).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return rows.mapInArrow(place, f"{_PIECES}, sequence_id bigint, offset bigint")
