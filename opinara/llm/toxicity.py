"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: its lower-cased words and their
beginnings (which catch inflected forms).  The machine adds a weight for each
term and the product of two short vectors for each *pair* of terms, so that a
term can count for more beside another one than alone.

Fitting works on a bounded sample of labelled rows (``max_rows`` of each
class, by a hash of the id, so the same rows are drawn wherever they lie), in
two steps.  A first machine over *all* words of the sample, with a penalty that
takes the whole vector of a word to zero, finds the words that tell something
beside another word, though they may tell nothing alone; counts of such pairs
have to confirm it.  The second machine is fitted to these words and to the
terms that tell the classes apart by themselves (as many as there are, at a
stated rate of false ones).  Everything else a document contains is no feature,
which leaves scores free of a text's length.  The driver holds the sample's
terms that occur in ``LEAST_ROWS`` toxic rows, and their places in each row.
Scoring runs over whole texts, with no shuffle.

Defined cases: NULL counts as the empty text and gets the score of a text with
no selected term; label rows with a NULL are left out, repeated label rows
count as often as they occur; with no label rows of both classes the score is
the share of toxic rows seen (0 without any); an empty table gives no rows;
labels, language, source and id are no inputs of a score; columns other than
the two that are named are ignored, whatever their names; long texts are read
whole, and a term counts once however often it occurs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import drawn, gather, whole
from opinara.sources.state import store

#: Size of the hash space of terms, in bits.
HASH_BITS = 32
#: Lengths of the word beginnings that are terms.
PREFIXES = (3, 4, 5, 6, 7)
#: Labelled rows of each class that are fitted to, at most.
MAX_ROWS = 10_000
FACTORS = 8
#: Toxic rows in which a term has to occur; fewer are chance among so many terms.
LEAST_ROWS = 5
#: Share of false ones among the terms that tell something alone.
FALSE_SHARE = 0.05
#: Deviations by which the classes differ in a pair of words, and by how many more than in either word.
PAIR_DEVIATIONS, MORE_THAN_ALONE = 6.0, 1.0
#: The bound on words that a worker remembers.
REMEMBERED = 1_000_000

_WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_terms(word: str) -> list[int]:
    """Hashes of the terms of a word."""
    from xxhash import xxh64_intdigest

    names = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [xxh64_intdigest(name) & ((1 << HASH_BITS) - 1) for name in names]


class TermIndex:
    """Selected terms by their hash, with a bounded memory of words met."""

    def __init__(self, terms: list[int]):
        self.places = {term: i for i, term in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> list[int]:
        """Places of the selected terms in a text, ascending, each once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, set()
        for word in words(text):
            places = known.get(word)
            if places is None:
                places = known[word] = tuple(self.places[t] for t in word_terms(word) if t in self.places)
            if places:
                found.update(places)
        return sorted(found)


@dataclass
class FactorizationMachine:
    """Bias, weights and factors of the selected terms."""

    terms: list[int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    _index: TermIndex | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "bias": self.bias, "weights": self.weights, "factors": self.factors, "_index": None}

    def score_text(self, text: str | None) -> float:
        if self._index is None:
            self._index = TermIndex(self.terms)
        places = self._index.of(text or "")
        v = self.factors[places]
        pairs = (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[places].sum() + pairs, -30, 30))))

    def score(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score_text(t) for t in texts], dtype="float64")

        return score(text)


class Rows:
    """A 0/1 matrix by its ones: the places of each row, ascending."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, width: int):
        self.lengths, self.places, self.width = lengths, places, width
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.by_place = np.argsort(places, kind="stable")
        self.used, self.used_starts = np.unique(places[self.by_place], return_index=True)

    @classmethod
    def of(cls, matrix: np.ndarray) -> "Rows":
        return cls((matrix != 0).sum(axis=1), np.nonzero(matrix)[1], matrix.shape[1])

    def take(self, rows: np.ndarray) -> "Rows":
        return Rows(self.lengths[rows], gather(self.places, self.starts[rows], self.lengths[rows]), self.width)

    def columns(self, chosen: np.ndarray) -> "Rows":
        """The matrix of the chosen columns, in their order."""
        new = np.full(self.width, -1)
        new[chosen] = np.arange(len(chosen))
        places = new[self.places]
        kept = places >= 0
        row, places = self.row[kept], places[kept]
        order = np.lexsort((places, row))
        return Rows(np.bincount(row, minlength=len(self.lengths)), places[order], len(chosen))

    def dense(self) -> np.ndarray:
        matrix = np.zeros((len(self.lengths), self.width), np.float32)
        matrix[self.row, self.places] = 1
        return matrix

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of a value for each place."""
        out = np.zeros((len(self.lengths), *values.shape[1:]))
        filled = self.lengths > 0
        if len(self.places):
            out[filled] = np.add.reduceat(values[self.places], self.starts[filled])
        return out

    def logits(self, b: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the machine, and the sum of each row's vectors."""
        total = self.sums(v)
        return b + self.sums(w) + ((total**2).sum(axis=1) - self.sums((v**2).sum(axis=1))) / 2, total

    def gradients(self, error: np.ndarray, total: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights and vectors of the used places."""
        if not len(self.places):
            return np.zeros(0), np.zeros((0, v.shape[1]))
        row, place = self.row[self.by_place], self.places[self.by_place]
        by_one = error[row]
        by_pair = by_one[:, None] * (total[row] - v[place])
        return np.add.reduceat(by_one, self.used_starts), np.add.reduceat(by_pair, self.used_starts)


def _sigmoid(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _batches(rows: Rows, random: np.random.Generator, most_rows: int = 256, most_places: int = 1 << 18) -> list[np.ndarray]:
    """All rows in random order, cut into batches; a row of more places is a batch of its own."""
    batches, batch, places = [], [], 0
    for row in random.permutation(len(rows.lengths)):
        if batch and (len(batch) == most_rows or places + rows.lengths[row] > most_places):
            batches.append(np.array(batch))
            batch, places = [], 0
        batch.append(row)
        places += rows.lengths[row]
    return batches + ([np.array(batch)] if batch else [])


def train(x: np.ndarray | Rows, y: np.ndarray, weight: np.ndarray, rounds: int = 1000, rate: float = 0.05, seed: int = 7):
    """Bias, weights and factors by Adam on the weighted logistic loss with a quadratic penalty.

    Each round takes the next of the batches; its step falls to a twentieth in the course of the rounds.
    """
    rows = x if isinstance(x, Rows) else Rows.of(x)
    random = np.random.default_rng(seed)
    weight = weight / weight.mean()
    params = [np.zeros(1), np.zeros(rows.width), random.normal(0, 0.05, (rows.width, FACTORS))]
    penalty = [0.0, 1e-5, 1e-4]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batches = [(r, rows.take(r)) for r in _batches(rows, random, most_rows=512)]
    for step in range(1, rounds + 1):
        chosen, part = batches[step % len(batches)]
        logit, total = part.logits(*params)
        error = weight[chosen] * (_sigmoid(logit) - y[chosen]) / len(chosen)
        grads = [error.sum(keepdims=True), np.zeros(rows.width), np.zeros((rows.width, FACTORS))]
        grads[1][part.used], grads[2][part.used] = part.gradients(error, total, params[2])
        now = rate * max(1 - step / rounds, 0.05)
        for i, grad in enumerate(grads):
            grad = grad + penalty[i] * params[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] = params[i] - now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    return float(params[0][0]), params[1], params[2]


def paired(rows: Rows, y: np.ndarray, weight: np.ndarray, epochs: int = 30, rate: float = 0.1, seed: int = 7) -> np.ndarray:
    """Places whose vector a machine keeps under a penalty on its length: those that matter beside others.

    Steps are scaled by each place's past gradients; the penalties are set to
    zero what does not lower the loss by more than they cost.  Vectors grow
    from chance values, so their penalty begins after a few rounds.
    """
    on_weight, on_vector, free_epochs = 0.002, 0.01, 3
    random = np.random.default_rng(seed)
    b, w, v = 0.0, np.zeros(rows.width), random.normal(0, 0.02, (rows.width, FACTORS))
    past_b, past_w, past_v = 1e-6, np.full(rows.width, 1e-6), np.full(rows.width, 1e-6)
    weight = weight / weight.mean()
    batches = [(r, rows.take(r)) for r in _batches(rows, random)]
    for epoch in range(epochs):
        for chosen, part in batches:
            logit, total = part.logits(b, w, v)
            error = weight[chosen] * (_sigmoid(logit) - y[chosen]) / len(chosen)
            used, (by_w, by_v) = part.used, part.gradients(error, total, v)
            past_b += error.sum() ** 2
            past_w[used] += by_w**2
            past_v[used] += (by_v**2).mean(axis=1)
            b -= rate * error.sum() / math.sqrt(past_b)
            step = rate / np.sqrt(past_w[used])
            moved = w[used] - step * by_w
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * on_weight, 0)
            step = (rate / np.sqrt(past_v[used]))[:, None]
            moved = v[used] - step * by_v
            if epoch >= free_epochs:
                length = np.sqrt((moved**2).sum(axis=1, keepdims=True))
                moved *= np.maximum(1 - step * on_vector / np.maximum(length, 1e-12), 0)
            v[used] = moved
    return np.nonzero((v != 0).any(axis=1))[0]


def deviations(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """By how many deviations the shares of the classes' rows differ."""
    pooled = (in_toxic + in_clean) / (toxic + clean)
    return (in_toxic / toxic - in_clean / clean) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / toxic + 1 / clean))


def telling(z: np.ndarray, false_share: float = FALSE_SHARE) -> np.ndarray:
    """Which deviations are more than chance, with this share of false ones expected among them."""
    chance = np.array([math.erfc(abs(value) / math.sqrt(2)) for value in z])
    ordered = np.sort(chance)
    fit = np.nonzero(ordered <= false_share * np.arange(1, len(z) + 1) / max(len(z), 1))[0]
    return chance <= (ordered[fit[-1]] if len(fit) else -1.0)


def confirmed(rows: Rows, y: np.ndarray, places: np.ndarray, z: np.ndarray, block: int = 1024) -> np.ndarray:
    """Those of the places that are in a pair whose counts tell clearly more than either place alone."""
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    kept: set[int] = set()
    for i in range(0, len(places), block):
        one = rows.columns(places[i : i + block]).dense()
        for j in range(i, len(places), block):
            other = one if i == j else rows.columns(places[j : j + block]).dense()
            in_toxic, in_all = one[y == 1].T @ other[y == 1], one.T @ other
            left, right = np.nonzero(in_all >= 2 * LEAST_ROWS)
            left, right = left[left + i < right + j], right[left + i < right + j]
            both = in_toxic[left, right].astype(float)
            pair = np.abs(deviations(both, in_all[left, right] - both, toxic, clean))
            left, right = places[left + i], places[right + j]
            alone = np.maximum(np.abs(z[left]), np.abs(z[right]))
            clear = (pair >= PAIR_DEVIATIONS) & (pair > alone + MORE_THAN_ALONE)
            kept.update(left[clear].tolist(), right[clear].tolist())
    return np.array(sorted(kept), dtype=int)


def in_training(id: Column) -> Column:
    """Rows whose label may be learned from; false for a NULL id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts of each class; small enough to be met without moving the texts."""
    usable = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & in_training(F.col("key"))
    )
    counted = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (drawn(usable.filter(F.col("toxic") == y), ["key"], max_rows, counted.get(y, 0)) for y in (1, 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), whole("text").alias("text"))
    return texts.join(F.broadcast(toxic.unionAll(clean)), "key").select("text", "toxic")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term: whether it is a whole word, rows of each class, and the sum of a mark of these rows.

    Terms of the same rows have the same sum of marks.
    """
    from xxhash import xxh64_intdigest

    counts: dict[int, list] = defaultdict(lambda: [False, 0, 0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mark = xxh64_intdigest(text) >> 24
            found: dict[int, bool] = {}
            for word in words(text):
                first, *beginnings = word_terms(word)
                found[first] = True
                for term in beginnings:
                    found.setdefault(term, False)
            for term, whole_word in found.items():
                count = counts[term]
                count[0] |= whole_word
                count[2 - toxic] += 1
                count[3] += mark
    terms = list(counts)
    columns = list(zip(*counts.values())) or [()] * 4
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(terms, pa.int64()), *(pa.array(column, kind) for column, kind in zip(columns, kinds))]
    yield pa.RecordBatch.from_arrays(arrays, ["term", "word", "toxic", "clean", "marks"])


def _places(terms: list[int]):
    index = TermIndex(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [index.of(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), batch.column(1)], ["places", "toxic"])

    return find


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit to the labelled documents that may be learned from."""
    sample = store(_sample(docs, labels, max_rows), "toxicity_sample")
    texts = sample.frame
    seen = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = seen.get(0, 0), seen.get(1, 0)
    if not clean or not toxic:
        sample.drop()
        share = toxic / max(clean + toxic, 1)
        bias = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
        return FactorizationMachine([], bias, np.zeros(0), np.zeros((0, FACTORS)))
    counted = (
        texts.mapInArrow(_count_terms, "term bigint, word boolean, toxic bigint, clean bigint, marks bigint")
        .groupBy("term")
        .agg(F.max("word").alias("word"), *[F.sum(c).alias(c) for c in ("toxic", "clean", "marks")])
        .filter(F.col("toxic") >= LEAST_ROWS)
        .orderBy("term")
        .toArrow()
    )
    terms, is_word, in_toxic, in_clean, marks = (counted.column(i).to_numpy() for i in range(5))
    z = deviations(in_toxic, in_clean, toxic, clean)
    # A word and its beginnings that occur in the same rows say the same thing; one of them is enough.
    _, kinds = np.unique(np.stack([marks, in_toxic, in_clean]), axis=1, return_index=True)
    alone = kinds[telling(z[kinds])]
    met = np.union1d(alone, np.nonzero(is_word)[0])
    found = texts.mapInArrow(_places(terms[met].tolist()), "places array<int>, toxic int").orderBy("places", "toxic").toArrow()
    sample.drop()
    places = found.column("places").combine_chunks()
    rows = Rows(places.value_lengths().to_numpy().astype(int), places.flatten().to_numpy().astype(int), len(met))
    y = found.column("toxic").to_numpy().astype(float)
    # Half way to equal classes: one telling term is then enough where nothing speaks against it.
    weight = np.where(y == 1, np.sqrt(clean / toxic), 1.0)
    own = np.nonzero(is_word[met])[0]
    pairs = confirmed(rows, y, own[paired(rows.columns(own), y, weight)], z[met])
    chosen = np.union1d(np.searchsorted(met, alone), pairs).astype(int)
    bias, weights, factors = train(rows.columns(chosen), y, weight)
    return FactorizationMachine(terms[met[chosen]].tolist(), bias, weights, factors)
