"""Licence scan: a trained paragraph classifier whose findings are compared with templates.

A paragraph is a run of lines that hold a word; a line of comment marks alone
ends it like an empty one, and the marks before a line's words are no words.
Each of its lines is looked at by itself first.  The lines in which no notice
is confirmed are then joined again, so that a notice wrapped over lines is one
sequence of words.  The stretches of a sequence that share word pairs with
templates are classified, and what is left of a stretch beside a confirmed
notice once more.

A piece is the set of its hashed word pairs and triples, as far as they occur
in a template.  A multinomial logistic regression over them, with a class for
everything unknown, is fitted to templates, to variations of them and to a
bounded sample of the corpus' own lines; its probabilities are calibrated by
temperature on variations held out.  A family is found when its probability
passes a threshold, and confirmed when so many words in a row as one of its
templates has (and a quarter more) hold nearly all of that template, and no
other family's template is held by a larger share.

Every paragraph of every text is classified where it lies; nothing is shuffled.
A piece with no such pair has the bias alone, which says unknown, so its
scores need no arithmetic.

Defined cases: NULL counts as the empty text, which has no licence; NULL or
repeated ids are carried along, one output row per input row; an empty table
gives no rows, and none to sample from; columns other than the two named are
ignored; a very long text is read whole, in time that grows with its length;
of two families held by equal shares the classifier's stays.  A finding is
numbered by the line (from 0) in which its words begin.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import drawn, whole

UNKNOWN = "unknown"
#: Notices by licence family.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD 3-Clause License.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.",),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.",),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.",),
    "cc0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Families as identifier lines write them.
IDENTIFIERS: Mapping[str, str] = {
    "apache-2.0": "Apache-2.0",
    "mit": "MIT",
    "gpl-3.0": "GPL-3.0",
    "gpl-2.0": "GPL-2.0",
    "lgpl-2.1": "LGPL-2.1",
    "bsd-3-clause": "BSD-3-Clause",
    "mpl-2.0": "MPL-2.0",
    "cc-by-4.0": "CC-BY-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc0-1.0": "CC0-1.0",
}
HASH_BITS = 22
#: Corpus paragraphs that the unknown class is fitted to, at most.
UNKNOWN_ROWS = 5_000
PROBABILITY, COVERED = 0.5, 0.8
#: Words without a template's pair that end a stretch of a joined paragraph.
GAP = 12
#: Words of the longest stretch that is classified in one piece.
LONGEST = 512

_WORD = re.compile(r"\w+(?:\.\d+)*")


def paragraph_words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _edges(words: list[str]) -> list[str]:
    return ["^", *words, "$"]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Pairs and triples of words, with the ends of the paragraph as words of their own."""
    w = _edges(words)
    return {*zip(w, w[1:]), *zip(w, w[1:], w[2:])}


def gram_hash(gram: tuple[str, ...]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest("\x1f".join(gram)) & ((1 << HASH_BITS) - 1)


def held(words: list[str], template: list[str]) -> tuple[float, int, int]:
    """The largest share of a template's word pairs in as many words in a row, and where these begin and end."""
    wanted, width = set(zip(template, template[1:])), len(template) + len(template) // 4
    hits = [(i, pair) for i, pair in enumerate(zip(words, words[1:])) if pair in wanted]
    inside: Counter = Counter()
    most, begin, end, first = 0, 0, 0, 0
    for at, pair in hits:
        inside[pair] += 1
        while at + 2 - hits[first][0] > width:
            left = hits[first][1]
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
            first += 1
        if len(inside) > most:
            most, begin, end = len(inside), hits[first][0], at + 2
    return most / max(len(wanted), 1), begin, end


def coverage(words: list[str], template: list[str]) -> float:
    return held(words, template)[0]


def all_templates() -> dict[str, list[str]]:
    """Notices and identifier lines by family."""
    lines = {name: [f"SPDX-License-Identifier: {written}"] for name, written in IDENTIFIERS.items()}
    return {name: [*texts, *lines.get(name, [])] for name, texts in TEMPLATES.items()}


@dataclass
class ParagraphClassifier:
    classes: list[str]
    pairs: frozenset
    places: dict[int, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[list[str]]]

    def features(self, words: list[str]) -> list[int]:
        found = {self.places.get(gram_hash(g)) for g in grams(words)}
        return sorted(p for p in found if p is not None)

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = self.features(words)
        logits = self.bias.copy()
        if at:
            logits += self.weights[at].sum(axis=0) / np.sqrt(len(at))
        logits = logits / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def classify_words(self, words: list[str]) -> "Piece":
        if self.pairs.isdisjoint(zip(words, words[1:])):
            return Piece(UNKNOWN, 1.0)
        p = self.probabilities(words)
        best = int(p.argmax())
        name = self.classes[best]
        if name == UNKNOWN or p[best] < PROBABILITY:
            return Piece(UNKNOWN, float(p[best]))
        share, begin, end = max((held(words, t) for t in self.templates[name]), key=lambda found: found[0])
        if share < COVERED or any(coverage(words, t) > share for other, texts in self.templates.items() if other != name for t in texts):
            return Piece(name, float(p[best]))
        return Piece(name, float(p[best]), True, begin, end)

    def classify(self, paragraph: str) -> tuple[str, float, bool]:
        """Family or unknown, its probability, and whether a template confirms it."""
        piece = self.classify_words(paragraph_words(paragraph))
        return piece.family, piece.probability, piece.confirmed

    def stretches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Bounds of the stretches that share pairs with templates, with a word more on each side.

        A stretch longer than ``LONGEST`` words is cut into ones that overlap by more than a template.
        """
        overlap = 2 * max(len(t) for texts in self.templates.values() for t in texts)
        first = last = None
        for i, pair in enumerate(zip(words, words[1:])):
            if pair not in self.pairs:
                continue
            if first is not None and i - last > GAP:
                yield max(first - 1, 0), min(last + 3, len(words))
                first = None
            elif first is not None and i - first > max(LONGEST, 2 * overlap):
                yield max(first - 1, 0), min(last + 3, len(words))
                first = i - overlap
            first, last = i if first is None else first, i
        if first is not None:
            yield max(first - 1, 0), min(last + 3, len(words))

    def find(self, text: str) -> list["Found"]:
        """Every notice of a text, each family once a line."""
        found: list[Found] = []
        rest: list[tuple[int, list[str]]] = []
        for n, line in enumerate(text.split("\n")):
            words = paragraph_words(line)
            own = list(self._joined([(n, words)])) if words else []
            if words and not any(f.confirmed for f in own):
                rest.append((n, words))
                continue
            found += [*self._joined(rest), *own]
            rest = []
        found += self._joined(rest)
        once = {(f.line, f.family): f for f in sorted(found, key=lambda f: (f.confirmed, f.probability))}
        return sorted(once.values(), key=lambda f: (f.line, f.family))

    def _joined(self, lines: list[tuple[int, list[str]]]) -> Iterator["Found"]:
        """Notices in lines of a paragraph joined to one sequence of words."""
        words = [word for _, own in lines for word in own]
        starts = list(accumulate((len(own) for _, own in lines), initial=0))
        open_stretches = list(self.stretches(words))
        while open_stretches:
            begin, end = open_stretches.pop()
            piece = self.classify_words(words[begin:end])
            if piece.family == UNKNOWN:
                continue
            at = begin + piece.begin
            line = lines[bisect_right(starts, at if piece.confirmed else min(begin + 1, end - 1)) - 1][0]
            yield Found(line, piece.family, piece.probability, piece.confirmed)
            if piece.confirmed:
                for left, right in ((begin, at), (begin + piece.end, end)):
                    open_stretches += [(left + x, left + y) for x, y in self.stretches(words[left:right])]


class Piece(NamedTuple):
    """What a sequence of words was classified as, and where a template confirms it."""

    family: str
    probability: float
    confirmed: bool = False
    begin: int = 0
    end: int = 0


class Found(NamedTuple):
    line: int
    family: str
    probability: float
    confirmed: bool


def _variations(words: list[str], fillers: list[list[str]], random: np.random.Generator, n: int) -> list[list[str]]:
    """The template among other words, or with a word lost."""
    out = []
    for _ in range(n):
        own = list(words)
        if len(own) > 6 and random.random() < 0.5:
            own.pop(int(random.integers(len(own))))
        before, after = (fillers[int(random.integers(len(fillers)))] if fillers else [] for _ in range(2))
        cut = lambda w: w[: int(random.integers(0, 12))]
        out.append([*(cut(before) if random.random() < 0.5 else []), *own, *(cut(after) if random.random() < 0.5 else [])])
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_templates(
    unknown: Sequence[str], templates: Mapping[str, Sequence[str]] | None = None, variations: int = 40, rounds: int = 300, seed: int = 5
) -> ParagraphClassifier:
    """Fit to the templates and to lines of the corpus; those that hold a template are left out of the unknown."""
    templates = templates or all_templates()
    random = np.random.default_rng(seed)
    worded = {name: [paragraph_words(t) for t in texts] for name, texts in templates.items()}
    others = [paragraph_words(p) for p in unknown]
    others = [w for w in others if all(coverage(w, t) < COVERED for texts in worded.values() for t in texts)]
    classes = [*worded, UNKNOWN]
    all_grams = {g for texts in worded.values() for t in texts for g in grams(t)}
    places: dict[int, int] = {}
    for h in sorted(map(gram_hash, all_grams)):
        places.setdefault(h, len(places))
    pairs = frozenset(p for texts in worded.values() for t in texts for p in zip(t, t[1:]))
    model = ParagraphClassifier(classes, pairs, places, np.zeros((len(places), len(classes))), np.zeros(len(classes)), 1.0, worded)
    rows, target, aside = [], [], []
    for k, texts in enumerate(worded.values()):
        for words in texts:
            made = [words, *_variations(words, others, random, variations)]
            rows += made
            target += [k] * len(made)
            aside += [i % 4 == 3 for i in range(len(made))]
    # Single pairs of a template alone say nothing, nor do the corpus' own paragraphs.
    for p in sorted(pairs):
        rows.append(list(p))
        target.append(len(classes) - 1)
        aside.append(False)
    for i, words in enumerate(others):
        rows.append(words)
        target.append(len(classes) - 1)
        aside.append(i % 4 == 3)
    x = np.zeros((len(rows), len(places)), np.float32)
    for i, words in enumerate(rows):
        at = model.features(words)
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
    y, aside = np.eye(len(classes))[target], np.array(aside)
    weight = 1 / y[~aside].sum(axis=0).clip(1)
    weight = (y * weight).sum(axis=1)
    x0, y0, w0 = x[~aside], y[~aside], weight[~aside][:, None] / weight[~aside].sum()
    params = [model.weights, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        error = w0 * (_softmax(x0 @ params[0] + params[1]) - y0)
        for i, grad in enumerate((x0.T @ error + 1e-5 * params[0], error.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    model.weights, model.bias = params
    if aside.any():
        logits, truth = x[aside] @ model.weights + model.bias, y[aside]
        loss = lambda t: -np.log((_softmax(logits / t) * truth).sum(axis=1).clip(1e-12)).mean()
        model.temperature = min(np.geomspace(0.5, 5, 40), key=loss)
    # The short way for paragraphs without a template's pair says what the bias says.
    model.bias[-1] = max(model.bias[-1], model.bias[:-1].max() + 1e-6)
    return model


def sample_paragraphs(docs: DataFrame, text: str = "text", rows: int = UNKNOWN_ROWS) -> list[str]:
    """At most ``rows`` different lines by the order of their hash; one from each of as many texts, cut by nothing."""
    lines = F.split(whole(text), "\n")
    pick = F.get(lines, F.pmod(F.xxhash64(whole(text)), F.size(lines)).cast("int"))
    found = docs.select(pick.alias("line")).filter("length(line) BETWEEN 1 AND 2000")
    return [r["line"] for r in drawn(found, ["line"], rows, docs.count()).collect()]


_SCANNED = (
    "doc_id bigint, license string, n_license_paragraphs bigint, n_unconfirmed bigint, "
    "findings array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>"
)


def scan(docs: DataFrame, model: ParagraphClassifier | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: confirmed families (sorted, comma-separated, NULL if none), counts, and the single findings."""
    model = model or fit_templates(sample_paragraphs(docs, text))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finding = pa.list_(
            pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())])
        )
        for batch in batches:
            families, confirmed, doubtful, findings = [], [], [], []
            for value in batch.column(1):
                found = [
                    {"paragraph": f.line, "family": f.family, "probability": f.probability, "confirmed": f.confirmed}
                    for f in model.find(value.as_py())
                ]
                names = sorted({f["family"] for f in found if f["confirmed"]})
                families.append(",".join(names) or None)
                confirmed.append(sum(f["confirmed"] for f in found))
                doubtful.append(len(found) - confirmed[-1])
                findings.append(found)
            columns = [pa.array(families, pa.string()), pa.array(confirmed, pa.int64()), pa.array(doubtful, pa.int64()), pa.array(findings, finding)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["doc_id", "license", "n_license_paragraphs", "n_unconfirmed", "findings"]
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(per_batch, _SCANNED)
