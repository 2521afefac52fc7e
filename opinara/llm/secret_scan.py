"""Secrets in texts: fixed patterns, and strings that a primed compressor finds novel.

Three patterns give the base spans.  Beyond them, a word that announces a
secret (``private_key``, ``Bearer`` ...) makes the strings that follow it
candidates.  What a candidate costs a zstandard compressor that has been primed
with a dictionary of the corpus' identifiers and with the code around the
candidate is its novelty: names, paths and placeholders are made of pieces that
the compressor has met and cost little, random keys cost about a byte a letter.
Candidates above ``NOVELTY`` bytes a letter are reported as ``novel``.

The identifier dictionary comes from all texts: words without digits that stand
near announcing words, by the number of different surroundings they are met in
(copies of a text are one surrounding), up to ``DICTIONARY_BYTES``, which is
the size of the compressor's dictionary and no cut of texts or candidates.

Defined cases: NULL counts as the empty text, which has no spans; NULL or
repeated ids are carried along, one output row per input row; equal candidates
of a text are separate spans; an empty table gives no rows and an empty
dictionary; columns other than the two named are ignored, whatever their names.
Long texts are read whole; a text has to fit a task.  Spans count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import whole

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_ASSIGNED = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 and more; a shorter run holds none
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that announce a secret.
ANNOUNCING = re.compile(
    r"passw|passphrase|pwd|secret|token|key|credential|auth|bearer|private|signature|session|cookie|salt", re.IGNORECASE | re.ASCII
)
#: Code points after an announcing word in which candidates start, and around a candidate that prime the compressor.
REACH, AROUND = 80, 1024
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~=.-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z_]{4,}")
#: Least compressed bytes a letter of a reported candidate.
NOVELTY = 0.8
#: Different surroundings that make a word an identifier, and the size of the dictionary.
LEAST_SURROUNDINGS, DICTIONARY_BYTES = 3, 16 << 10
LEVEL = 19

_SPANS = "array<struct<start:int,stop:int,kind:string>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the matches of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _reaches(text: str) -> Iterator[tuple[int, int]]:
    """Where candidates may start; reaches that meet are one."""
    begin = end = None
    for word in ANNOUNCING.finditer(text):
        if end is not None and word.start() <= end:
            end = word.end() + REACH
            continue
        if end is not None:
            yield begin, end
        begin, end = word.end(), word.end() + REACH
    if end is not None:
        yield begin, end


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of strings with letters and digits that start in the reach of an announcing word."""
    done = 0
    for begin, end in _reaches(text):
        at = max(begin, done)
        while (m := CANDIDATE.search(text, at)) and m.start() < end:
            at = done = m.end()
            value = m.group()
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield m.span()


@lru_cache(maxsize=4)
def _settings(size: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=size, dict_size=size, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def novelty(value: str, around: str, dictionary: bytes) -> float:
    """Compressed bytes a letter that the value adds to what primes the compressor."""
    # The nearest is the cheapest to point at, so the surroundings come after the dictionary.
    prime = dictionary + b"\n" + around.encode("utf-8", "surrogatepass")
    made = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = _settings(1 << max(10, len(prime).bit_length()))
    size = [len(zstandard.ZstdCompressor(dict_data=made, compression_params=settings).compress(v)) for v in (value.encode(), b"")]
    return (size[0] - size[1]) / len(value)


def find(text: str, dictionary: bytes, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans; novel ones overlap no base span."""
    base = base_spans(text)
    found, at, reached = list(base), 0, 0
    for start, end in candidates(text):
        while at < len(base) and base[at][0] < end:
            reached = max(reached, base[at][2])
            at += 1
        if reached > start:
            continue
        value = text[start:end]
        # A key that is written twice is no less a key.
        around = f"{text[max(0, start - AROUND) : start]}\n{text[end : end + AROUND]}".replace(value, " ")
        if novelty(value, around, dictionary) >= least:
            found.append((start, 3, end))
    return sorted(found)


def identifier_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """The identifiers that stand near announcing words all over the texts, the most frequent last."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, places = [], []
            for value in batch.column(0):
                value = value.as_py()
                for begin, end in _reaches(value):
                    piece = value[max(0, begin - REACH) : end]
                    place = int.from_bytes(blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    for word in set(IDENTIFIER.findall(piece)):
                        words.append(word)
                        places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64())], ["word", "place"])

    met = docs.select(whole(text).alias("text")).mapInArrow(near, "word string, place bigint").distinct()
    often = met.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST_SURROUNDINGS) & (F.length("word") <= 64))
    # A word has four letters at least, and a line end.
    top = often.orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 5).collect()
    held, size = [], 0
    for row in top:
        size += len(row["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        held.append(row["word"])
    return "\n".join(reversed(held)).encode()


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = NOVELTY, dictionary: bytes | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` (start, stop, kind), in order of start and kind, for every row."""
    if dictionary is None:
        dictionary = identifier_dictionary(docs, text)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            spans = [
                [{"start": a, "stop": b, "kind": KINDS[k]} for a, k, b in find(value.as_py(), dictionary, least)] for value in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(
        per_batch, f"doc_id bigint, spans {_SPANS}"
    )


def named(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(one, ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
