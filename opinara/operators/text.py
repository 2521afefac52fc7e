"""From texts to tokens, vocabulary, bags of words and term frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import tokens
from opinara.operators.partitions import choose_buckets, spread

# Number of hash buckets, rare-token threshold.
NUM_FEATURES = 1000
RARE_TOKEN_THRESHOLD = 2
#: So many words are counted at a time, and those of one text more; what counting holds is many times an Arrow batch.
WORDS_AT_ONCE = 1 << 20


def token_rows(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """(doc_id, pos, token), one row per word, positions from 0."""
    return docs.select("doc_id", F.posexplode(tokens("text", drop_empty)).alias("pos", "token"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over the collection; partial counts before the shuffle take the weight off stop words."""
    words = spread(docs.select("text")).select(F.explode(tokens("text")).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def frequent_tokens(docs: DataFrame, threshold: int = RARE_TOKEN_THRESHOLD) -> DataFrame:
    """Tokens that occur more than ``threshold`` times."""
    return token_counts(docs).where(F.col("n") > threshold)


def document_counts(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, token, n).

    With ``partitions`` the compact texts are shuffled by document once, and
    everything that follows per document, from counting to the topic models,
    needs no further shuffle.  Without it the partial counts are shuffled.
    """
    docs = docs.select("doc_id", "text")
    if partitions:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return _in_order(docs, partitions).mapInArrow(_count_words(None), f"doc_id {kind}, token string, n bigint")
    words = docs.select("doc_id", F.explode(tokens("text")).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def packed_tf(docs: DataFrame, num_features: int = NUM_FEATURES, partitions: int | None = None) -> DataFrame:
    """(doc_id, terms): the hashed frequencies (bucket, tf) as one array per document in the order of buckets.

    Documents without words are left out.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = _in_order(docs, partitions or choose_buckets(docs))
    return ordered.mapInArrow(_count_words(num_features), f"doc_id {kind}, terms array<struct<bucket:bigint,tf:bigint>>")


def add_terms(rows: DataFrame, docs: DataFrame, num_features: int = NUM_FEATURES, partitions: int | None = None) -> DataFrame:
    """``rows`` with the ``terms`` of their texts in ``docs``, NULL where a text has no words.

    They meet in as many parts as the texts call for, so larger tables make more parts and no larger ones.
    """
    partitions = partitions or choose_buckets(docs)
    packed = packed_tf(docs, num_features, partitions).repartition(partitions, "doc_id")
    return rows.repartition(partitions, "doc_id").join(packed, "doc_id", "left")


def hashed_tf(docs: DataFrame, num_features: int = NUM_FEATURES, partitions: int | None = None) -> DataFrame:
    """(doc_id, bucket, tf) by md5 buckets, which any SQL engine can repeat.

    Words are counted where the one shuffle of the texts by document leaves them.
    """
    return packed_tf(docs, num_features, partitions).select("doc_id", F.inline("terms"))


def _in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, words), texts of one id beside each other."""
    return docs.repartition(partitions, "doc_id").sortWithinPartitions("doc_id").select("doc_id", tokens("text").alias("words"))


def _count_words(num_features: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words by id as rows pass that are in the order of ids, or with ``num_features`` their md5 buckets, packed by id.

    Batches are counted in pieces of bounded words.  What is held beyond a piece are the counts of its last id,
    which may go on in the next.
    """

    def bucket(word: bytes) -> int:
        return int(hashlib.md5(word).hexdigest()[:8], 16) % num_features

    def out(ids: pa.Array, run: np.ndarray, names: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        if num_features is None:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(run)), names, pa.array(counts)], ["doc_id", "token", "n"])
        first = np.flatnonzero(np.diff(run, prepend=-1))
        terms = pa.StructArray.from_arrays([names, pa.array(counts)], ["bucket", "tf"])
        offsets = np.append(first, len(run)).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(run[first])), pa.ListArray.from_arrays(offsets, terms)], ["doc_id", "terms"])

    def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column(1).offsets.to_numpy()[:-1]
            cuts = np.flatnonzero(np.diff((starts - starts[0]) // most, prepend=-1))
            for start, end in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                yield batch.slice(start, end - start)

    def run_batches(batches: Iterator[pa.RecordBatch], most: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in pieces(batches, most):
            ids, lists = batch.column(0), batch.column(1)
            lengths, names = np.diff(lists.offsets.to_numpy()), lists.flatten()
            if num_features is not None:
                coded = names.dictionary_encode()
                hashes = np.array([bucket(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
                names = pa.array(hashes[coded.indices.to_numpy()], pa.int64())
            weights = np.ones(len(names), np.int64)
            if held is not None:
                ids, names = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], names])
                lengths, weights = np.append(len(held[1]), lengths), np.append(held[2], weights)
            places = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(places, prepend=-1))
            run = np.repeat(np.cumsum(np.diff(places, prepend=-1) != 0) - 1, lengths)
            if num_features is None:
                coded = names.dictionary_encode()
                values, key, width = coded.dictionary, coded.indices.to_numpy(), len(coded.dictionary)
            else:
                values, key, width = None, names.to_numpy(), num_features
            cell = run * max(width, 1) + key
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            counts = np.add.reduceat(weights[order], cuts) if len(cuts) else weights[:0]
            run, key = run[order][cuts], pa.array(key[order][cuts])
            names = key.cast(pa.int64()) if values is None else values.take(key)
            ids, last = ids.take(pa.array(first)), len(first) - 1
            done = int(np.searchsorted(run, last))
            if done:
                yield out(ids, run[:done], names.slice(0, done), counts[:done])
            held = ids.slice(last), names.slice(done), counts[done:]
        if held is not None and len(held[1]):
            yield out(held[0], np.zeros(len(held[1]), np.int64), held[1], held[2])

    return run_batches


def vectorize(docs: DataFrame, num_features: int = NUM_FEATURES, drop_empty: bool = True) -> DataFrame:
    """Add ``words``, as in every other table, and the sparse vector ``features``; row by row, a small input over all task slots.

    NULL texts are read as empty.  ``drop_empty=False`` counts the empty words between neighbouring separators.
    """
    filled = spread(docs).withColumn("text", F.coalesce("text", F.lit("")))
    worded = filled.withColumn("words", tokens("text", drop_empty))
    return HashingTF(numFeatures=num_features, inputCol="words", outputCol="features").transform(worded)


def vector_entries(vectors: DataFrame, column: str = "features") -> DataFrame:
    """(doc_id, idx, value) of the non-zero vector entries."""
    entries = F.transform(vector_to_array(column), lambda value, idx: F.struct(idx.alias("idx"), value.alias("value")))
    present = F.filter(entries, lambda entry: entry["value"] != 0)
    return vectors.select("doc_id", F.inline(present))
