"""The collection a topic model works on: vocabulary, documents and bag of words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.partitions import choose_buckets
from opinara.operators.rowids import Numbered, number_rows
from opinara.operators.text import RARE_TOKEN_THRESHOLD, document_counts
from opinara.sources.state import Stored, bucket_by_bucket, store, store_bucketed

# The tables that a plan broadcasts are together below this estimate of their size on an executor, and below this
# part of the driver's heap, which holds each beside the rows it came from, the blocks it sends and those of before.
BROADCAST_BYTES = 256 << 20
_HEAP_PARTS = 8
# Of a row that numbers find, and of one that its token finds, which is key and row at once.
_ROW_OVERHEAD = 64
_TOKEN_OVERHEAD = 160


def broadcast_limit(frame: DataFrame) -> int:
    """How many bytes a plan may broadcast in the session of ``frame``."""
    heap = frame.sparkSession._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return min(BROADCAST_BYTES, heap // _HEAP_PARTS)


@dataclass
class Vocabulary:
    """(word_id, token, n), ids 0 .. size-1 by falling frequency, ties by token.

    Because low ids are the frequent words, a bounded head of the table holds
    the hot keys.  Joins against the vocabulary broadcast that head and shuffle
    only the rare words, of which none is frequent enough to skew the shuffle.
    """

    frame: DataFrame
    size: int
    occurrences: int
    numbered: Numbered | None = None
    heads: dict[int, int] = field(default_factory=dict)

    def head(self, row_bytes: int = 0, limit: int | None = None) -> int:
        """How many leading words fit into a broadcast.

        ``row_bytes`` counts the payload besides the row overhead; with 0 the
        measured length of the tokens is used.
        """
        limit = broadcast_limit(self.frame) if limit is None else limit
        if row_bytes:
            return min(self.size, limit // (row_bytes + _ROW_OVERHEAD))
        if limit not in self.heads:
            self.heads[limit] = self.numbered.leading(F.octet_length("token") + _TOKEN_OVERHEAD, self._costs(), limit)
        return self.heads[limit]

    def broadcast_size(self, row_bytes: int = 0) -> int:
        """The estimate that ``head`` cuts, of all words."""
        if row_bytes:
            return self.size * (row_bytes + _ROW_OVERHEAD)
        return sum(self._costs())

    def _costs(self) -> list[int]:
        return [part["bytes"] + _TOKEN_OVERHEAD * part["rows"] for part in self.numbered.parts]

    def drop(self) -> None:
        if self.numbered:
            self.numbered.stored.drop()


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Enumerate (token, n) rows."""
    numbered: Numbered = number_rows(
        counts.select("token", "n"),
        [F.col("n").desc(), F.col("token").asc()],
        "word_id",
        {"n": F.col("n"), "bytes": F.octet_length("token")},
    )
    return Vocabulary(
        numbered.frame.select("word_id", "token", "n"),
        numbered.rows,
        sum(part["n"] for part in numbered.parts),
        numbered,
    )


def lookup_words(counts: DataFrame, vocabulary: Vocabulary, limit: int | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``word_id`` to rows with a ``token``; rows outside the vocabulary go.  ``buckets`` as in ``join_words``."""
    head = vocabulary.head(limit=limit)
    words = vocabulary.frame.select("token", "word_id")
    if head >= vocabulary.size:
        return counts.join(F.broadcast(words), "token")
    marked = counts.join(F.broadcast(words.where(F.col("word_id") < head)), "token", "left")
    frequent = marked.where(F.col("word_id").isNotNull())
    rare = marked.where(F.col("word_id").isNull()).drop("word_id")
    found = rare.join(words.where(F.col("word_id") >= head), "token")
    return frequent.unionByName(found.repartition(buckets, "doc_id") if buckets else found)


def bag_of_words(docs: DataFrame, vocabulary: Vocabulary, limit: int | None = None) -> DataFrame:
    """(doc_id, token, n) of (doc_id, text) rows; words outside the vocabulary are dropped."""
    counts = document_counts(docs, choose_buckets(docs.select("doc_id", "text")))
    return lookup_words(counts, vocabulary, limit).select("doc_id", "token", "n")


@dataclass
class Corpus:
    """documents(doc_id, length), vocabulary, and bow(doc_id, word_id, n).

    ``documents`` and ``bow`` are bucketed by ``doc_id`` into ``buckets``
    parts.  Documents left without words stay in ``documents`` with length 0.
    ``words`` are the ids that occur, where the vocabulary is that of other documents.
    """

    documents: DataFrame
    vocabulary: Vocabulary
    bow: DataFrame
    buckets: int
    length: int
    broadcast_bytes: int
    owned: list[Stored] = field(default_factory=list)
    words: DataFrame | None = None

    def drop(self) -> None:
        """Delete the bag of words and document tables (not the vocabulary)."""
        for stored in self.owned:
            stored.drop()
        self.owned = []


def join_words(
    rows: DataFrame, by_word: DataFrame, head: int, size: int, buckets: int | None = None, by_document: DataFrame | None = None
) -> DataFrame:
    """Join rows with a table keyed by ``word_id``: frequent words by broadcast, rare words by shuffle.

    With ``buckets`` the rare ones go back to their documents, so that none of the rows has left its bucket.
    They meet ``by_document``, a table keyed by ``doc_id`` in those buckets, where nothing of it has to move on.
    """

    def beside(part: DataFrame) -> DataFrame:
        return part if by_document is None else part.join(by_document.hint("shuffle_hash"), "doc_id")

    if head >= size:
        return beside(rows).join(F.broadcast(by_word), "word_id")
    frequent = beside(rows.where(F.col("word_id") < head)).join(
        F.broadcast(by_word.where(F.col("word_id") < head)), "word_id"
    )
    rare, rare_words = rows.where(F.col("word_id") >= head), by_word.where(F.col("word_id") >= head)
    if buckets:
        rare = beside(rare.join(rare_words, "word_id").repartition(buckets, "doc_id"))
    else:
        rare = beside(rare).join(rare_words, "word_id")
    return frequent.unionByName(rare)


def _assemble(
    counts: DataFrame, ids: DataFrame, vocabulary: Vocabulary, buckets: int, limit: int, partitioned: bool
) -> Corpus:
    bow = lookup_words(counts, vocabulary, limit, buckets if partitioned else None).select("doc_id", "word_id", "n")
    if not partitioned:
        bow = bow.repartition(buckets, "doc_id")
    with bucket_by_bucket(bow.sparkSession):
        bow_table = store_bucketed(bow, "bow", "doc_id", buckets)
    lengths = bow_table.frame.groupBy("doc_id").agg(F.sum("n").alias("length"))
    documents = (
        ids.select("doc_id")
        .repartition(buckets, "doc_id")
        .join(lengths.hint("shuffle_hash"), "doc_id", "left")
        .select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))
    )
    documents_table = store_bucketed(documents, "documents", "doc_id", buckets)
    # The documents lie in buckets of their ids, so this needs no shuffle.
    found = documents_table.frame.groupBy("doc_id").agg(F.sum("length").alias("length"), F.count("*").alias("rows"))
    totals = found.agg(F.sum("length").alias("length"), F.max("rows").alias("rows"), F.count_if(F.isnull("doc_id")).alias("none")).first()
    if totals["none"] or (totals["rows"] or 0) > 1:
        raise ValueError("doc_id has to be present and unique")
    length = totals["length"] or 0
    return Corpus(
        documents_table.frame, vocabulary, bow_table.frame, buckets, length, limit, [bow_table, documents_table]
    )


def build_corpus(
    docs: DataFrame,
    threshold: int = RARE_TOKEN_THRESHOLD,
    vocabulary: Vocabulary | None = None,
    broadcast_bytes: int | None = None,
    buckets: int | None = None,
) -> Corpus:
    """Corpus of (doc_id, text) rows with unique ids.

    The texts are tokenised once: their counts are written in the buckets that
    the bag of words keeps, and the vocabulary is taken from the counts.  With
    a given ``vocabulary`` the words outside it are dropped, as needed to fold
    new documents into a fitted model.
    """
    buckets = buckets or choose_buckets(docs.select("doc_id", "text"))
    broadcast_bytes = broadcast_limit(docs) if broadcast_bytes is None else broadcast_bytes
    counts = document_counts(docs, buckets)
    if vocabulary is not None:
        corpus = _assemble(counts, docs, vocabulary, buckets, broadcast_bytes, partitioned=True)
        words = store(corpus.bow.select("word_id").distinct(), "words")
        corpus.words = words.frame
        corpus.owned.append(words)
        return corpus
    written = store_bucketed(counts, "counts", "doc_id", buckets)
    vocabulary = build_vocabulary(_above(written.frame, threshold))
    corpus = _assemble(written.frame, docs, vocabulary, buckets, broadcast_bytes, partitioned=True)
    written.drop()
    return corpus


def corpus_from_counts(
    counts: DataFrame,
    ids: DataFrame | None = None,
    threshold: int = 0,
    vocabulary: Vocabulary | None = None,
    broadcast_bytes: int | None = None,
    buckets: int | None = None,
) -> Corpus:
    """Corpus of ready (doc_id, token, n) rows; ``ids`` adds documents without words."""
    if vocabulary is None:
        vocabulary = build_vocabulary(_above(counts, threshold))
    broadcast_bytes = broadcast_limit(counts) if broadcast_bytes is None else broadcast_bytes
    ids = counts.select("doc_id").distinct() if ids is None else ids
    buckets = buckets or choose_buckets(counts)
    return _assemble(counts, ids, vocabulary, buckets, broadcast_bytes, partitioned=False)


def _above(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)
