import hashlib
import itertools
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.functions.text import hash_bucket, hash_unit, tokens
from opinara.operators import corpus, partitions, rowids, text

TEXTS = [
    (1, "The cat sat\ton the  mat"),
    (2, "the dog\nsat"),
    (3, None),
    (4, ""),
    (5, " A b  c "),
    (6, "the the the THE"),
    (7, "\t\n \x0b\f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)


def words(value):
    return (value or "").lower().split()


def expected_counts():
    return {(d, t): n for d, value in TEXTS for t, n in Counter(words(value)).items()}


def test_tokens_drop_empty_words_and_null(docs):
    got = {r.doc_id: r.words for r in docs.select("doc_id", tokens("text").alias("words")).collect()}
    assert got == {d: words(value) for d, value in TEXTS}


def test_tokens_can_keep_inner_empty_words(spark):
    row = spark.createDataFrame([(" A b  c ",)], "text string").select(tokens("text", False).alias("w")).first()
    assert row.w == ["", "a", "b", "", "c"]


def test_token_rows_have_positions(docs):
    rows = text.token_rows(docs).where("doc_id = 2").orderBy("pos").collect()
    assert [(r.pos, r.token) for r in rows] == [(0, "the"), (1, "dog"), (2, "sat")]


def test_counts(docs):
    total = Counter(t for _, value in TEXTS for t in words(value))
    assert {r.token: r.n for r in text.token_counts(docs).collect()} == total
    for partitions in (None, 5):
        got = {(r.doc_id, r.token): r.n for r in text.document_counts(docs, partitions).collect()}
        assert got == expected_counts()


def test_a_token_at_the_threshold_is_dropped(docs):
    assert {r.token for r in text.frequent_tokens(docs, 2).collect()} == {"the"}
    assert {r.token for r in text.frequent_tokens(docs, 1).collect()} == {"the", "sat"}


def test_vocabulary_order(docs):
    vocabulary = corpus.build_vocabulary(text.frequent_tokens(docs, 0))
    total = Counter(t for _, value in TEXTS for t in words(value))
    wanted = sorted(total.items(), key=lambda e: (-e[1], e[0]))
    rows = vocabulary.frame.orderBy("word_id").collect()
    assert [(r.word_id, r.token, r.n) for r in rows] == [(i, t, n) for i, (t, n) in enumerate(wanted)]
    assert vocabulary.size == len(total)
    assert vocabulary.occurrences == sum(total.values())


@pytest.mark.parametrize("limit", [0, 200, 1 << 20])
def test_bag_of_words_by_broadcast_head_and_shuffled_rest(spark, docs, limit):
    vocabulary = corpus.build_vocabulary(text.frequent_tokens(docs, 0))
    head = vocabulary.head(limit=limit)
    assert (head == 0) if limit == 0 else (0 < head < vocabulary.size) if limit == 200 else head == vocabulary.size
    got = {(r.doc_id, r.token): r.n for r in corpus.bag_of_words(docs, vocabulary, limit).collect()}
    assert got == expected_counts()
    built = corpus.build_corpus(docs, vocabulary=vocabulary, broadcast_bytes=limit)
    assert built.bow.count() == len(got)
    lengths = {r.doc_id: r.length for r in built.documents.collect()}
    assert lengths == {d: len(words(value)) for d, value in TEXTS}
    assert built.length == sum(lengths.values())


def test_hashed_tf_matches_md5(docs):
    wanted = Counter()
    for (doc, token), n in expected_counts().items():
        wanted[doc, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 1000] += n
    assert {(r.doc_id, r.bucket): r.tf for r in text.hashed_tf(docs).collect()} == wanted


def test_hash_expressions(spark):
    row = spark.range(1).select(hash_bucket(F.lit("the"), 7).alias("b"), hash_unit(F.lit("the")).alias("u")).first()
    number = int(hashlib.md5(b"the").hexdigest()[:8], 16)
    assert (row.b, row.u) == (number % 7, (number + 1) / 4294967297.0)


def test_vectorize_counts_every_word(docs):
    rows = text.vectorize(docs).collect()
    assert all(r.features.size == text.NUM_FEATURES for r in rows)
    entries = text.vector_entries(text.vectorize(docs)).groupBy("doc_id").agg(F.sum("value").alias("v")).collect()
    got = {r.doc_id: r.v for r in entries}
    assert got[2] == 3 and got[6] == 4


def test_row_numbers_are_consecutive(spark):
    frame = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("key"))
    numbered = rowids.number_rows(frame, [F.col("key").asc()], "i", {"total": F.col("key")})
    rows = numbered.frame.orderBy("i").collect()
    assert [r.i for r in rows] == list(range(5000))
    assert [r.key for r in rows] == sorted(r.key for r in rows)
    assert numbered.rows == 5000
    assert sum(p["total"] for p in numbered.parts) == sum(r.key for r in rows)
    assert len(numbered.parts) <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # what the driver sees


@pytest.mark.parametrize("limit", [0, 9, 10, 4000, 12_345, 10**9])
def test_leading_rows_by_two_levels(spark, limit):
    costs = [10 + i % 7 for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(costs)), "key bigint, cost bigint")
    numbered = rowids.number_rows(frame, [F.col("key").asc()], "i", {"cost": F.col("cost")})
    expected = sum(total <= limit for total in itertools.accumulate(costs))
    assert numbered.leading(F.col("cost"), [p["cost"] for p in numbered.parts], limit) == expected


@pytest.mark.parametrize("n", [0, 1, 50, 999, 1000, 5000])
def test_first_rows_of_any_number(spark, n):
    frame = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("score"))
    order = [F.col("score").desc_nulls_last(), F.col("key").asc()]
    expected = sorted(((-(i % 5) if i % 5 else 1, i) for i in range(1000)))[:n]
    for top_rows in (10, 10**6):
        assert sorted(r.key for r in rowids.first_rows(frame, order, n, top_rows).collect()) == sorted(i for _, i in expected)


def test_words_of_one_id_are_counted_together_across_batches(spark):
    """Ids come twice, are NULL or have no words, and every row is a batch of its own."""
    rows = [(1, "b a a"), (2, "x İ x"), (1, "a c"), (None, "a"), (None, "z a"), (3, " "), (4, None), (1, None), (5, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = Counter()
    for row in docs.select("doc_id", F.explode(tokens("text")).alias("token"), hash_bucket(F.col("token"), 1000).alias("bucket")).collect():
        wanted[row.doc_id, row.token, row.bucket] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for parts in (1, 3):
            got = text.document_counts(docs, parts).collect()
            assert sorted((str(r.doc_id), r.token, r.n) for r in got) == sorted((str(d), t, n) for (d, t, _), n in wanted.items())
            packed = text.packed_tf(docs, partitions=parts).collect()
            assert [sorted(r.terms) for r in packed] == [r.terms for r in packed]
            assert sorted((str(r.doc_id), t.bucket, t.tf) for r in packed for t in r.terms) == sorted((str(d), b, n) for (d, _, b), n in wanted.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_batch_is_counted_in_pieces():
    """Words by word and by bucket, the same in pieces of any size, and what they take does not grow with the batch."""
    lists = [["a", "b", "a"], [], ["c"], ["a"], ["b", "b"], [], [], ["x"] * 9, ["a", "x"], []]
    ids = [1, 1, 1, 2, 2, None, None, None, 3, 4]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "words"])
    wanted = Counter((i, w) for i, ws in zip(ids, lists) for w in ws)
    hashed = Counter()
    for (i, w), n in wanted.items():
        hashed[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 7] += n
    for most in (1, 2, 4, 100):
        for cut in (0, 3, 7):
            halves = [batch.slice(0, cut), batch.slice(cut)]
            rows = [r for out in text._count_words(None)(iter(halves), most) for r in out.to_pylist()]
            assert sorted((str(r["doc_id"]), r["token"], r["n"]) for r in rows) == sorted((str(i), w, n) for (i, w), n in wanted.items())
            packed = [r for out in text._count_words(7)(iter(halves), most) for r in out.to_pylist()]
            assert sorted((str(r["doc_id"]), t["bucket"], t["tf"]) for r in packed for t in r["terms"]) == sorted((str(i), b, n) for (i, b), n in hashed.items())

    def held(texts: int) -> int:
        words = pa.array([["w%d" % (i % 997) for i in range(500)]] * texts, pa.list_(pa.string()))
        large = pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), words], ["doc_id", "words"])
        tracemalloc.start()
        assert sum(out.num_rows for out in text._count_words(1000)(iter([large]))) == texts
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert held(9000) < 1.3 * held(3000)


def test_counting_keeps_no_table_of_all_words(docs):
    """One shuffle of the texts, then rows pass: an aggregation would hold all words of a task, or spill them."""
    for frame in (text.document_counts(docs, 3), text.hashed_tf(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_buckets_follow_what_is_unpacked(spark, monkeypatch):
    monkeypatch.setattr(partitions, "scanned_bytes", lambda frame: 6 << 30)
    assert (6 << 30) / partitions.choose_buckets(spark.range(1)) <= 32 << 20


def test_terms_meet_their_rows_in_parts_that_follow_the_texts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b"), (None, "c")], "doc_id bigint, text string")
    rows = docs.select("doc_id", F.lit("x").alias("owner")).unionByName(docs.select("doc_id", F.lit("y").alias("owner")))
    parts = 7  # the session shuffles into 2
    joined = text.add_terms(rows, docs, partitions=parts)
    found = {(r.doc_id, r.owner): None if r.terms is None else sum(t.tf for t in r.terms) for r in joined.collect()}
    assert found == {(i, o): n for o in "xy" for i, n in ((1, 3), (2, None), (3, 1), (None, None))}
    assert joined.count() == rows.count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [doc_id") == plan.count(f"], {parts}") == 3
