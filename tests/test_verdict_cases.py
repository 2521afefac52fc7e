"""Sizes, ids and models at their limits."""

import math

import pytest
from pyspark.sql import functions as F

from opinara.functions.text import tokens
from opinara.operators import cluster, selection, text
from opinara.operators.corpus import build_corpus
from opinara.operators.partitions import MOST_BUCKETS, buckets_for
from opinara.operators.robust import RobustPlsa
from opinara.operators.topics import Plsa
from opinara.sources.readers import BUSINESS_SCHEMA, read_reviews, scan_reviews
from opinara.sources.state import new_path

DOCS = [(1, "a a b a b c c c"), (2, "b c c b a b"), (3, None), (4, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_buckets_stay_legal():
    assert buckets_for(100 << 40, 1000) == MOST_BUCKETS < 100_000
    assert buckets_for(1 << 30, 2) == 4 and buckets_for(0, 8) == 8


def test_reviews_without_ids(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(f'{{"business_id":"b","text":"t{i}","votes":{{"useful":{i}}}}}' for i in range(5)))
    rows = read_reviews(spark, str(tmp_path / "r.json"), view=None).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(5))
    assert all(r["text"] == f"t{r['doc_id']}" and r["votes"]["useful"] == r["doc_id"] for r in rows)


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "b")], [(None, "a"), (2, "b")]])
def test_missing_and_repeated_ids_raise(spark, rows):
    with pytest.raises(ValueError, match="doc_id"):
        build_corpus(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=0)


def test_foreign_vocabulary_raises(spark, docs):
    model = Plsa(2, 1).fit(build_corpus(docs, threshold=0))
    with pytest.raises(ValueError, match="vocabulary"):
        model.fold_in(build_corpus(spark.createDataFrame([(1, "z y x")], "doc_id bigint, text string"), threshold=0))


def test_no_rounds_and_no_words(spark, docs):
    model = Plsa(2, 0).fit(build_corpus(docs, threshold=0))
    assert [r["t0"] for r in model.transform(docs).theta.collect()] == [0.5] * 4
    empty = build_corpus(docs, threshold=1000)
    assert RobustPlsa(2, 1).fit(empty).theta.count() == 4


def test_robust_document_likelihoods_give_the_perplexity(docs):
    corpus = build_corpus(docs, threshold=0)
    model = RobustPlsa(2, 2).fit(corpus)
    total = model.log_likelihood(corpus).agg(F.sum("loglik")).first()[0]
    assert math.isclose(math.exp(-total / corpus.length), model.perplexity[-1] if isinstance(model.perplexity, list) else model.perplexities[-1], rel_tol=1e-9)


def test_kmeans_is_the_same_however_the_session_cuts(spark):
    points = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[(F.col("id") * k % 17).cast("string") for k in (1, 3, 7)]).alias("text"))
    vectors = text.vectorize(points, 50).select("doc_id", "features")
    costs = set()
    for parts in (1, 2, 4):
        costs.add(round(cluster.train_kmeans(vectors.repartition(parts), 4, 5).cost, 6))
    assert len(costs) == 1


def test_one_word_rule(spark):
    rows = spark.createDataFrame([(1, "a a b  c"), (2, "  "), (3, None)], "doc_id bigint, text string")
    assert [r["words"] for r in text.vectorize(rows).orderBy("doc_id").collect()] == [["a", "a", "b", "c"], [], []]
    assert [r[0] for r in rows.select(tokens("text", drop_empty=False)).collect()][:2] == [["a", "a", "b", "", "c"], []]


def test_share_of_businesses(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("business_id"))
    drawn = selection.random_fraction(rows, "business_id", 0.2, seed=3)
    assert abs(drawn.count() / 2000 - 0.2) < 0.04
    assert drawn.collect() == selection.random_fraction(rows, "business_id", 0.2, seed=3).collect()


def test_exact_shares(spark):
    rows = spark.range(103).select(F.col("id").cast("string").alias("business_id"))
    for share, n in ((0, 0), (0.2, 21), (0.5, 52), (1, 103)):
        assert selection.random_share(rows, "business_id", share).count() == n
    with pytest.raises(ValueError):
        selection.random_share(rows, "business_id", 1.5)


def test_broken_lines_are_rescued_and_others_numbered(spark):
    path = new_path(spark, "lines")
    good = ['{"doc_id": 4, "text": "a", "votes": {"useful": 2, "funny": 1}}', '{"text": "b", "business_id": "x"}', '  {"doc_id": 9}', "{}"]
    bad = ['{"doc_id": 5, "text": "cut', "[1, 2]", '"text"', "null", "7", "nonsense", '{"doc_id": "no number"}']
    spark.createDataFrame([(line,) for line in good + bad + ["", "  "]], "value string").coalesce(1).write.text(path)
    scanned = scan_reviews(spark, path)
    assert {r["line"] for r in scanned.rejected.collect()} == set(bad)
    assert {r["reason"] for r in scanned.rejected.where("line = '7'").collect()} == {"no object"}
    rows = {r["doc_id"]: (r["given"], r["text"], r["business_id"]) for r in scanned.reviews.collect()}
    assert rows == {4: (True, "a", None), 9: (True, None, None), 10: (False, "b", "x"), 11: (False, None, None)}
    assert scanned.reviews.where("doc_id = 4").first()["votes"]["useful"] == 2
    assert read_reviews(spark, path).count() == 4
    assert set(read_reviews(spark, path, None).columns) >= {"doc_id", "text", "business_id"}
    nothing = new_path(spark, "lines")
    spark.createDataFrame([("",)], "value string").write.text(nothing)
    empty = scan_reviews(spark, nothing)
    assert empty.reviews.count() == empty.rejected.count() == 0
    with pytest.raises(ValueError):
        scan_reviews(spark, path, BUSINESS_SCHEMA)
