import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import corpus as corpus_module
from opinara.operators import robust
from opinara.operators.corpus import build_corpus, build_vocabulary, corpus_from_counts
from opinara.operators.priors import Decorrelation, Prior, SymmetricDirichlet, UniformPrior
from opinara.operators.robust import RobustPlsa
from opinara.operators.text import frequent_tokens
from opinara.operators.topics import Plsa, initial_phi

K = 3


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    pool = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(pool, weights=range(40, 0, -1), k=draw.randint(3, 30)))) for i in range(40)]
    rows += [(100, "only rare words"), (101, None), (102, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def corpus(docs):
    return build_corpus(docs)


def thetas(result):
    return {r.doc_id: [r[f"t{k}"] for k in range(K)] for r in result.theta.collect()}


def phis(model):
    return {r.token: [r[f"p{k}"] for k in range(K)] for r in model.phi.collect()}


def close(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=tolerance)


@pytest.fixture(scope="module")
def model(corpus):
    return Plsa(K, 3).fit(corpus)


def test_distributions_sum_to_one(model, corpus):
    theta = thetas(model)
    assert len(theta) == 43
    for mixture in theta.values():
        assert sum(mixture) == pytest.approx(1)
    for k in range(K):
        assert sum(p[k] for p in phis(model).values()) == pytest.approx(1)
    assert len(phis(model)) == corpus.vocabulary.size


def test_documents_without_words_stay_uniform(model):
    for doc in (100, 101, 102):
        assert thetas(model)[doc] == pytest.approx([1 / K] * K)


def test_perplexity_falls_without_priors(model):
    assert len(model.perplexities) == 4
    assert all(b <= a + 1e-9 for a, b in zip(model.perplexities, model.perplexities[1:]))
    rows = model.perplexity.orderBy("iteration").collect()
    assert [r.perplexity for r in rows] == model.perplexities


def test_robust_without_noise_and_background_is_plsa(model, corpus):
    plain = RobustPlsa(K, 3, gamma=0, eps=0).fit(corpus)
    close(thetas(plain), thetas(model))
    close(phis(plain), phis(model))
    assert plain.perplexities == pytest.approx(model.perplexities)
    assert plain.background.agg(F.sum("bg")).first()[0] == 0
    assert plain.noise.agg(F.sum("noise")).first()[0] == 0


def test_robust_parts_are_distributions(corpus):
    robust = RobustPlsa(K, 2).fit(corpus)
    assert robust.background.agg(F.sum("bg")).first()[0] == pytest.approx(1)
    for row in robust.noise.groupBy("doc_id").agg(F.sum("noise").alias("s")).collect():
        assert row.s == pytest.approx(1)


def test_result_does_not_depend_on_partitioning_or_join_way(spark, docs, model):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        vocabulary = build_vocabulary(frequent_tokens(docs.repartition(5)))
        limit = 16 * 110  # room for sixteen words
        other = build_corpus(docs.repartition(5), vocabulary=vocabulary, broadcast_bytes=limit)
        assert 0 < vocabulary.head(8 * (K + 2), limit) < vocabulary.size
        assert other.buckets == 3
        again = Plsa(K, 3).fit(other)
        close(thetas(again), thetas(model))
        close(phis(again), phis(model))
        assert again.perplexities == pytest.approx(model.perplexities)
        robust = RobustPlsa(K, 2).fit(other)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    close(thetas(robust), thetas(RobustPlsa(K, 2).fit(build_corpus(docs))))


def test_fold_in_of_new_texts(spark, docs, model):
    new = spark.createDataFrame([(1, "w0 w1 unseen w2"), (2, "nothing known"), (3, None)], "doc_id bigint, text string")
    folded = thetas(model.transform(new))
    assert sum(folded[1]) == pytest.approx(1)
    assert folded[2] == folded[3] == pytest.approx([1 / K] * K)
    # The mixture by hand: three rounds with the fitted phi.
    phi = phis(model)
    theta = [1 / K] * K
    for _ in range(3):
        sums = [0.0] * K
        for word in ("w0", "w1", "w2"):
            z = sum(p * t for p, t in zip(phi[word], theta))
            for k in range(K):
                sums[k] += phi[word][k] * theta[k] / z
        theta = [s / sum(sums) for s in sums]
    assert folded[1] == pytest.approx(theta)


@pytest.mark.parametrize("background", ["reestimate", "fixed"])
def test_robust_fold_in(spark, corpus, background):
    robust = RobustPlsa(K, 2).fit(corpus)
    new = spark.createDataFrame([(1, "w0 w1 w2"), (2, None)], "doc_id bigint, text string")
    folded = robust.transform(new, background)
    assert sum(thetas(folded)[1]) == pytest.approx(1)
    assert len(folded.perplexities) == 3
    with pytest.raises(ValueError):
        robust.transform(new, "other")


def test_a_topic_without_counts_keeps_its_words(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "doc_id bigint, token string, n bigint")
    corpus = corpus_from_counts(counts)
    start = corpus.vocabulary.frame.select("word_id", F.lit(0.5).alias("p0"), F.lit(0.5).alias("p1"))
    model = Plsa(2, 1, phi_prior=SymmetricDirichlet(-9), perplexity=False).fit(corpus, start)
    assert {r.token: (r.p0, r.p1) for r in model.phi.collect()} == {"a": (0.5, 0.5), "b": (0.5, 0.5)}


def test_impossible_words_give_infinite_perplexity(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "doc_id bigint, token string, n bigint")
    corpus = corpus_from_counts(counts)
    start = corpus.vocabulary.frame.select(
        "word_id", *[F.when(F.col("token") == "a", 1.0).otherwise(0.0).alias(f"p{k}") for k in range(2)]
    )
    model = Plsa(2, 1).fit(corpus, start)
    assert model.perplexities == [math.inf, math.inf]
    assert [tuple(r) for r in model.theta.select("t0", "t1").collect()] == [(0.5, 0.5)]


def test_words_missing_from_the_documents_keep_their_rows(spark, corpus):
    some = spark.createDataFrame([(1, "w0", 2)], "doc_id bigint, token string, n bigint")
    part = corpus_from_counts(some, vocabulary=corpus.vocabulary)
    model = Plsa(K, 1, phi_prior=SymmetricDirichlet(1.5)).fit(part)
    phi = phis(model)
    assert len(phi) == corpus.vocabulary.size
    assert min(min(p) for p in phi.values()) > 0


def test_dirichlet_density(spark):
    frame = spark.createDataFrame([(0.2, 0.3, 0.5)], "a double, b double, c double")
    density = frame.select(SymmetricDirichlet(1.1).log_prior([F.col(c) for c in "abc"])).first()[0]
    assert density == pytest.approx(0.786070, abs=1e-6)
    frame = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert frame.select(SymmetricDirichlet(0.5).log_prior([F.col(c) for c in "ab"])).first()[0] == pytest.approx(
        4.611728, abs=1e-6
    )


def test_a_prior_of_ones_own(corpus):
    class First(Prior):
        """Adds weight in proportion to the old mixture."""

        def regularize(self, count, old):
            return count + old * 5

    theta = thetas(Plsa(K, 2, theta_prior=First()).fit(corpus))
    for mixture in theta.values():
        assert sum(mixture) == pytest.approx(1)
    assert theta[101] == pytest.approx([1 / K] * K)


def test_rounds_leave_only_the_last_tables(spark, docs):
    import os

    from opinara.sources.state import shared_folder

    def tables():
        return set(os.listdir(f"{shared_folder(spark)}/opinara"))

    corpus = build_corpus(docs)
    before = tables()
    model = Plsa(K, 3).fit(corpus)
    assert len(tables() - before) == 2
    model.drop()
    assert tables() == before


def overlaps(model):
    rows = np.array([[r["p0"], r["p1"], r["p2"]] for r in model.phi.collect()])
    products = rows.T @ rows
    return [products[0, 1], products[0, 2], products[1, 2]]


@pytest.mark.parametrize("kind", [Plsa, RobustPlsa])
def test_decorrelated_topics_overlap_less(docs, kind):
    corpus = build_corpus(docs, threshold=0)
    plain, apart = (kind(3, 4, seed=1, phi_prior=prior).fit(corpus) for prior in (UniformPrior(), Decorrelation(200.0)))
    assert sum(x * x for x in overlaps(apart)) < sum(x * x for x in overlaps(plain))
    for k in range(3):
        assert apart.phi.agg(F.sum(f"p{k}")).first()[0] == pytest.approx(1.0)
    # The density of the last topics is part of the last perplexity.
    penalty = 100.0 * sum(x * x for x in overlaps(apart))
    if kind is Plsa:
        total = apart.log_likelihood(corpus).agg(F.sum("loglik")).first()[0]
        assert apart.perplexities[-1] == pytest.approx(math.exp(-(total - penalty) / corpus.length))


def test_one_topic_has_nothing_to_overlap_with(docs):
    corpus = build_corpus(docs, threshold=0)
    alone, plain = (Plsa(1, 2, phi_prior=prior).fit(corpus).phi.orderBy("token").collect() for prior in (Decorrelation(9.0), UniformPrior()))
    assert [r["p0"] for r in alone] == pytest.approx([r["p0"] for r in plain])


def test_matrix_sums_of_an_empty_corpus(docs):
    empty = build_corpus(docs, threshold=1000)
    assert Plsa(2, 2, phi_prior=Decorrelation(5.0)).fit(empty).phi.count() == 0


def test_fold_in_hands_out_the_words_of_the_new_texts_only(spark, model):
    new = spark.createDataFrame([(1, "w0 w1 w1 unseen"), (2, "w2")], "doc_id bigint, text string")
    built = build_corpus(new, vocabulary=model.vocabulary)
    assert built.words.count() == 3 < model.vocabulary.size
    rows = model.trainer._start(built, model.word_phi).rows()
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 3


def test_the_bag_is_not_written_anew_each_round(docs, monkeypatch):
    built = build_corpus(docs, threshold=0)
    names = []
    written = robust.store_bucketed

    def watched(frame, name, *others):
        names.append(name)
        return written(frame, name, *others)

    monkeypatch.setattr(robust, "store_bucketed", watched)
    found = RobustPlsa(K, 2, perplexity=False).fit(built)
    assert names == []
    monkeypatch.setattr(robust, "_UNWRITTEN_ROUNDS", 1)
    other = RobustPlsa(K, 2, perplexity=False).fit(built)
    assert names == ["weights"]
    built.drop()
    # The noise is still there without the corpus, and the same.
    noise = {(r.doc_id, r.token): [r.noise] for r in found.noise.collect()}
    close({(r.doc_id, r.token): [r.noise] for r in other.noise.collect()}, noise)
    close(thetas(other), thetas(found))
    paths = [table.path for table in found.owned + other.owned]
    found.drop()
    other.drop()
    found.drop()
    assert not any(os.path.exists(path.removeprefix("file:")) for path in paths)


def test_sums_of_a_round_broadcast_phi_once_and_shuffle_by_word_only(corpus):
    run = RobustPlsa(K, 2)._start(corpus, initial_phi(corpus.vocabulary, K))
    by_document = run.sums_by_document()
    assert "Exchange hashpartitioning" not in by_document._jdf.queryExecution().executedPlan().toString()
    assert set(run.word_sums(False)) == {"background_count", *(f"r{k}" for k in range(K))}


def test_the_bag_is_written_bucket_by_bucket(docs):
    built = build_corpus(docs, threshold=0, buckets=11)
    names = [name for name in os.listdir(built.owned[0].path.removeprefix("file:")) if name.startswith("part-")]
    # The task's number comes first, the bucket's last.
    assert len(names) > 5 and all(int(n.split("-")[1]) == int(n.rsplit("_", 1)[1].split(".")[0]) for n in names)
    assert built.bow.agg(F.sum("n")).first()[0] == built.length
    built.drop()


def room_for(built, tables):
    """Room for the word tables of so many rounds in what a plan broadcasts."""
    built.broadcast_bytes = tables * built.vocabulary.size * (8 * (K + 3) + 64)


def watch_writes(monkeypatch):
    names, written = [], robust.store_bucketed

    def watched(frame, name, *others):
        names.append(name)
        return written(frame, name, *others)

    monkeypatch.setattr(robust, "store_bucketed", watched)
    return names


def test_broadcasts_are_bounded_by_the_heap_of_the_driver(spark, docs, monkeypatch):
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    monkeypatch.setattr(corpus_module, "_HEAP_PARTS", heap // 2000)
    small = build_corpus(docs, threshold=0)
    assert 2000 <= small.broadcast_bytes < 2002
    assert 0 < small.vocabulary.head() < small.vocabulary.size
    assert small.bow.agg(F.sum("n")).first()[0] == small.length


def test_a_pass_broadcasts_the_words_of_no_more_rounds_than_fit_together(docs, monkeypatch):
    built = build_corpus(docs, threshold=0)
    names = watch_writes(monkeypatch)
    found = {}
    for tables, wanted in ((3, []), (2, ["weights"]), (1, ["weights", "weights"])):
        room_for(built, tables)
        found[tables] = RobustPlsa(K, 2).fit(built)
        assert names == wanted
        names.clear()
    for other in (found[2], found[1]):
        assert other.perplexities == pytest.approx(found[3].perplexities)
        close(thetas(other), thetas(found[3]))


def test_likelihoods_of_documents_broadcast_no_more_than_fits_together(docs, monkeypatch):
    built = build_corpus(docs, threshold=0)
    trainer = RobustPlsa(K, 2, perplexity=False)
    whole = trainer.fit(built)
    wanted = {r.doc_id: [r.loglik] for r in whole.log_likelihood(built).collect()}
    names = watch_writes(monkeypatch)
    room_for(built, 2)
    model = trainer.fit(built)
    assert names == []
    close({r.doc_id: [r.loglik] for r in model.log_likelihood(built).collect()}, wanted)
    assert names == ["weights"]
    paths = [table.path.removeprefix("file:") for table in model.owned]
    assert all(map(os.path.exists, paths))
    model.drop()
    built.drop()
    whole.drop()
    assert not any(map(os.path.exists, paths))


def test_noise_is_written_where_words_and_names_do_not_fit_together(docs, monkeypatch):
    built = build_corpus(docs, threshold=0)
    trainer = RobustPlsa(K, 2, perplexity=False)
    names = watch_writes(monkeypatch)

    def noise(model):
        return {(r.doc_id, r.token): [r.noise] for r in model.noise.collect()}

    wanted = noise(trainer.fit(built))
    assert names == []
    room_for(built, 2)
    model = trainer.fit(built)
    assert names == []
    close(noise(model), wanted)
    assert names == ["weights"]
    close(noise(model), wanted)
    assert names == ["weights"]
    path = model.owned[-1].path.removeprefix("file:")
    assert "weights" in path and os.path.exists(path)
    model.drop()
    assert not os.path.exists(path)
