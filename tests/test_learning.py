"""Selection, sources, regression, clustering and the whole experiments on small inputs."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinara.operators import cluster, lda, regression, selection, text
from opinara.plans import checks, experiments
from opinara.sources import models, readers
from opinara.sources.state import commit, committed, new_path, path_exists, shared_folder


@pytest.fixture(scope="module")
def reviews(spark, tmp_path_factory):
    """Reviews read from JSON lines, with fields the schema leaves out."""
    folder = tmp_path_factory.mktemp("json")
    with open(folder / "reviews.json", "w") as file:
        for i in range(120):
            words = ["good", "great"] * (i % 5) + ["bad"] * (i % 3) + [f"dish{i % 7}", f"w{i}"]
            useful = i % 5 if i % 4 else None
            line = {"doc_id": i, "business_id": f"b{i % 4}", "text": " ".join(words), "stars": 3}
            line["votes"] = {"useful": useful, "funny": 0}
            file.write(json.dumps(line) + "\n")
    return readers.read_reviews(spark, str(folder))


def test_json_with_nested_votes(spark, reviews):
    assert reviews.columns == ["doc_id", "business_id", "text", "votes"]
    assert spark.sql("SELECT count(*) FROM review").first()[0] == 120
    labelled = selection.text_with_label(reviews)
    assert labelled.count() == 90
    assert labelled.where("doc_id = 1").first().label == 1


def test_schema_can_be_inferred(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"business_id":"b1","review_count":20,"city":"x"}\n{"business_id":"b2","review_count":15}\n')
    inferred = readers.read_businesses(spark, str(tmp_path), schema=None)
    assert set(inferred.columns) == {"business_id", "review_count", "city"}
    declared = readers.read_businesses(spark, str(tmp_path))
    assert [r.business_id for r in selection.businesses_above(declared).collect()] == ["b1"]


def test_reviews_of_one_business(reviews):
    assert selection.reviews_of(reviews, "b1").count() == 30
    for missing in ("", None):
        with pytest.raises(ValueError):
            selection.reviews_of(reviews, missing)
    with pytest.raises(ValueError):
        experiments.business_vectors(reviews, "nobody")


def test_split_is_whole_and_repeatable(reviews):
    training, test = selection.split(reviews)
    a = {r.doc_id for r in training.collect()}
    b = {r.doc_id for r in test.collect()}
    assert not a & b and len(a | b) == 120
    assert {r.doc_id for r in selection.split(reviews.repartition(9))[0].collect()} == a


def test_random_draws(reviews):
    businesses = selection.review_counts(reviews)
    first = selection.random_business(businesses, seed=1).collect()
    assert first == selection.random_business(businesses.repartition(3), seed=1).collect() and len(first) == 1
    assert len({selection.random_business(businesses, seed=s).first().business_id for s in range(12)}) > 1
    per = {r.business_id: r.doc_id for r in selection.random_review_per(reviews).collect()}
    assert len(per) == 4 and all(f"b{doc % 4}" == business for business, doc in per.items())


def test_gradient_steps_match_numpy(spark, reviews):
    labelled = selection.text_with_label(reviews)
    packed = regression.packed_tf(labelled).join(labelled.select("doc_id", "label"), "doc_id", "right")
    rows = packed.collect()
    x = np.zeros((len(rows), text.NUM_FEATURES))
    for i, row in enumerate(rows):
        for term in row.terms:
            x[i, term.bucket] = term.tf
    y = np.array([row.label for row in rows], dtype=float)
    for ridge in (0.0, 0.01):
        w = np.zeros(text.NUM_FEATURES)
        for step in range(1, 4):
            size = 0.05 / math.sqrt(step)
            w = w * (1 - size * ridge) - size * (x.T @ (x @ w - y)) / len(y)
        model = regression.train_by_gradient(packed, 3, 0.05, ridge)
        assert model.weights == pytest.approx(w.tolist(), abs=1e-9)
        predictions = {r.doc_id: r.prediction for r in model.transform(packed).collect()}
        assert [predictions[r.doc_id] for r in rows] == pytest.approx((x @ w).tolist(), abs=1e-9)
        by_table = regression.predict_by_weights(labelled, model.table(packed)).collect()
        assert {r.doc_id: r.prediction for r in by_table} == pytest.approx(predictions)


def test_gradient_counts_documents_without_words(spark):
    docs = spark.createDataFrame([(1, "a", 1.0), (2, "", 1.0)], "doc_id bigint, text string, label double")
    packed = regression.packed_tf(docs).join(docs.select("doc_id", "label"), "doc_id", "right")
    model = regression.train_by_gradient(packed, 1)
    assert max(model.weights) == pytest.approx(0.5)  # one gradient of 1, over two documents
    assert {r.doc_id: r.prediction for r in model.transform(packed).collect()} == pytest.approx({1: 0.5, 2: 0.0})
    with pytest.raises(ValueError):
        regression.train_by_gradient(packed.limit(0), 1)


def test_errors(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (2.0, 5.0)], "prediction double, label double")
    row = regression.errors(frame).first()
    assert (row.mse, row.rmse) == pytest.approx((5.0, math.sqrt(5.0)))


def test_useful_models_are_saved_and_loaded(spark, reviews):
    folder = new_path(spark, "models")
    calls = []

    def train():
        calls.append(1)
        return tuple(experiments.train_useful(reviews))

    first = models.load_or_train(spark, folder, train)
    version = committed(spark, folder)
    assert path_exists(spark, f"{folder}/{version}/linear") and path_exists(spark, f"{folder}/{version}/ridge")
    second = models.load_or_train(spark, folder, train)
    assert len(calls) == 1
    for a, b in zip(first, second):
        assert a.coefficients == b.coefficients
    with pytest.raises(FileNotFoundError):
        models.load_models(folder + "-missing")


def test_half_written_models_do_not_count(spark, reviews):
    folder = new_path(spark, "models")
    linear, ridge = experiments.train_useful(reviews)
    linear.write().save(f"{folder}/linear")  # saves that broke off: one model of two, and metadata without data
    linear.write().save(f"{folder}/0123/linear")
    spark.createDataFrame([("x",)], "value string").write.text(f"{folder}/0123/ridge/metadata")
    calls = []

    def train():
        calls.append(1)
        return linear, ridge

    assert committed(spark, folder) is None
    models.load_or_train(spark, folder, train)
    models.load_or_train(spark, folder, train)
    assert len(calls) == 1


def test_a_reader_sees_the_old_pair_or_the_new_one(spark, reviews, monkeypatch):
    folder = new_path(spark, "models")
    linear, ridge = experiments.train_useful(reviews)
    models.save_models(folder, (linear, ridge))
    seen = []
    monkeypatch.setattr(models, "commit", lambda *given: (seen.append(models.load_models(folder)), commit(*given)))
    models.save_models(folder, (ridge, linear))  # everything is written when the old pair is read
    assert [m.coefficients for m in seen[0]] == [linear.coefficients, ridge.coefficients]
    assert [m.coefficients for m in models.load_models(folder)] == [ridge.coefficients, linear.coefficients]

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(models, "commit", broken)
    with pytest.raises(OSError):
        models.save_models(folder, (linear, linear))
    assert [m.coefficients for m in models.load_models(folder)] == [ridge.coefficients, linear.coefficients]


def test_useful_metrics(reviews):
    trained = experiments.train_useful(reviews)
    rows = {r.model: r for r in trained.metrics.collect()}
    assert set(rows) == {"linear", "ridge"}
    for row in rows.values():
        assert row.rmse == pytest.approx(math.sqrt(row.mse))


def test_more_clusters_cost_less(spark, reviews):
    vectors = experiments.business_vectors(reviews, "b1").select("doc_id", "features")
    two, five = (cluster.train_kmeans(vectors, k) for k in (2, 5))
    assert five.cost < two.cost
    table = cluster.centroids(spark, five)
    assert [r.cluster_id for r in table.orderBy("cluster_id").collect()] == list(range(5))
    assert {len(r.center) for r in table.collect()} == {text.NUM_FEATURES}
    from opinara.operators.ranking import nearest_center, within_set_error

    points = cluster.points_of(vectors)
    assert within_set_error(points, table).first()[0] == pytest.approx(five.cost)
    assigned = nearest_center(points, table).join(five.transform(vectors).withColumnRenamed("cluster_id", "own"), "doc_id")
    assert assigned.where("cluster_id <> own").count() == 0


def test_experiments(spark, reviews):
    trained = experiments.train_all(reviews, "b2", k=3)
    assert trained.lda.isDistributed()
    seen = experiments.observe(reviews, "b2", trained.kmeans, trained.useful.ridge)
    assert seen.columns == ["doc_id", "text", "useful_pred", "cluster_id"]
    assert seen.count() == 30
    assert {r.cluster_id for r in seen.collect()} <= {0, 1, 2}
    businesses = selection.review_counts(reviews)
    ranked = experiments.rank_instance(reviews, businesses, trained.useful.linear, k=3).collect()
    assert len(ranked) == 1
    row = ranked[0]
    own = trained.useful.linear.transform(experiments.business_vectors(reviews, row.business_id))
    assert row.useful_pred == pytest.approx(own.agg(F.max("prediction")).first()[0])
    with pytest.raises(ValueError):
        experiments.rank_instance(reviews, businesses, trained.useful.linear, minimum=1000)


def test_state_goes_to_the_configured_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(shared_folder(spark))


def test_library_solutions_match_numpy(spark, reviews):
    labelled = selection.text_with_label(reviews)
    vectors = text.vectorize(labelled, 40).select("doc_id", "features", F.col("label").cast("double").alias("label"))
    rows = vectors.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    ridge = np.linalg.solve(x.T @ x / len(y) + 0.01 * np.eye(40), x.T @ y / len(y))
    assert regression.train_ridge(vectors, 0.01).coefficients.toArray() == pytest.approx(ridge, abs=1e-6)  # the solver stops by its gain
    with pytest.raises(ValueError, match="equal"):
        regression.train_ridge(vectors.withColumn("label", F.lit(3.0)))
    linear = regression.train_linear(vectors).coefficients.toArray()
    best = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert x @ linear == pytest.approx(best, abs=1e-5)


def test_checks_see_wrong_models(spark, reviews):
    vectors = experiments.business_vectors(reviews, "b1").select("doc_id", "features")
    model = cluster.train_kmeans(vectors, 3)
    assigned = model.transform(vectors)
    right = checks.clusters(vectors, assigned, model).collect()
    assert len(right) == 30 and all(r.nearest and r.cost_holds for r in right)
    moved = assigned.withColumn("cluster_id", (F.col("cluster_id") + 1) % 3)
    assert not any(r.nearest for r in checks.clusters(vectors, moved, model).collect())
    labelled = selection.text_with_label(reviews)
    training = text.vectorize(labelled).select("doc_id", "features", F.col("label").cast("double").alias("label"))
    ridge = regression.train_ridge(training)
    assert all(r.stationary for r in checks.stationary(training, ridge, regression.RIDGE).collect())
    assert not all(r.stationary for r in checks.stationary(training, ridge, 1.0).collect())


def test_buckets_and_weights_have_to_fit(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    for rows in ([(4, 1.0)], [(-1, 1.0)], [(1, 1.0), (1, 2.0)], [(None, 1.0)]):
        weights = spark.createDataFrame(rows, "bucket bigint, weight double")
        with pytest.raises(ValueError):
            regression.predict_by_weights(docs, weights, 4)
    with pytest.raises(Exception, match="no weight"):
        regression.GradientModel([0.5]).transform(regression.packed_tf(docs, 100)).collect()


def test_digamma(spark):
    known = {1.0: -0.5772156649015329, 0.5: -1.9635100260214235, 0.01: -100.56088545786868, 10.0: 2.251752589066721}
    rows = spark.createDataFrame([(x,) for x in known], "x double").select("x", lda.digamma(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == {x: pytest.approx(y, abs=1e-8) for x, y in known.items()}


def brute_fold_in(x, topics, alpha, rounds):
    own = np.full(len(topics), x.sum() / len(topics))
    for _ in range(rounds):
        p = topics * (own + alpha - 1)[:, None]
        own = (p / p.sum(axis=0) * x).sum(axis=1)
    theta = (own + alpha - 1) / (own + alpha - 1).sum()
    return theta, float((x * np.log(theta @ topics)).sum())


def test_lda_of_texts(spark, reviews):
    docs = reviews.where("business_id = 'b1'").select("doc_id", "text")
    empty = spark.createDataFrame([(10**6, "")], "doc_id bigint, text string")
    vectors = text.vectorize(docs.unionByName(empty), 50).select("doc_id", "features").cache()
    model = cluster.train_lda(vectors, 3, 10)
    rows = {r.doc_id: r.features.toArray() for r in vectors.collect()}
    counts = np.array([r.counts for r in lda.expected_counts(spark, model).orderBy("idx").collect()])
    assert counts.sum(axis=1) == pytest.approx(sum(rows.values()), abs=1e-6)
    alpha, eta = float(model.estimatedDocConcentration()[0]), checks.LDA_TOPIC_CONCENTRATION
    topics = ((counts + eta - 1) / (counts.sum(axis=0) + 50 * (eta - 1))).T
    for r in lda.fold_in(vectors, model, alpha, eta, 7).collect():
        mixture, loglik = brute_fold_in(rows[r.doc_id], topics, alpha, 7) if rows[r.doc_id].any() else (np.full(3, 1 / 3), 0.0)
        assert r.mixture == pytest.approx(mixture, abs=1e-9) and r.loglik == pytest.approx(loglik, abs=1e-6)
    own = model.transform(vectors).where("doc_id < 1000000").select("doc_id", vector_to_array("topicDistribution").alias("mixture"))
    right = checks.lda_holds(vectors, model, own).collect()
    assert len(right) == len(rows) - 1 and all(r.is_mixture and r.settled and r.loglik_holds for r in right)
    turned = own.select("doc_id", F.array(*[F.col("mixture")[k] for k in (1, 2, 0)]).alias("mixture"))
    wrong = checks.lda_holds(vectors, model, turned).collect()
    assert all(r.is_mixture for r in wrong) and not any(r.settled for r in wrong)


def test_vectors_of_counts(spark):
    counts = spark.createDataFrame([(1, 0, 2), (1, 3, 1), (2, 1, 5)], "doc_id bigint, bucket bigint, tf bigint")
    rows = {r.doc_id: r.features.toArray().tolist() for r in lda.vectors_of_counts(counts, 4).collect()}
    assert rows == {1: [2, 0, 0, 1], 2: [0, 5, 0, 0]}
