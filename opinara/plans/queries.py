"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.numeric import add
from opinara.functions.text import hash_unit
from opinara.operators import cluster, corpus, kmeans, lda, ranking, regression, selection, text
from opinara.operators.priors import Decorrelation, Prior, SymmetricDirichlet
from opinara.operators.robust import RobustPlsa
from opinara.operators.topics import Plsa, TopicModel, initial_phi
from opinara.plans import checks, experiments
from opinara.sources import models
from opinara.sources.readers import name_view, read_reviews, read_table, scan_reviews
from opinara.sources.state import new_path, store

TOPICS = 5
ROUNDS = 2
BUSINESS = "src3"
THETA_ALPHA = 0.5
PHI_ALPHA = 0.8
PULL = 10.0
PUSH = 10_000.0
DECORRELATION = 1e9
#: So small that the given centers are many blocks.
CENTER_BYTES = 1 << 14

#: Of two gradient steps, and of twelve, where texts of thousands of words make longer ones diverge.
STEP, SHORT_STEP = 0.001, 0.00001

THETA_DIGITS = 6
PHI_DIGITS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- the given tables as reviews and businesses -----------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", "text")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, business_id, text, votes); votes.useful is NULL where there is no label."""
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").cast("bigint").alias("useful"))
    return (
        documents(spark, folder)
        .join(labels, "doc_id", "left")
        .select("doc_id", F.col("source").alias("business_id"), "text", F.struct("useful").alias("votes"))
    )


def plain_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.col("source").alias("business_id"), "text")


def businesses(spark: SparkSession, folder: str) -> DataFrame:
    return selection.review_counts(plain_reviews(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    return documents(spark, folder).join(labels, "doc_id").select("doc_id", "text", "label")


def points(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("point"))


def centers(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector per label; the partial means keep a large label out of any single task."""
    entries = read_table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("idx", "value"))
    means = entries.groupBy("label", "idx").agg(F.avg(F.col("value").cast("double")).alias("value"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("entries"))
    return packed.select(F.col("label").cast("bigint").alias("cluster_id"), F.col("entries.value").alias("center"))


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


# -- sources ---------------------------------------------------------------------


@query
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder)


@query
def scan_json_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written as JSON lines and read back through the reader and its view."""
    path = new_path(spark, "reviews-json")
    reviews(spark, folder).write.json(path)
    read_reviews(spark, path, view="review")
    return spark.sql("SELECT doc_id, business_id, text, coalesce(votes.useful, 0) AS useful FROM review")


@query
def scan_broken_json(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of reviews, of which some are cut short, some name no id and some are no objects: what is read and what is rescued."""
    path = new_path(spark, "broken-json")
    line = F.to_json(F.struct("doc_id", "business_id", "text"))
    anonymous = F.to_json(F.struct("business_id", "text"))
    number = F.col("doc_id")
    broken = (
        F.when(number % 7 == 0, F.substring(line, 1, 20))
        .when(number % 11 == 0, F.concat(F.lit("["), number.cast("string"), F.lit("]")))
        .when(number % 5 == 0, anonymous)
        .otherwise(line)
    )
    plain_reviews(spark, folder).select(broken.alias("value")).write.text(path)
    scanned = scan_reviews(spark, path)
    first = scanned.reviews.agg(F.min("doc_id")).first()[0]
    read = scanned.reviews.select(
        F.lit("review").alias("kind"), F.when(F.col("given"), F.col("doc_id")).alias("doc_id"), "business_id", "text", (F.col("doc_id") >= first).alias("numbered")
    )
    rescued = scanned.rejected.select(
        F.lit("rejected").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("business_id"), F.col("line").alias("text"), F.lit(False).alias("numbered")
    )
    return read.unionByName(rescued)


@query
def reviews_without_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers given to lines without an id: as many, each once, above those that lines have."""
    path = new_path(spark, "mixed-json")
    number = F.col("doc_id")
    mixed = F.when(number % 3 == 0, F.to_json(F.struct("business_id", "text"))).otherwise(F.to_json(F.struct("doc_id", "business_id", "text")))
    plain_reviews(spark, folder).select(mixed.alias("value")).write.text(path)
    read = scan_reviews(spark, path).reviews
    return read.groupBy("given").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("different"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )


@query
def save_load_model(spark: SparkSession, folder: str) -> DataFrame:
    """Do the stored models predict what the trained ones do, and what their weights say?"""
    frame = reviews(spark, folder)
    path = new_path(spark, "models")
    trained: list[models.Models] = []

    def train() -> models.Models:
        trained.append(tuple(experiments.train_useful(frame)))
        return trained[-1]

    models.load_or_train(spark, path, train)
    loaded = models.load_or_train(spark, path, train)
    vectors = text.vectorize(texts(spark, folder)).select("doc_id", "features")
    scored = vectors
    for name, pair in (("trained", trained[0]), ("loaded", loaded)):
        for kind, model in zip(("linear", "ridge"), pair):
            scored = model.transform(scored).withColumnRenamed("prediction", f"{name}_{kind}")
    for kind, model in zip(("linear", "ridge"), loaded):
        expected = checks.predictions(vectors, model).withColumnRenamed("expected", f"expected_{kind}")
        scored = scored.join(expected, "doc_id")
    return scored.select(
        "doc_id",
        *[
            ((F.col(f"trained_{k}") == F.col(f"loaded_{k}")) & checks.close(F.col(f"loaded_{k}"), F.col(f"expected_{k}"))).alias(f"{k}_same")
            for k in ("linear", "ridge")
        ],
    )


# -- selection -------------------------------------------------------------------


@query
def reviews_of_business(spark: SparkSession, folder: str) -> DataFrame:
    return selection.reviews_of(plain_reviews(spark, folder), BUSINESS)


@query
def reviews_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a named view, the id bound as a parameter."""
    name_view(plain_reviews(spark, folder), "review")
    return spark.sql("SELECT r.doc_id, r.text FROM review r WHERE r.business_id = :id", args={"id": BUSINESS})


@query
def text_with_label(spark: SparkSession, folder: str) -> DataFrame:
    return selection.text_with_label(reviews(spark, folder))


@query
def business_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.businesses_above(businesses(spark, folder))


@query
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    training, test = selection.split(texts(spark, folder).select("doc_id"))
    return training.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def random_business(spark: SparkSession, folder: str) -> DataFrame:
    return selection.random_business(selection.businesses_above(businesses(spark, folder), 5))


@query
def random_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return selection.random_review_per(plain_reviews(spark, folder))


@query
def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    return selection.row_ids(texts(spark, folder).select("doc_id"))


# -- text ------------------------------------------------------------------------


@query
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return text.token_rows(texts(spark, folder))


@query
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return text.token_counts(texts(spark, folder))


@query
def hashed_tf(spark: SparkSession, folder: str) -> DataFrame:
    return text.hashed_tf(texts(spark, folder))


@query
def vectorize(spark: SparkSession, folder: str) -> DataFrame:
    entries = text.vector_entries(text.vectorize(texts(spark, folder)))
    return entries.groupBy("doc_id").agg(F.sum("value").cast("bigint").alias("n_words"))


@query
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.build_vocabulary(text.frequent_tokens(texts(spark, folder))).frame


@query
def bag_of_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder)
    return corpus.bag_of_words(docs, corpus.build_vocabulary(text.frequent_tokens(docs)))


@query
def document_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.build_corpus(texts(spark, folder)).documents


@query
def collection_stats(spark: SparkSession, folder: str) -> DataFrame:
    built = corpus.build_corpus(texts(spark, folder))
    return built.documents.agg(
        F.count("*").alias("documents"),
        F.sum("length").alias("collection_length"),
        F.lit(built.vocabulary.size).cast("bigint").alias("alphabet_size"),
    )


# -- topic models ------------------------------------------------------------------


def fitted(spark: SparkSession, folder: str, trainer: Plsa) -> TopicModel:
    """A model of all documents; the corpus goes once the model stands on its own tables."""
    built = corpus.build_corpus(texts(spark, folder))
    model = trainer.fit(built)
    built.drop()
    return model


def plsa(**settings) -> Plsa:
    return Plsa(TOPICS, ROUNDS, **{"perplexity": False, **settings})


def robust(**settings) -> RobustPlsa:
    return RobustPlsa(TOPICS, ROUNDS, **{"perplexity": False, **settings})


def theta_columns(frame: DataFrame) -> DataFrame:
    return rounded(frame, THETA_DIGITS, *[f"t{k}" for k in range(TOPICS)])


def phi_columns(frame: DataFrame) -> DataFrame:
    return rounded(frame, PHI_DIGITS, *[f"p{k}" for k in range(TOPICS)])


@query
def plsa_init(spark: SparkSession, folder: str) -> DataFrame:
    words = corpus.build_vocabulary(text.frequent_tokens(texts(spark, folder)))
    phi = initial_phi(words, TOPICS)
    return phi_columns(phi.join(words.frame.select("word_id", "token"), "word_id").drop("word_id"))


@query
def plsa_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, plsa()).theta)


@query
def plsa_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, plsa()).phi)


@query
def plsa_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fitted(spark, folder, plsa(perplexity=True)).perplexity, 4, "perplexity")


@query
def doc_loglik(spark: SparkSession, folder: str) -> DataFrame:
    built = corpus.build_corpus(texts(spark, folder))
    return rounded(plsa().fit(built).log_likelihood(built), 4, "loglik")


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not among the documents."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query
def plsa_fold_in(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, plsa()).transform(new_texts(spark, folder)).theta)


@query
def robust_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, robust()).theta)


@query
def robust_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, robust()).phi)


@query
def robust_background(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fitted(spark, folder, robust()).background, PHI_DIGITS, "bg")


@query
def robust_noise(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fitted(spark, folder, robust()).noise, THETA_DIGITS, "noise")


@query
def robust_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fitted(spark, folder, robust(perplexity=True)).perplexity, 4, "perplexity")


@query
def robust_doc_loglik(spark: SparkSession, folder: str) -> DataFrame:
    built = corpus.build_corpus(texts(spark, folder))
    return rounded(robust().fit(built).log_likelihood(built), 4, "loglik")


@query
def plsa_fold_in_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    folded = fitted(spark, folder, plsa(perplexity=True)).transform(new_texts(spark, folder))
    return rounded(folded.perplexity, 4, "perplexity")


@query
def robust_fold_in_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    folded = fitted(spark, folder, robust(perplexity=True)).transform(new_texts(spark, folder))
    return rounded(folded.perplexity, 4, "perplexity")


@query
def robust_fold_in(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, robust()).transform(new_texts(spark, folder)).theta)


@query
def robust_fold_in_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, robust()).transform(new_texts(spark, folder), "fixed").theta)


def dirichlet() -> dict[str, Prior]:
    return {"theta_prior": SymmetricDirichlet(THETA_ALPHA), "phi_prior": SymmetricDirichlet(PHI_ALPHA)}


@query
def regularized_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, plsa(**dirichlet())).theta)


@query
def regularized_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, plsa(**dirichlet())).phi)


@query
def regularized_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    model = fitted(spark, folder, plsa(perplexity=True, **dirichlet()))
    return rounded(model.perplexity, 4, "perplexity")


@query
def robust_regularized_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, robust(**dirichlet())).theta)


@query
def robust_regularized_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, robust(**dirichlet())).phi)


@query
def robust_regularized_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    model = fitted(spark, folder, robust(perplexity=True, **dirichlet()))
    return rounded(model.perplexity, 4, "perplexity")


@query
def dirichlet_log_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Log density of each document's mixture."""
    model = fitted(spark, folder, plsa(**dirichlet()))
    density = SymmetricDirichlet(THETA_ALPHA).log_prior([F.col(f"t{k}") for k in range(TOPICS)])
    return model.theta.select("doc_id", F.round(density, 4).alias("log_prior"))


@query
def phi_log_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Log density of each topic's words."""
    model = fitted(spark, folder, plsa(**dirichlet()))
    prior = SymmetricDirichlet(PHI_ALPHA)
    constant = prior.log_constant(model.vocabulary.size)
    sums = model.phi.agg(*[F.sum(prior.log_term(F.col(f"p{k}"))).alias(f"s{k}") for k in range(TOPICS)])
    return sums.select(*[F.round(F.col(f"s{k}") + constant, 4).alias(f"log_prior{k}") for k in range(TOPICS)])


class Pull(Prior):
    """A prior of one's own: pulls each document towards its previous mixture."""

    def regularize(self, count: Column, old: Column) -> Column:
        return super().regularize(count + F.lit(PULL) * old, old)


@query
def custom_prior_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, plsa(theta_prior=Pull())).theta)


class Push(Prior):
    """A prior over the whole row: takes from a word's count what it shares with the other topics."""

    def regularize_all(self, counts: list[Column], olds: list[Column]) -> list[Column]:
        total = add(olds)
        return [F.greatest(F.lit(0.0), c - F.lit(PUSH) * old * (total - old)) for c, old in zip(counts, olds)]


@query
def custom_prior_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, plsa(phi_prior=Push())).phi)


@query
def matrix_prior_phi(spark: SparkSession, folder: str) -> DataFrame:
    """A prior over the whole matrix: topics lose the more, the more they overlap over all words."""
    return phi_columns(fitted(spark, folder, plsa(phi_prior=Decorrelation(DECORRELATION))).phi)


@query
def matrix_prior_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    model = fitted(spark, folder, plsa(perplexity=True, phi_prior=Decorrelation(DECORRELATION)))
    return rounded(model.perplexity, 4, "perplexity")


@query
def robust_matrix_prior_phi(spark: SparkSession, folder: str) -> DataFrame:
    return phi_columns(fitted(spark, folder, robust(phi_prior=Decorrelation(DECORRELATION))).phi)


class Share(Prior):
    """A prior over all mixtures: each topic's counts are damped by the part of all counts that it has."""

    def matrix_sums(self, counts: list[Column], olds: list[Column]) -> dict[str, Column]:
        return {f"n{k}": F.sum(c) for k, c in enumerate(counts)}

    def regularize_matrix(self, counts: list[Column], olds: list[Column], sums: dict[str, float]) -> list[Column]:
        total = math.fsum(sums.values()) or 1.0
        return [c * F.lit(1.0 - sums[f"n{k}"] / total) for k, c in enumerate(counts)]


@query
def matrix_prior_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_columns(fitted(spark, folder, plsa(theta_prior=Share())).theta)


# -- ranking -----------------------------------------------------------------------


def _distance(frame: DataFrame) -> DataFrame:
    return rounded(frame, 6, "distance")


@query
def center_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.center_distances(points(spark, folder), centers(spark, folder)))


@query
def furthest_nth_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.furthest_nth_cluster(points(spark, folder), centers(spark, folder), 2))


@query
def furthest_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.furthest_nth_cluster(points(spark, folder), centers(spark, folder)))


@query
def closest_nth_point(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.closest_nth_points(points(spark, folder), centers(spark, folder), 3))


@query
def closest_point(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.closest_nth_points(points(spark, folder), centers(spark, folder)))


@query
def closest_nth_point_to_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.closest_nth_point(points(spark, folder), centers(spark, folder), 4, 2))


@query
def assign_given_centers(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.nearest_center(points(spark, folder), centers(spark, folder)))


def many_centers(spark: SparkSession, folder: str) -> DataFrame:
    """Every second vector as a center of its own."""
    return points(spark, folder).where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("cluster_id"), F.col("point").alias("center"))


def other_points(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).where(F.col("doc_id") % 2 == 1)


@query
def nearest_of_many_centers(spark: SparkSession, folder: str) -> DataFrame:
    """Centers that are a table of blocks; points meet those that the triangle inequality leaves."""
    return _distance(ranking.nearest_center(other_points(spark, folder), many_centers(spark, folder), CENTER_BYTES))


@query
def furthest_nth_of_many_centers(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.furthest_nth_cluster(other_points(spark, folder), many_centers(spark, folder), 2, CENTER_BYTES))


@query
def closest_nth_of_many_centers(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.closest_nth_points(other_points(spark, folder), many_centers(spark, folder), 3, CENTER_BYTES))


def broken_points(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors, some of them missing, cut short, or with a component that is missing or no number."""
    whole, n = F.col("point"), F.col("doc_id")
    broken = (
        F.when(n % 11 == 0, F.lit(None))
        .when(n % 13 == 0, F.slice(whole, 1, 7))
        .when(n % 17 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(whole, 2, 100)))
        .when(n % 19 == 0, F.concat(F.array(F.lit(None)), F.slice(whole, 2, 100)))
        .otherwise(whole)
    )
    return points(spark, folder).select("doc_id", broken.cast("array<float>").alias("point"))


@query
def assign_usable_points(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(ranking.nearest_center(broken_points(spark, folder), centers(spark, folder)))


@query
def wssse_usable_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.within_set_error(broken_points(spark, folder), centers(spark, folder)), 6, "wssse")


@query
def wssse_given_centers(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.within_set_error(points(spark, folder), centers(spark, folder)), 6, "wssse")


def weights(spark: SparkSession) -> DataFrame:
    """(bucket, weight): given weights, drawn by hash."""
    buckets = spark.range(text.NUM_FEATURES).withColumnRenamed("id", "bucket")
    return buckets.select("bucket", (hash_unit(F.col("bucket").cast("string")) - 0.5).alias("weight"))


@query
def predict_given_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(regression.predict_by_weights(texts(spark, folder), weights(spark)), 6, "prediction")


@query
def most_useful(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.most_useful(predict_given_weights(spark, folder), 10)


@query
def most_useful_half(spark: SparkSession, folder: str) -> DataFrame:
    """Half of all reviews by score: more than one task should have."""
    scored = store(predict_given_weights(spark, folder), "scored").frame  # counted, sampled and sorted
    return ranking.most_useful(scored, scored.count() // 2, top_rows=100)


@query
def random_fifth(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly a fifth of the businesses, rounded up, and of the reviews."""
    shares = [
        selection.random_share(rows, key, 0.2).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
        for kind, rows, key in (("business", businesses(spark, folder), "business_id"), ("review", texts(spark, folder), "doc_id"))
    ]
    return shares[0].unionByName(shares[1])


@query
def most_useful_per_business(spark: SparkSession, folder: str) -> DataFrame:
    scored = predict_given_weights(spark, folder).join(
        plain_reviews(spark, folder).select("doc_id", "business_id"), "doc_id"
    )
    return ranking.most_useful_per(scored, "business_id")


@query
def rmse_mse(spark: SparkSession, folder: str) -> DataFrame:
    frame = labelled(spark, folder).select("doc_id", "label")
    scored = regression.predict_by_weights(texts(spark, folder), weights(spark))
    return rounded(regression.errors(scored.join(frame, "doc_id")), 6, "mse", "rmse")


def _gradient_weights(spark: SparkSession, folder: str, rounds: int, step: float) -> DataFrame:
    """(model, bucket, weight) after as many plain and ridge steps."""
    frame = labelled(spark, folder)
    packed = text.add_terms(frame.select("doc_id", "label"), frame)
    tables = [
        regression.train_by_gradient(packed, rounds, step=step, ridge=ridge)
        .table(packed)
        .select(F.lit(name).alias("model"), "bucket", F.round("weight", 8).alias("weight"))
        for name, ridge in (("linear", 0.0), ("ridge", regression.RIDGE))
    ]
    return tables[0].unionByName(tables[1])


@query
def gd_two_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _gradient_weights(spark, folder, 2, STEP)


@query
def gd_twelve_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _gradient_weights(spark, folder, regression.ITERATIONS, SHORT_STEP)


# -- clustering and regression by the ML library -----------------------------------------
#
# What a solver finds cannot be said in SQL.  The functions ``*_rows`` give the models' output; the queries
# say per row what must hold of it, by the formulas of ``checks``.


def business_features(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.business_vectors(plain_reviews(spark, folder), BUSINESS).select("doc_id", "features")


def kmeans_reviews_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, cluster_id, wssse) of the reviews of a business."""
    vectors = business_features(spark, folder)
    model = cluster.train_kmeans(vectors)
    return model.transform(vectors).select("doc_id", "cluster_id", F.lit(model.cost).alias("wssse"))


@query
def kmeans_reviews(spark: SparkSession, folder: str) -> DataFrame:
    vectors = business_features(spark, folder)
    model = cluster.train_kmeans(vectors)
    return checks.clusters(vectors, model.transform(vectors), model)


@query
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Centers as a table: does the model put each into its own cluster, is the table the model's?"""
    model = cluster.train_kmeans(business_features(spark, folder))
    table = cluster.centroids(spark, model)
    vectors = table.select(F.col("cluster_id").alias("doc_id"), array_to_vector("center").alias("features"))
    distances = checks.center_distances(vectors, model)
    zero = F.get("distances", F.col("doc_id").cast("int")) <= checks.TOLERANCE * (1 + F.array_max("distances"))
    return (
        model.transform(vectors)
        .join(distances, "doc_id")
        .join(table.select(F.col("cluster_id").alias("doc_id"), F.size("center").alias("width")), "doc_id")
        .select(F.col("doc_id").alias("center_id"), "width", ((F.col("cluster_id") == F.col("doc_id")) & zero).alias("own"))
    )


# The same rounds by hashed frequencies and hash-drawn starts, which SQL can follow value by value.


def grouped_points(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed term frequencies of all reviews, grouped by business."""
    owners = plain_reviews(spark, folder).select("doc_id", "business_id")
    packed = text.add_terms(owners, texts(spark, folder))
    return kmeans.points_of_terms(packed, F.col("business_id"))


def _clustered(spark: SparkSession, folder: str) -> kmeans.Clustering:
    return kmeans.KMeans(cluster.CLUSTERS, ROUNDS, start="hash").fit(grouped_points(spark, folder), text.NUM_FEATURES)


@query
def kmeans_every_business(spark: SparkSession, folder: str) -> DataFrame:
    """The clusterings of all businesses after two rounds: each review's cluster and its distance."""
    placed = _clustered(spark, folder).assigned().withColumnRenamed("group_id", "business_id")
    return rounded(placed, 6, "distance")


@query
def kmeans_every_center(spark: SparkSession, folder: str) -> DataFrame:
    """The non-zero components of all their centers."""
    parts = _clustered(spark, folder).centers.select("group_id", "cluster_id", F.posexplode("center").alias("bucket", "value"))
    return parts.where("value <> 0").select(
        F.col("group_id").alias("business_id"), "cluster_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 8).alias("value")
    )


@query
def kmeans_parallel_draws(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews that the parallel start draws for each business, and how many are nearest to each."""
    means = kmeans.KMeans(cluster.CLUSTERS)
    held = means.prepare(grouped_points(spark, folder), text.NUM_FEATURES)
    return means.drawn(held).select(F.col("group_id").alias("business_id"), "doc_id", "place", "weight")


@query
def rank_every_business(spark: SparkSession, folder: str) -> DataFrame:
    """For each business: its most useful review, the cluster furthest from it, the review closest to that cluster."""
    scored = predict_given_weights(spark, folder)
    ranked = experiments.rank_every(
        plain_reviews(spark, folder), businesses(spark, folder), scored, minimum=5, iterations=ROUNDS, start="hash"
    )
    return rounded(ranked, 6, "furthest_distance", "closest_distance")


def lda_reviews_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, t0..): topic mixtures of the reviews of a business."""
    vectors = business_features(spark, folder)
    model = cluster.train_lda(vectors)
    mixture = vector_to_array("topicDistribution")
    return model.transform(vectors).select("doc_id", *[mixture[k].alias(f"t{k}") for k in range(TOPICS)])


@query
def lda_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Are the mixtures shares that a step of the model leaves alone, does the likelihood follow from topics and texts?"""
    vectors = business_features(spark, folder)
    model = cluster.train_lda(vectors)
    mixture = vector_to_array("topicDistribution").alias("mixture")
    return checks.lda_holds(vectors, model, model.transform(vectors).select("doc_id", mixture))


@query
def lda_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often a fitted LDA model expects each bucket of words in the reviews of a business, over all its topics."""
    counts = text.hashed_tf(selection.reviews_of(plain_reviews(spark, folder), BUSINESS))
    model = cluster.train_lda(lda.vectors_of_counts(counts, text.NUM_FEATURES), iterations=ROUNDS)
    expected = lda.expected_counts(spark, model).select("idx", F.aggregate("counts", F.lit(0.0), lambda total, n: total + n).alias("n"))
    return expected.where("n > 0").select(F.col("idx").cast("bigint").alias("bucket"), F.round("n", 4).alias("n"))


def useful_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = text.vectorize(labelled(spark, folder))
    return selection.split(vectors.select("doc_id", "features", F.col("label").cast("double").alias("label")))


@query
def linear_useful(spark: SparkSession, folder: str) -> DataFrame:
    training, _ = useful_vectors(spark, folder)
    return checks.stationary(training, regression.train_linear(training), 0.0)


@query
def ridge_useful(spark: SparkSession, folder: str) -> DataFrame:
    training, _ = useful_vectors(spark, folder)
    return checks.stationary(training, regression.train_ridge(training), regression.RIDGE)


def _metrics_hold(spark: SparkSession, folder: str, trained: experiments.UsefulModels) -> DataFrame:
    _, test = useful_vectors(spark, folder)
    parts = []
    for name, model in zip(("linear", "ridge"), trained):
        scored = test.join(checks.predictions(test, model), "doc_id").select("label", "expected")
        parts.append(checks.metrics(scored, trained.metrics, name))
    return parts[0].unionByName(parts[1])


@query
def useful_models(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics_hold(spark, folder, experiments.train_useful(reviews(spark, folder)))


# -- whole experiments ---------------------------------------------------------------


@query
def train_all(spark: SparkSession, folder: str) -> DataFrame:
    """Training cost, topic likelihood and test errors of the three models of a business."""
    trained = experiments.train_all(reviews(spark, folder), BUSINESS)
    distances = checks.center_distances(business_features(spark, folder), trained.kmeans)
    return _metrics_hold(spark, folder, trained.useful).withColumns(
        {
            "cost_holds": F.lit(checks.cost_holds(distances, trained.kmeans)),
            "loglik_holds": F.lit(checks.likelihood_holds(business_features(spark, folder), trained.lda)),
        }
    )


@query
def observe(spark: SparkSession, folder: str) -> DataFrame:
    """Each review of a business with its text: predicted by the weights, and in the nearest cluster?"""
    vectors = business_features(spark, folder)
    means = cluster.train_kmeans(vectors)
    ridge = experiments.train_useful(reviews(spark, folder)).ridge
    seen = experiments.observe(plain_reviews(spark, folder), BUSINESS, means, ridge)
    placed = checks.clusters(vectors, seen, means)
    return (
        seen.join(placed, "doc_id")
        .join(checks.predictions(vectors, ridge), "doc_id")
        .select("doc_id", "text", checks.close(F.col("useful_pred"), F.col("expected")).alias("pred_holds"), "nearest")
    )


@query
def rank_instance(spark: SparkSession, folder: str) -> DataFrame:
    """The business drawn; are the three choices the best by plain comparison with all its reviews?"""
    linear = experiments.train_useful(reviews(spark, folder)).linear
    row = experiments.rank_instance(plain_reviews(spark, folder), businesses(spark, folder), linear, minimum=5).first()
    vectors = experiments.business_vectors(plain_reviews(spark, folder), row["business_id"]).select("doc_id", "features")
    means = cluster.train_kmeans(vectors)
    to_chosen = F.get("distances", F.lit(row["furthest_cluster_id"]).cast("int"))
    facts = checks.center_distances(vectors, means).join(checks.predictions(vectors, linear), "doc_id")
    best, closest = F.col("doc_id") == row["most_useful_doc_id"], F.col("doc_id") == row["closest_doc_id"]
    all_of = facts.agg(
        F.max("expected").alias("most"),
        F.max(F.when(best, F.col("expected"))).alias("own"),
        F.max(F.when(best, F.array_max("distances"))).alias("furthest"),
        F.max(F.when(best, to_chosen)).alias("own_furthest"),
        F.min(to_chosen).alias("closest"),
        F.max(F.when(closest, to_chosen)).alias("own_closest"),
    )
    return all_of.select(
        F.lit(row["business_id"]).alias("business_id"),
        checks.close(F.col("own"), F.col("most")).alias("best_holds"),
        checks.close(F.col("own_furthest"), F.col("furthest")).alias("furthest_holds"),
        checks.close(F.col("own_closest"), F.col("closest")).alias("closest_holds"),
    )


def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.add_tfidf(text.vectorize(texts(spark, folder)).select("doc_id", "features"))


def kmeans_tfidf_rows(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tfidf_vectors(spark, folder)
    return cluster.train_kmeans(vectors).transform(vectors).select("doc_id", "cluster_id")


@query
def kmeans_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tfidf_vectors(spark, folder)
    model = cluster.train_kmeans(vectors)
    return checks.clusters(vectors, model.transform(vectors), model)


@query
def kmeans_theta(spark: SparkSession, folder: str) -> DataFrame:
    theta = fitted(spark, folder, plsa()).theta
    assembler = VectorAssembler(inputCols=[f"t{k}" for k in range(TOPICS)], outputCol="features")
    vectors = assembler.transform(theta)
    model = cluster.train_kmeans(vectors)
    return checks.clusters(vectors, model.transform(vectors), model)
