"""The jobs a user runs: train on a business, observe its reviews, rank them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDAModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.cluster import KMeansFit, centroids, points_of, train_kmeans, train_lda
from opinara.operators.kmeans import CLUSTERS, ITERATIONS, KMeans, points_of_terms
from opinara.operators.ranking import closest_nth_points, furthest_nth_cluster, most_useful, most_useful_per
from opinara.operators.regression import errors, train_linear, train_ridge
from opinara.operators.selection import (
    MIN_REVIEW_COUNT,
    businesses_above,
    random_business,
    reviews_of,
    split,
    text_with_label,
)
from opinara.operators.text import NUM_FEATURES, add_terms, vectorize
from opinara.sources.state import store


def business_vectors(reviews: DataFrame, business_id: str) -> DataFrame:
    """The vectorised reviews of one business; none is an error."""
    vectors = vectorize(reviews_of(reviews, business_id))
    if vectors.isEmpty():
        raise ValueError(f"business {business_id} has no reviews")
    return vectors


@dataclass
class UsefulModels:
    linear: LinearRegressionModel
    ridge: LinearRegressionModel
    metrics: DataFrame

    def __iter__(self):
        return iter((self.linear, self.ridge))


def train_useful(reviews: DataFrame) -> UsefulModels:
    """Linear and ridge model on the training split, with (model, mse, rmse) on the test split."""
    vectors = vectorize(text_with_label(reviews)).select("doc_id", "features", F.col("label").cast("double").alias("label"))
    training, test = split(vectors)
    training = training.persist()
    linear, ridge = train_linear(training), train_ridge(training)
    training.unpersist()
    rows = [
        errors(model.transform(test)).select(F.lit(name).alias("model"), "mse", "rmse")
        for name, model in (("linear", linear), ("ridge", ridge))
    ]
    return UsefulModels(linear, ridge, rows[0].unionByName(rows[1]))


@dataclass
class BusinessModels:
    kmeans: KMeansFit
    lda: LDAModel
    useful: UsefulModels


def train_all(reviews: DataFrame, business_id: str, k: int = 5, seed: int = 0) -> BusinessModels:
    """K-means and topics on one business's reviews, usefulness on all of them."""
    vectors = business_vectors(reviews, business_id).select("doc_id", "features").persist()
    kmeans = train_kmeans(vectors, k, seed=seed)
    lda = train_lda(vectors, k, seed=seed)
    vectors.unpersist()
    return BusinessModels(kmeans, lda, train_useful(reviews))


def observe(
    reviews: DataFrame, business_id: str, kmeans: KMeansFit, useful: LinearRegressionModel
) -> DataFrame:
    """(doc_id, text, useful_pred, cluster_id) of each review of a business."""
    scored = useful.transform(business_vectors(reviews, business_id))
    return kmeans.transform(scored).select(
        "doc_id", "text", F.col("prediction").alias("useful_pred"), "cluster_id"
    )


def rank_instance(
    reviews: DataFrame,
    businesses: DataFrame,
    useful: LinearRegressionModel,
    minimum: int = MIN_REVIEW_COUNT,
    k: int = 5,
    seed: int = 0,
) -> DataFrame:
    """One ranking of a randomly drawn business.

    The most useful review, the cluster furthest from it, and the review
    closest to that cluster's center.
    """
    drawn = random_business(businesses_above(businesses, minimum), seed).first()
    if drawn is None:
        raise ValueError(f"no business has more than {minimum} reviews")
    vectors = business_vectors(reviews, drawn["business_id"]).persist()
    model = train_kmeans(vectors, k, seed=seed)
    centers = centroids(reviews.sparkSession, model)
    best = most_useful(useful.transform(vectors)).select("doc_id", "features", "prediction")
    furthest = furthest_nth_cluster(points_of(best), centers).withColumnRenamed("distance", "furthest_distance")
    closest = closest_nth_points(points_of(vectors), centers).select(
        "cluster_id", F.col("doc_id").alias("closest_doc_id"), F.col("distance").alias("closest_distance")
    )
    ranking = (
        best.select("doc_id", "prediction")
        .join(furthest, "doc_id")
        .join(closest, "cluster_id")
        .select(
            F.lit(drawn["business_id"]).alias("business_id"),
            F.col("doc_id").alias("most_useful_doc_id"),
            F.col("prediction").alias("useful_pred"),
            F.col("cluster_id").alias("furthest_cluster_id"),
            "furthest_distance",
            "closest_doc_id",
            "closest_distance",
        )
    )
    row = ranking.collect()  # one row
    vectors.unpersist()
    return reviews.sparkSession.createDataFrame(row, ranking.schema)


def rank_every(
    reviews: DataFrame,
    businesses: DataFrame,
    scored: DataFrame,
    minimum: int = MIN_REVIEW_COUNT,
    k: int = CLUSTERS,
    iterations: int = ITERATIONS,
    seed: int = 0,
    start: str = "parallel",
) -> DataFrame:
    """One ranking of every business with more than ``minimum`` reviews.

    All businesses are clustered in one set of rounds, a large one spread over
    all tasks.  ``scored`` has the prediction of each review (doc_id, prediction).
    """
    kept = reviews.select("doc_id", "business_id", "text").join(
        businesses_above(businesses, minimum).select("business_id"), "business_id", "left_semi"
    )
    packed = add_terms(kept.select("doc_id", "business_id"), kept.select("doc_id", "text"))
    found = KMeans(k, iterations, seed, start).fit(points_of_terms(packed, F.col("business_id")), NUM_FEATURES)
    owners = found.points.frame.select("doc_id", F.col("group_id").alias("business_id"))
    # One row a business, which three plans read.
    best = store(most_useful_per(owners.join(scored.select("doc_id", "prediction"), "doc_id"), "business_id"), "most_useful").frame
    far = found.furthest(best).select("group_id", "cluster_id", F.col("distance").alias("furthest_distance"))
    near = found.closest(far.select("group_id", "cluster_id"))
    return (
        best.join(far.withColumnRenamed("group_id", "business_id"), "business_id")
        .join(near.select(F.col("group_id").alias("business_id"), F.col("doc_id").alias("closest_doc_id"), "distance"), "business_id")
        .select(
            "business_id",
            F.col("doc_id").alias("most_useful_doc_id"),
            F.col("prediction").alias("useful_pred"),
            F.col("cluster_id").alias("furthest_cluster_id"),
            "furthest_distance",
            "closest_doc_id",
            F.col("distance").alias("closest_distance"),
        )
    )
