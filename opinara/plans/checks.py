"""What must hold of fitted models, computed from their real output by other formulas than their own.

Everything is a sum over the non-zero entries of the vectors, which meet the
weights of a model (one row per feature, bounded by the number of features).
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import LDAModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.numeric import add
from opinara.operators import lda
from opinara.operators.cluster import KMeansFit
from opinara.operators.text import vector_entries

#: Relative to the numbers compared.
TOLERANCE = 1e-6
#: The solvers stop when a step gains this little.
GRADIENT_TOLERANCE = 1e-4
#: The library ends the inference of a text when its counts by topic move by less on average.
LDA_STEP = 1e-3
#: Fixed value: the library's smoothing of topics in expectation maximisation.
LDA_TOPIC_CONCENTRATION = 1.1
#: Between counts of the last round and settled ones.
LIKELIHOOD_TOLERANCE = 0.02


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * (F.lit(1.0) + F.abs(b))


def _weights(frame: DataFrame, columns: list[list[float]]) -> DataFrame:
    """(idx, w0..): one row per feature."""
    rows = [(idx, *map(float, values)) for idx, values in enumerate(zip(*columns))]
    return frame.sparkSession.createDataFrame(rows, "idx int, " + ", ".join(f"w{k} double" for k in range(len(columns))))


def products(vectors: DataFrame, columns: list[list[float]]) -> DataFrame:
    """(doc_id, norm, w0..): the squared length of each vector and its products with some others."""
    met = vector_entries(vectors).join(F.broadcast(_weights(vectors, columns)), "idx")
    names = [f"w{k}" for k in range(len(columns))]
    sums = met.groupBy("doc_id").agg(
        F.sum(F.col("value") * F.col("value")).alias("norm"), *[F.sum(F.col("value") * F.col(w)).alias(w) for w in names]
    )
    return vectors.select("doc_id").join(sums, "doc_id", "left").fillna(0.0, ["norm", *names])


def predictions(vectors: DataFrame, model: LinearRegressionModel) -> DataFrame:
    """(doc_id, expected): the model's prediction as a sum over entries."""
    return products(vectors, [list(model.coefficients)]).select("doc_id", F.col("w0").alias("expected"))


def center_distances(vectors: DataFrame, model: KMeansFit) -> DataFrame:
    """(doc_id, distances): squared distances by cluster id, as |x|² - 2 x·c + |c|²."""
    found = model.centers()
    distances = [
        F.col("norm") - 2 * F.col(f"w{k}") + F.lit(sum(v * v for v in center)) for k, center in enumerate(found)
    ]
    return products(vectors, found).select("doc_id", F.array(*distances).alias("distances"))


def cost_holds(distances: DataFrame, model: KMeansFit) -> bool:
    """Is the stated cost that of the centers?"""
    total = distances.agg(F.sum(F.array_min("distances"))).first()[0] or 0.0
    return math.isclose(total, model.cost, rel_tol=TOLERANCE, abs_tol=TOLERANCE)


def clusters(vectors: DataFrame, assigned: DataFrame, model: KMeansFit) -> DataFrame:
    """(doc_id, nearest, cost_holds): is the assigned cluster the nearest one, does the stated cost hold?"""
    distances = center_distances(vectors, model)
    own = F.get("distances", F.col("cluster_id"))
    least = F.array_min("distances")
    return assigned.select("doc_id", "cluster_id").join(distances, "doc_id").select(
        "doc_id",
        (own <= least + TOLERANCE * (1 + F.abs(least))).alias("nearest"),
        F.lit(cost_holds(distances, model)).alias("cost_holds"),
    )


def stationary(training: DataFrame, model: LinearRegressionModel, ridge: float) -> DataFrame:
    """(bucket, stationary): is the gradient of the loss zero at the solution?"""
    residuals = training.join(predictions(training, model), "doc_id").select(
        "doc_id", (F.col("expected") - F.col("label")).alias("error")
    )
    count = training.count()
    slopes = (
        vector_entries(training)
        .join(residuals, "doc_id")
        .groupBy("idx")
        .agg((F.sum(F.col("error") * F.col("value")) / F.lit(count)).alias("slope"))
    )
    weights = _weights(training, [list(model.coefficients)])
    gradient = F.coalesce("slope", F.lit(0.0)) + F.lit(ridge) * F.col("w0")
    return weights.join(slopes, "idx", "left").select(
        F.col("idx").cast("bigint").alias("bucket"), (F.abs(gradient) <= GRADIENT_TOLERANCE).alias("stationary")
    )


def metrics(scored: DataFrame, stated: DataFrame, name: str) -> DataFrame:
    """(model, mse_holds, rmse_holds) from (label, expected) rows against the stated errors of a model."""
    p, y = F.col("expected"), F.col("label")
    again = scored.agg(((F.sum(p * p) - 2 * F.sum(p * y) + F.sum(y * y)) / F.count("*")).alias("again"))
    return stated.where(F.col("model") == name).select(
        "model",
        close(again.scalar(), F.col("mse")).alias("mse_holds"),
        close(F.col("rmse") * F.col("rmse"), F.col("mse")).alias("rmse_holds"),
    )


def mixture(columns: list[Column]) -> Column:
    """Are these the shares of a whole?"""
    return close(add(columns), F.lit(1.0)) & (F.least(*columns) >= 0)


def likelihood_holds(vectors: DataFrame, model: LDAModel) -> bool:
    """Does the stated likelihood of the training texts follow from the topics and the texts?

    The library states it with the texts' counts of its last round; here they
    have settled under the topics, so the two are close and not equal.
    """
    alpha = float(model.estimatedDocConcentration()[0])
    again = lda.fold_in(vectors, model, alpha, LDA_TOPIC_CONCENTRATION).agg(F.sum("loglik")).first()[0] or 0.0
    return math.isclose(again, model.trainingLogLikelihood(), rel_tol=LIKELIHOOD_TOLERANCE)


def lda_holds(vectors: DataFrame, model: LDAModel, mixtures: DataFrame) -> DataFrame:
    """(doc_id, is_mixture, settled, loglik_holds) of the (doc_id, mixture) rows that the model gives."""
    topics = len(model.estimatedDocConcentration())
    steps = lda.variational_step(vectors, model, mixtures)
    change = F.aggregate(F.zip_with("before", "after", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda total, x: total + x)
    return mixtures.join(steps, "doc_id").select(
        "doc_id",
        mixture([F.col("mixture")[k] for k in range(topics)]).alias("is_mixture"),
        (change / F.lit(topics) <= LDA_STEP).alias("settled"),
        F.lit(likelihood_holds(vectors, model)).alias("loglik_holds"),
    )
