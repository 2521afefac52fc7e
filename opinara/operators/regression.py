"""Predicting how useful a text is: least squares, ridge, and plain gradient steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.text import NUM_FEATURES, packed_tf

# Gradient rounds, step size, ridge weight.
ITERATIONS = 12
STEP = 1.0
RIDGE = 0.01

# Where words outnumber texts the normal equations are singular and the library goes on with quasi-Newton steps on
# them, which stop at its defaults (100 rounds, 1e-6) far from the solution.
_MOST_STEPS = 10_000
_STEP_TOLERANCE = 1e-10


def _regression(weight: float) -> LinearRegression:
    return LinearRegression(
        maxIter=_MOST_STEPS,
        tol=_STEP_TOLERANCE,
        regParam=weight,
        elasticNetParam=0.0,
        fitIntercept=False,
        standardization=False,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
    )


def train_linear(labelled: DataFrame) -> LinearRegressionModel:
    """Least squares without intercept on (features, label)."""
    return _regression(0.0).fit(labelled)


def train_ridge(labelled: DataFrame, weight: float = RIDGE) -> LinearRegressionModel:
    """Ridge regression without intercept: half the mean squared error plus ``weight`` / 2 of the squared weights.

    The library divides its parameter by the labels' standard deviation (of the population), which is made up for here.
    Where all labels are the same number other than zero it has no ridge, and this raises.
    """
    deviation, mean = labelled.agg(F.stddev_pop("label"), F.avg("label")).first()
    if weight and mean and not deviation:
        raise ValueError("all labels are equal")
    deviation = deviation or 0.0
    return _regression(weight * deviation).fit(labelled)


def errors(predictions: DataFrame) -> DataFrame:
    """One row (mse, rmse) of (prediction, label) rows."""
    difference = F.col("prediction") - F.col("label")
    return predictions.agg(F.avg(difference * difference).alias("mse")).select("mse", F.sqrt("mse").alias("rmse"))


# -- gradient steps on hashed term frequencies ---------------------------------


@dataclass
class GradientModel:
    """Weights by bucket; their number is the fixed number of features."""

    weights: list[float]

    def _prediction(self) -> Column:
        weights = F.lit(np.array(self.weights))
        return F.aggregate(
            F.coalesce("terms", F.array().cast("array<struct<bucket:bigint,tf:bigint>>")),
            F.lit(0.0),
            lambda total, term: total
            + term["tf"]
            * F.coalesce(F.get(weights, term["bucket"].cast("int")), F.raise_error("a bucket has no weight").cast("double")),
        )

    def transform(self, packed: DataFrame) -> DataFrame:
        """Add ``prediction``; row-wise."""
        return packed.withColumn("prediction", self._prediction())

    def table(self, packed: DataFrame) -> DataFrame:
        """(bucket, weight)."""
        rows = list(enumerate(self.weights))
        return packed.sparkSession.createDataFrame(rows, "bucket bigint, weight double")


def train_by_gradient(
    packed: DataFrame,
    iterations: int = ITERATIONS,
    step: float = STEP,
    ridge: float = 0.0,
    num_features: int = NUM_FEATURES,
) -> GradientModel:
    """Full-batch steps of falling size on (terms, label) rows.

    A round predicts inside each row and sums the gradient by bucket; what is
    shuffled and returned is bounded by ``num_features``.
    """
    rows = packed.persist()
    count = rows.count()
    if not count:
        raise ValueError("there is nothing to train on")
    weights = [0.0] * num_features
    for round_number in range(1, iterations + 1):
        scored = GradientModel(weights).transform(rows).select(
            (F.col("prediction") - F.col("label")).alias("error"), F.explode("terms").alias("term")
        )
        gradient = (
            scored.groupBy(F.col("term.bucket").alias("bucket"))
            .agg((F.sum(F.col("error") * F.col("term.tf")) / F.lit(count)).alias("g"))
            .collect()
        )
        size = step / math.sqrt(round_number)
        weights = [w * (1.0 - size * ridge) for w in weights]
        for entry in gradient:
            weights[entry["bucket"]] -= size * entry["g"]
    rows.unpersist()
    return GradientModel(weights)


def predict_by_weights(docs: DataFrame, weights: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """(doc_id, prediction) of (doc_id, text) rows by a (bucket, weight) table of at most ``num_features`` rows.

    Documents without words, and buckets without a weight, count zero.
    Buckets beyond ``num_features``, given twice or NULL are errors.
    """
    legal = F.col("bucket").between(0, num_features - 1)
    seen = weights.agg(
        F.count("*").alias("rows"), F.count(F.when(legal, 1)).alias("legal"), F.countDistinct("bucket").alias("distinct")
    ).first()
    if not seen["rows"] == seen["legal"] == seen["distinct"]:
        raise ValueError(f"buckets of weights have to be in 0 .. {num_features - 1} and given once each")
    given = {row["bucket"]: row["weight"] for row in weights.collect()}
    model = GradientModel([float(given.get(bucket) or 0.0) for bucket in range(num_features)])
    scored = model.transform(packed_tf(docs, num_features)).select("doc_id", "prediction")
    return docs.select("doc_id").join(scored, "doc_id", "left").fillna({"prediction": 0.0})
