"""Saving and loading the usefulness models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import SparkSession

from opinara.sources.state import commit, committed

LINEAR = "linear"
RIDGE = "ridge"

Models = tuple[LinearRegressionModel, LinearRegressionModel]


def save_models(folder: str, models: Models) -> None:
    """Commit (linear, ridge); a failed write raises and leaves what was stored before.

    The pair is written aside, under a name of its own, and counts from the
    moment when the pointer names it, so a reader sees a whole pair: the old
    one or the new one.
    """
    spark = SparkSession.active()
    version = uuid.uuid4().hex
    for name, model in zip((LINEAR, RIDGE), models, strict=True):
        model.write().save(f"{folder}/{version}/{name}")
    commit(spark, folder, version)


def load_models(folder: str) -> Models:
    """The committed pair; without one this raises."""
    version = committed(SparkSession.active(), folder)
    if version is None:
        raise FileNotFoundError(f"no models are committed in {folder}")
    return tuple(LinearRegressionModel.load(f"{folder}/{version}/{name}") for name in (LINEAR, RIDGE))


def load_or_train(spark: SparkSession, folder: str, train: Callable[[], Models]) -> Models:
    """Load the committed pair if there is one, otherwise train and commit one; a half-written save does not count."""
    if committed(spark, folder) is not None:
        return load_models(folder)
    models = train()
    save_models(folder, models)
    return models
