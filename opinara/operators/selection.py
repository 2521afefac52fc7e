"""Selecting, projecting, splitting and sampling reviews and businesses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import hash32, hash_bucket, hash_unit
from opinara.operators.rowids import first_rows, number_rows

# Least review count (exclusive), training percentage.
MIN_REVIEW_COUNT = 15
TRAIN_PERCENT = 70


def reviews_of(reviews: DataFrame, business_id: str) -> DataFrame:
    """The (doc_id, text) rows of one business; the filter reaches the scan."""
    if not business_id:
        raise ValueError("a business id is required")
    return reviews.where(F.col("business_id") == F.lit(business_id)).select("doc_id", "text")


def text_with_label(reviews: DataFrame) -> DataFrame:
    """(doc_id, text, label): the nested count of useful votes as label, where there is one."""
    labelled = reviews.select("doc_id", "text", F.col("votes.useful").alias("label"))
    return labelled.where(F.col("label").isNotNull())


def review_counts(reviews: DataFrame) -> DataFrame:
    """(business_id, review_count) where the business table has no count of its own."""
    return reviews.groupBy("business_id").agg(F.count("*").alias("review_count"))


def businesses_above(businesses: DataFrame, minimum: int = MIN_REVIEW_COUNT) -> DataFrame:
    """Businesses with more than ``minimum`` reviews."""
    return businesses.where(F.col("review_count") > minimum)


def in_training(key: Column, percent: int = TRAIN_PERCENT) -> Column:
    """True for the training share; depends on the key only, so it can be repeated anywhere."""
    return hash_bucket(key.cast("string"), 100) < percent


def split(rows: DataFrame, key: str = "doc_id", percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows."""
    training = in_training(F.col(key), percent)
    return rows.where(training), rows.where(~training)


def _shuffled(key: str, seed: int) -> list[Column]:
    return [hash32(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def random_rows(rows: DataFrame, key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random by a seeded hash of the key; any number, without a task that has them all."""
    return first_rows(rows, _shuffled(key, seed), n)


def random_share(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Exactly this share of the rows, rounded up, drawn at random by a seeded hash of the key."""
    if not 0 <= share <= 1:
        raise ValueError("the share has to be from 0 to 1")
    # A share of a count is not below it by a rounding error only.
    return random_rows(rows, key, math.ceil(round(share * rows.count(), 9)), seed)


def random_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About this share of the rows, each kept or not by a seeded hash of its own key; no row has to meet another."""
    return rows.where(hash_unit(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))) < fraction)


def random_business(businesses: DataFrame, seed: int = 0) -> DataFrame:
    """One business, drawn at random."""
    return random_rows(businesses, "business_id", 1, seed)


def random_review_per(reviews: DataFrame, seed: int = 0) -> DataFrame:
    """(business_id, doc_id): one random review of each business; partial minima, no group in one task."""
    drawn = F.min_by("doc_id", F.struct(*_shuffled("doc_id", seed))).alias("doc_id")
    return reviews.groupBy("business_id").agg(drawn)


def row_ids(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """Add ``row_id`` 0 .. n-1 in the order of a unique column."""
    return number_rows(rows, [F.col(order).asc()], "row_id").frame
