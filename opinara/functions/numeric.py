"""Small numeric column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def ratio_or(numerator: Column, denominator: Column, otherwise: Column) -> Column:
    """numerator / denominator, or ``otherwise`` unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(otherwise)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long numeric arrays."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body or a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
