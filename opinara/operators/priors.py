"""Priors on the topic model's distributions.

A prior adjusts expected counts before they are normalised and adds its log
density to the perplexity.  Both are column expressions, so a prior of one's
own (a subclass) runs inside the same generated code as the rest.

A prior may depend on the whole matrix.  It then works in two stages: it names
sums over all rows, which one aggregation computes, and they are handed to its
expression for a row as numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.numeric import add

# Fixed value: keeps the log density finite where a probability is zero.
SMALL_VALUE = 0.00001


class Prior:
    """Positive cut of the counts, flat density; subclass to change either."""

    flat = False

    def regularize(self, count: Column, old: Column) -> Column:
        """New count of one component, given its old probability; NaN-free and not below zero."""
        return F.greatest(F.lit(0.0), count)

    def regularize_all(self, counts: list[Column], olds: list[Column]) -> list[Column]:
        """New counts of a row, given its old probabilities: of a document by topic, or of a word by topic.

        Override this instead of ``regularize`` where the topics depend on one another.
        """
        return [self.regularize(count, old) for count, old in zip(counts, olds)]

    def matrix_sums(self, counts: list[Column], olds: list[Column]) -> dict[str, Column]:
        """Aggregates over all rows of the matrix that the prior needs, by name; none unless it sees the whole matrix."""
        return {}

    def regularize_matrix(self, counts: list[Column], olds: list[Column], sums: dict[str, float]) -> list[Column]:
        """New counts of a row, given also the ``matrix_sums``; override it together with them."""
        return self.regularize_all(counts, olds)

    def matrix_log(self, sums: dict[str, float]) -> float:
        """The part of the log density that depends on the ``matrix_sums`` of the probabilities, which then are counts and old ones."""
        return 0.0

    def log_term(self, probability: Column) -> Column:
        """One component's share of the log density."""
        return F.lit(0.0)

    def log_constant(self, components: int) -> float:
        """The part of the log density of one distribution that no probability enters."""
        return 0.0

    def log_prior(self, probabilities: list[Column]) -> Column:
        """Log density of one distribution whose components are columns of a row."""
        return add([self.log_term(p) for p in probabilities]) + F.lit(self.log_constant(len(probabilities)))


class UniformPrior(Prior):
    """No preference: counts stay as they are."""

    flat = True

    def regularize(self, count: Column, old: Column) -> Column:
        return count


class SymmetricDirichlet(Prior):
    """Dirichlet with equal parameters; alpha < 1 makes distributions sparse, alpha > 1 smooths them."""

    def __init__(self, alpha: float):
        self.alpha = float(alpha)

    def regularize(self, count: Column, old: Column) -> Column:
        return super().regularize(count + F.lit(self.alpha - 1.0), old)

    def log_term(self, probability: Column) -> Column:
        return F.lit(self.alpha - 1.0) * F.ln(probability + F.lit(SMALL_VALUE))

    def log_constant(self, components: int) -> float:
        return math.lgamma(components * self.alpha) - components * math.lgamma(self.alpha)


class Decorrelation(Prior):
    """Pulls topics apart: the log density falls with the squared overlaps of all pairs of topics.

    The overlap of two topics is the sum over all words of the product of their
    probabilities, so what a word loses to another topic depends on the matrix:
    R = -weight / 2 * sum over pairs of overlap².  A count changes by its
    probability times the derivative of R, and not below zero.
    """

    def __init__(self, weight: float):
        self.weight = float(weight)

    def matrix_sums(self, counts: list[Column], olds: list[Column]) -> dict[str, Column]:
        pairs = ((s, t) for t in range(len(olds)) for s in range(t))
        return {f"overlap{s}_{t}": F.sum(olds[s] * olds[t]) for s, t in pairs}

    def regularize_matrix(self, counts: list[Column], olds: list[Column], sums: dict[str, float]) -> list[Column]:
        def others(t: int) -> Column:
            terms = [F.lit(sums[f"overlap{min(s, t)}_{max(s, t)}"]) * old for s, old in enumerate(olds) if s != t]
            return add(terms) if terms else F.lit(0.0)

        return [F.greatest(F.lit(0.0), c - F.lit(self.weight) * olds[t] * others(t)) for t, c in enumerate(counts)]

    def matrix_log(self, sums: dict[str, float]) -> float:
        return -self.weight / 2 * math.fsum(overlap * overlap for overlap in sums.values())
