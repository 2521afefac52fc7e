"""What an LDA model fitted by expectation maximisation says of texts, worked out from its topics as table jobs.

A model of that kind is its expected counts, a number per feature and topic
(bounded by the number of features), and two smoothing numbers.  A text is one
row of at most as many entries as there are features; it meets the rows of its
features by a broadcast and is then iterated over within its row.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.numeric import add, let
from opinara.operators.text import vector_entries

#: Rounds in which the counts of a text under fixed topics settle.
ROUNDS = 30


def digamma(x: Column) -> Column:
    """For positive x, to about ten digits: six recurrences, then the asymptotic series."""
    y = x + F.lit(6.0)
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - add([1 / (x + F.lit(float(i))) for i in range(6)])


def vectors_of_counts(counts: DataFrame, num_features: int) -> DataFrame:
    """(doc_id, features) of (doc_id, bucket, tf) rows."""
    own = F.map_from_entries(F.collect_list(F.struct(F.col("bucket"), F.col("tf").cast("double"))))
    found = counts.groupBy("doc_id").agg(own.alias("tfs"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(num_features - 1)), lambda b: F.coalesce(F.try_element_at("tfs", b.cast("bigint")), F.lit(0.0)))
    return found.select("doc_id", array_to_vector(dense).alias("features"))


def expected_counts(spark: SparkSession, model: LDAModel) -> DataFrame:
    """(idx, counts): how often the model expects each feature in each topic."""
    matrix = model.topicsMatrix().toArray()
    return spark.createDataFrame([(idx, [float(n) for n in row]) for idx, row in enumerate(matrix)], "idx int, counts array<double>")


def _by_document(vectors: DataFrame, by_feature: DataFrame) -> DataFrame:
    """(doc_id, length, entries of n and w): each text with what is known of its features; all NULL without any."""
    met = vector_entries(vectors).join(F.broadcast(by_feature), "idx")
    packed = met.groupBy("doc_id").agg(F.sum("value").alias("length"), F.collect_list(F.struct(F.col("value").alias("n"), "w")).alias("entries"))
    return vectors.select("doc_id").join(packed, "doc_id", "left")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _shared_out(entries: Column, mixture: Column, topics: int) -> Column:
    """Counts by topic: each entry's n, in proportion to mixture times its w."""
    zeros = F.array(*[F.lit(0.0)] * topics)

    def more(counts: Column, entry: Column) -> Column:
        return let(
            _times(entry["w"], mixture),
            lambda p: let(entry["n"] / _total(p), lambda share: F.zip_with(counts, p, lambda c, q: c + q * share)),
        )

    return F.aggregate(entries, zeros, more)


def fold_in(vectors: DataFrame, model: LDAModel, alpha: float, eta: float, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, mixture, loglik) of texts under the topics of a fitted model, by the model's own expectation step.

    ``alpha`` and ``eta`` are the model's document and topic concentration.
    Texts without words have the uniform mixture and likelihood zero.
    """
    counts = expected_counts(vectors.sparkSession, model)
    features, topics = model.vocabSize(), len(counts.first()["counts"])
    totals = counts.agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(topics)]).first()
    smoothed = [totals[k] + features * (eta - 1) for k in range(topics)]
    weights = F.array(*[(F.col("counts")[k] + F.lit(eta - 1)) / F.lit(smoothed[k]) for k in range(topics)])
    texts = _by_document(vectors, counts.select("idx", weights.alias("w")))
    uniform = F.array(*[F.lit(1.0 / topics)] * topics)
    start = F.transform(uniform, lambda share: share * F.col("length"))

    def plus_prior(own: Column) -> Column:
        return F.transform(own, lambda c: c + F.lit(alpha - 1))

    def step(own: Column, _: Column) -> Column:
        return let(plus_prior(own), lambda mixture: _shared_out(F.col("entries"), mixture, topics))

    def described(own: Column) -> Column:
        whole = F.col("length") + F.lit(topics * (alpha - 1))
        return let(F.transform(plus_prior(own), lambda c: c / whole), lambda mixture: F.struct(mixture.alias("mixture"), likelihood(mixture).alias("loglik")))

    def likelihood(mixture: Column) -> Column:
        return F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["n"] * F.ln(_total(_times(e["w"], mixture))))

    # Named values inside lambdas are computed once; as columns they would be worked out again for each entry.
    settled = let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step), described)
    found = texts.select("doc_id", F.when(F.col("entries").isNotNull(), settled).alias("found"))
    return found.select("doc_id", F.coalesce("found.mixture", uniform).alias("mixture"), F.coalesce("found.loglik", F.lit(0.0)).alias("loglik"))


def variational_step(vectors: DataFrame, model: LDAModel, mixtures: DataFrame) -> DataFrame:
    """(doc_id, before, after): the Dirichlet counts that the mixtures stand for, and those one variational step makes of them.

    ``mixtures`` has rows (doc_id, mixture).  The mixtures that a model gives
    to texts are those which the step leaves alone.  A text without words has
    the document concentration before and after.
    """
    alpha = [float(a) for a in model.estimatedDocConcentration()]
    topics, prior = len(alpha), F.array(*[F.lit(a) for a in alpha])
    counts = expected_counts(vectors.sparkSession, model)
    totals = counts.agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(topics)]).first()
    logs = [F.exp(digamma(F.col("counts")[k]) - digamma(F.lit(totals[k]))) for k in range(topics)]
    weights = counts.where(F.exists("counts", lambda c: c > 0)).select("idx", F.array(*logs).alias("w"))
    texts = _by_document(vectors, weights).join(mixtures.select("doc_id", "mixture"), "doc_id")
    before = F.transform("mixture", lambda share: share * (F.col("length") + F.lit(sum(alpha))))
    held = texts.withColumn("before", F.coalesce(before, prior))
    shared = let(F.transform("before", lambda g: F.exp(digamma(g))), lambda shares: _shared_out(F.col("entries"), shares, topics))
    return held.select("doc_id", "before", F.coalesce(F.zip_with(shared, prior, lambda c, a: c + a), prior).alias("after"))
