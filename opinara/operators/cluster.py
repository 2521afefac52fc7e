"""K-means and LDA over term-frequency vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.numeric import let
from opinara.operators.kmeans import CLUSTERS, ITERATIONS, Clustering, KMeans, array_of, nearest, points_of_vectors, vector_entries
from opinara.sources.state import shared_folder

#: Rows of a partition for LDA; below them a few partitions, which depend on the number of rows alone.
PARTITION_ROWS, SMALL_PARTITIONS, SMALL_ROWS = 50_000, 8, 64


def in_order(vectors: DataFrame) -> DataFrame:
    """Partitions that depend on ``doc_id`` and the number of rows only: LDA draws by partition and position."""
    rows = vectors.count()
    parts = max(1, min(SMALL_PARTITIONS, math.ceil(rows / SMALL_ROWS)), math.ceil(rows / PARTITION_ROWS))
    return vectors.repartition(parts, "doc_id").sortWithinPartitions("doc_id")


@dataclass
class KMeansFit:
    """K-means of one set of vectors."""

    clustering: Clustering
    cost: float

    @property
    def rounds(self) -> int:
        return self.clustering.rounds

    def transform(self, vectors: DataFrame, column: str = "features") -> DataFrame:
        """Add ``cluster_id``, row-wise; NULL for a vector that has none or a component that is not finite."""
        # A subquery may not stand inside a lambda, so the centers are a column for a while.
        beside, centers = "_kmeans_centers", self.clustering.packed.frame.select("centers").scalar()
        own = let(array_of(column), lambda v: let(vector_entries(v), lambda e: self._cluster(F.col(beside), e)))
        return vectors.withColumn(beside, centers).withColumn("cluster_id", own).drop(beside)

    @staticmethod
    def _cluster(centers: Column, entries: Column) -> Column:
        norm = F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["v"] * e["v"])
        found = let(norm, lambda n: nearest(centers, entries, n))
        return F.when(entries.isNotNull(), found["cluster_id"].cast("int"))

    def centers(self) -> list[list[float]]:
        """The k centers by id."""
        return [row["center"] for row in self.clustering.centers.orderBy("cluster_id").collect()]


def train_kmeans(vectors: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = 0, start: str = "parallel") -> KMeansFit:
    """K-means on ``doc_id`` and a vector column ``features``; depends on the rows and the seed, not on their partitions."""
    width = vectors.agg(F.max(F.size(array_of("features")))).first()[0]
    clustering = KMeans(k, iterations, seed, start).fit(points_of_vectors(vectors), width)
    cost = clustering.assigned().agg(F.sum("distance")).first()[0]
    if cost is None:
        raise ValueError("there is nothing to cluster")
    return KMeansFit(clustering, cost)


def centroids(spark: SparkSession, model: KMeansFit) -> DataFrame:
    """(cluster_id, center) of a model; k rows."""
    return model.clustering.centers.select("cluster_id", "center")


def points_of(vectors: DataFrame, column: str = "features") -> DataFrame:
    """(doc_id, point) for the distance operators."""
    return vectors.select("doc_id", vector_to_array(column).alias("point"))


def train_lda(
    vectors: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = 0
) -> LDAModel:
    """LDA by expectation maximisation; its graph is checkpointed in the shared folder."""
    shared_folder(vectors.sparkSession)
    return LDA(k=k, maxIter=iterations, seed=seed, optimizer="em", featuresCol="features").fit(in_order(vectors))


def add_tfidf(vectors: DataFrame) -> DataFrame:
    """Replace ``features`` by its TF-IDF weights."""
    weighted = IDF(inputCol="features", outputCol="_tfidf").fit(vectors).transform(vectors)
    return weighted.drop("features").withColumnRenamed("_tfidf", "features")
