"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.sources.state import Stored, store


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")
    ).first()
    return row["n"], row["hash"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """Stored table ``node``, ``root`` (smallest node of the component) of all nodes with an edge.

    Alternates the two star operations, which only group, join and keep the
    number of edges within that of the start; each round is written, so a lost
    executor costs one round.  Self-loops and NULL ends are ignored.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = store(start.distinct(), "star_edges")
    before = _summary(current.frame)
    while before[0]:
        following = store(_small_star(_large_star(current.frame)), "star_edges")
        after = _summary(following.frame)
        current.drop()
        current = following
        if after == before:
            break
        before = after
    roots = current.frame.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    labels = store(current.frame.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots), "components")
    current.drop()
    return labels
