"""Sharding by rendezvous hashing.

Every record scores each shard by a hash of its key and the shard, weighted,
and goes to the highest score.  Key and shards alone decide; a shard that is
added wins the records it scores highest for and moves no other, one that is
removed gives up its own only.  Nothing is shuffled to choose a shard.

Slots number the records of a shard in the order of a second hash.  The range
of that hash is cut into parts: counts per shard and part give each part its
first slot, so no task numbers a whole shard.

Defined cases: a NULL key is a key of its own; NULL text has no bytes; repeated
rows share shard and get slots of their own; an empty table gives no rows;
columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.columns import whole

#: Hexadecimal digits of a hash that become a number, exact in a double.
_DIGITS = 13
_RANGE = float(16**_DIGITS)
#: Parts of the second hash, at most; with the number of shards it bounds the table of first slots.
MOST_PARTS = 4096


def _hash(text: Column, digits: int = _DIGITS) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, -shard): the logarithm of a uniform number over the weight, so weights are shares."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    each = []
    for shard, weight in enumerate(weights):
        uniform = (_hash(F.concat(key, F.lit(f":{shard}"))) + 1) / F.lit(_RANGE + 1)
        each.append(F.struct((F.ln(uniform) / F.lit(float(weight))).alias("score"), F.lit(-shard).alias("shard")))
    return F.array(*each)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key."""
    return -F.array_max(scores(key, weights))["shard"]


def shard(
    docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0, id: str = "doc_id", text: str = "text", parts: int | None = None
) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, shard, slot, grown_shard`` (with one more shard of weight ``grown_by``)."""
    spark = docs.sparkSession
    if parts is None:
        parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    body = whole(text).cast("binary")
    n = len(weights)
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        _hash(F.concat(F.lit("slot:"), name)).alias("place"),
        scores(name, [*weights, grown_by]).alias("scores"),
    )
    best = -F.array_max(F.slice("scores", 1, n))["shard"]
    grown = -F.array_max("scores")["shard"]
    part = (F.col("place") / F.lit(_RANGE) * parts).cast("int").alias("part")
    rows = rows.select("doc_id", "size", "text_crc32", "place", part, best.alias("shard"), grown.alias("grown_shard"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("shard", "part").orderBy("place", "doc_id", "size", "text_crc32")
    numbered = rows.withColumn("slot", F.row_number().over(inner) - 1)
    # At most len(weights) * MOST_PARTS rows.
    return numbered.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("first")).alias("slot"), "grown_shard"
    )
