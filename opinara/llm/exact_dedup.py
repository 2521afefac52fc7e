"""Exact deduplication that no large group of copies can slow down.

Texts are equal when identical without white space.  Three combining steps,
each of which groups by the digest *and* the whole normalised text:

1. within a partition (the partial aggregate),
2. within a salt, which is the partition modulo ``salts``, so that the copies
   of a hot text meet in many tasks,
3. over the salts, where a text has at most ``salts`` rows left.

Every document then finds its group by the digest alone; where two texts share
a digest, by the whole text.

Defined cases: NULL counts as the empty text; a NULL id never wins against
another id; rows that repeat the winner's id *and* text are the same document
and are all marked kept; an empty table gives no rows; columns other than the
two named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import whole, without_space
from opinara.sources.state import store

SALTS = 64
#: More than the number of different 64-bit ids.
_IDS = Decimal(10**20)
_LARGEST_ID = Decimal(2**63 - 1)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rank(length: Column, doc_id: Column) -> Column:
    """Orders rows by code points, then by falling id, in one number; NULL ids come last."""
    wide = "decimal(38,0)"
    behind = F.coalesce(F.lit(_LARGEST_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(-1).cast("decimal(21,0)"))
    return (length.cast("decimal(10,0)") * F.lit(_IDS).cast("decimal(21,0)") + behind + F.lit(1)).cast(wide)


def _ranked_id(rank: Column) -> Column:
    behind = (rank % F.lit(_IDS).cast("decimal(21,0)")).cast("decimal(21,0)")
    return F.when(behind > 0, (F.lit(_LARGEST_ID + 1).cast("decimal(20,0)") - behind).cast("long"))


def exact_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Per document: ``doc_id``, ``digest``, ``keep_id``, ``group_size`` and ``kept``."""
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.char_length(whole(text)).alias("length"),
        without_space(whole(text)).alias("norm"),
    ).select("doc_id", "length", "norm", digest(F.col("norm")).alias("digest"))
    classes = (
        rows.select("digest", "norm", (F.spark_partition_id() % salts).alias("salt"), _rank(F.col("length"), F.col("doc_id")).alias("rank"))
        .groupBy("digest", "norm", "salt")
        .agg(F.max("rank").alias("rank"), F.count("*").alias("rows"))
        .repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("rank").alias("rank"), F.sum("rows").alias("group_size"))
        .select("digest", "norm", _ranked_id(F.col("rank")).alias("keep_id"), "group_size")
    )
    found = store(
        classes.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
        ),
        "exact_groups",
    ).frame
    members = rows.select("doc_id", "digest").join(found.filter("texts = 1").drop("texts"), "digest")
    shared = found.filter("texts > 1")
    if not shared.isEmpty():
        # Different texts under one digest: only these rows carry their text into a join.
        digests = shared.select("digest")
        apart = rows.join(digests, "digest", "left_semi").join(
            classes.join(digests, "digest", "left_semi"), ["digest", "norm"]
        )
        members = members.unionByName(apart.select("digest", "doc_id", "keep_id", "group_size"))
    return members.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns; ids have to be unique, NULL ids stay."""
    dropped = exact_groups(docs, id, text, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, F.col(id).cast("long") == F.col("__dropped"), "left_anti")
