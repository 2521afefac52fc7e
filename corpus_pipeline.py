"""A corpus from raw documents to packed sequences.

Each stage takes what the one before kept, writes it and hands it on; all but
the last return the columns of ``documents``.  Ids have to be unique.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import exact_dedup, packing, quality, simhash, toxicity
from opinara.session import let_workers_import
from opinara.sources.state import store

#: A text is toxic from this score.
TOXIC = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: base rules and divergence from the language."""
    return quality.keep_good(docs)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: the model is fitted to the labels of the documents that are left."""
    let_workers_import(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.score(F.col("text")) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest as written, then the smallest id, stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over three-word shingles at two bits: of linked documents the smallest id stays."""
    let_workers_import(spark)
    return simhash.drop_near_copies(docs, shingle=3, limit=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens, one row per piece."""
    let_workers_import(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("toxicity", keep_civil),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; a test replays the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name).frame
    return STAGES[-1][1](spark, docs, sf_dir)
