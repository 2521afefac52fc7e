"""The registered queries of these operators; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import bpe, chat, exact_dedup, hard_negatives, licenses, packing, quality, secret_scan, sharding, simhash
from opinara.llm import toxicity, turn_repair, url_filter
from opinara.session import let_workers_import

SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).select("doc_id", "license", "n_license_paragraphs", "n_unconfirmed")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    chats = chat.format_chats(turns)
    read = chats.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.rounded(table(spark, folder, "embeddings"), moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans, base = F.col("spans"), secret_scan.KINDS[:3]
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[F.size(secret_scan.of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(secret_scan.named(secret_scan.of_kind(spans, *base)), 256).alias("base_sha256"),
        secret_scan.named(spans).alias("spans"),
        F.size(secret_scan.of_kind(spans, "novel")).cast("long").alias("n_novel"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with rows dropped, emptied, cut, repeated and given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = F.crc32(key.cast("binary")) % 20
    text = turn_repair.spaced("text")
    return turns.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(turn_repair.spaced("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    ).filter(harm != 0)


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = turn_repair.repair(turn_repair.marked(damaged(turns))).withColumnRenamed("conv_id", "of")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_exact_dedup,
        op3_toxicity,
        op4_url_filter,
        op5_packing,
        op6_license_scan,
        op7_sharding,
        op8_simhash,
        op9_quality,
        op10_chat,
        op11_hard_negatives,
        op12_secrets,
        op13_turn_repair,
    )
}
