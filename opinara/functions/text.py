"""Tokenising and portable hashing as column expressions (all inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str, drop_empty: bool = True) -> Column:
    """Lower-cased words, split at every single white-space character.

    NULL counts as a text without words.  ``drop_empty=False`` keeps the empty
    words that neighbouring separators leave, except those at the end.
    """
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if drop_empty:
        return F.array_remove(F.split(lowered, r"\s"), "")
    ended = F.regexp_replace(lowered, r"\s+$", "")
    only_space = (ended == "") & (lowered != "")
    return F.when(only_space, F.array().cast("array<string>")).otherwise(F.split(ended, r"\s"))


def hash32(value: Column) -> Column:
    """First 32 bits of the md5 as a number in 0 .. 2^32-1; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def hash_bucket(value: Column, buckets: int) -> Column:
    return hash32(value) % F.lit(buckets)


def hash_unit(value: Column) -> Column:
    """A repeatable number strictly between 0 and 1, whatever the partitioning."""
    return (hash32(value) + F.lit(1)) / F.lit(4294967297.0)
