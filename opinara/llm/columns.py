"""Column expressions and array helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the text contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: The same as a pattern.
SPACE_PATTERN = "[ \\x09-\\x0D]+"


def whole(text: str) -> Column:
    """A text column in which NULL is the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def without_space(text: Column) -> Column:
    for char in SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for a text of white space only."""
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


#: Range of the hash that draws rows.
_DRAWN = 1 << 40


def drawn(rows: DataFrame, keys: list[str], most: int, n: int) -> DataFrame:
    """At most ``most`` of about ``n`` rows, by the order of a hash of ``keys``.

    A cut by the same hash leaves about twice as many beforehand, so that what
    meets in one task does not grow with the number of partitions.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(_DRAWN))
    if n > 4 * most:
        rows = rows.filter(place < int(_DRAWN * 2 * most / n))
    return rows.orderBy(place, *keys).limit(most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the slices ``flat[starts[i] : starts[i] + lengths[i]]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
