"""Quality rules: repetition limits, and divergence from the language's own histograms.

Base rules reject texts that are too short or repeat themselves.  The method
then compares two histograms of a text with references of its language: the
classes of its characters, and its common words.  The references are the mean
histograms over all documents of the language; the distance is that of Jensen
and Shannon, between 0 and 1.  Texts below a minimum length are too short for a
histogram and pass the comparison.

All of it is built-in expressions on one row, so only the few rows of the
references are ever shuffled.

Defined cases: NULL counts as the empty text, which fails the base rule; a
language without a list of common words (NULL too) has a common reference and
is compared by character classes only; repeated rows are judged alike; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import SPACE, let, whole, without_space, words_of
from opinara.sources.state import store

#: Common words of each language.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "to", "and", "a", "in", "is", "that", "for", "it", "as", "with", "be", "by", "on", "are"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "ein", "in"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """The base rules, and the distances from which a text is rejected."""

    least_words: int = 20
    repeated_percent: int = 30
    #: Words below which histograms say too little.
    guard_words: int = 30
    #: Each (a, b): a text of n words is rejected from a distance of a + b / sqrt(n).
    class_distance: tuple[float, float] = (0.16, 1.0)
    word_distance: tuple[float, float] = (0.12, 1.9)
    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)


def count_symbols(text: Column) -> Column:
    """Occurrences of the symbols, each a single byte."""
    rest = text
    for symbol in SYMBOLS:
        rest = F.replace(rest, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def count_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    return let(lines, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A hash of each window of words, by hashing pairs of neighbours, of pairs and so on; ``window`` is a power of two."""

    def paired(hashes, step):
        return let(
            hashes,
            lambda h: F.zip_with(
                F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)
            ),
        )

    hashes, step = F.transform(words, lambda word: F.xxhash64(word)), 1
    while step < window:
        hashes, step = paired(hashes, step), 2 * step
    return hashes


def count_repeated_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included.

    Equal windows have equal hashes, so a text whose hashes all differ repeats
    nothing; in the others the windows themselves are sorted and compared.
    """
    last = F.size(words) - (window - 1)
    windows = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("at"))
    )

    def repeated_places(ordered):
        following = F.slice(ordered, 2, F.size(ordered))
        equal = F.zip_with(ordered, following, lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda pair: pair.isNotNull()))))

    def covered(places):
        following = F.slice(places, 2, F.size(places))
        gains = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda total, gain: total + gain)

    exact = let(F.array_sort(windows), lambda ordered: let(repeated_places(ordered), covered))
    repeats = (last >= 2) & (F.size(F.array_distinct(hashes)) < F.size(hashes))
    return F.when(repeats, exact).otherwise(F.lit(0).cast("long"))


def _language(lang: Column, limits: Limits) -> Column:
    return F.when(lang.isin(*limits.common_words), lang).otherwise("")


def _class_histogram(text: Column, word_chars: Column, symbols: Column) -> Column:
    """Shares of capitals, digits, symbols, other marks, white space and the rest."""
    length = F.char_length(text)
    capitals, digits = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{N}"))
    marks = F.regexp_count(text, F.lit(r"[\p{P}\p{S}]")) - symbols
    counts = [capitals, digits, symbols, marks, length - word_chars]
    return let(
        F.array(*[c.cast("double") for c in counts], length.cast("double")),
        lambda c: F.transform(
            F.array(*[c[i] for i in range(5)], c[5] - c[0] - c[1] - c[2] - c[3] - c[4]), lambda x: x / F.greatest(c[5], F.lit(1.0))
        ),
    )


def _word_histogram(common: Column, n_words: Column, lang: Column, limits: Limits) -> Column:
    """Shares of the language's common words, and of all others, from the words that are common in any language."""
    by_language = F.array().cast("array<double>")
    for name, listed in limits.common_words.items():
        counts = F.array(*[(F.size(common) - F.size(F.array_remove(common, word))).cast("double") for word in listed])
        by_language = F.when(lang == name, counts).otherwise(by_language)
    shares = let(by_language, lambda c: F.transform(c, lambda x: x / F.greatest(n_words, F.lit(1)).cast("double")))
    rest = lambda s: F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
    return let(shares, lambda s: F.when(F.size(s) == 0, s).otherwise(F.concat(s, F.array(rest(s)))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; 0 for empty ones."""

    def term(x, y):
        middle = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / middle)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def measured(
    docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``carry`` (all by default) as one struct ``row``, and the measures beside it."""
    whole_text = whole(text)
    listed = sorted({word for words in limits.common_words.values() for word in words})
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        whole_text.alias("text"),
        words_of(whole_text).alias("words"),
        F.char_length(without_space(whole_text)).cast("long").alias("word_chars"),
        count_symbols(whole_text).alias("n_symbols"),
        _language(F.col(lang).cast("string"), limits).alias("language"),
    ).select(
        "*", window_hashes(F.col("words")).alias("hashes"), F.filter("words", lambda w: w.isin(listed)).alias("common")
    )
    return base.select(
        "row",
        "language",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        count_duplicate_lines(F.col("text")).alias("n_dup_lines"),
        count_repeated_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
        _class_histogram(F.col("text"), F.col("word_chars"), F.col("n_symbols")).alias("classes"),
        _word_histogram(F.col("common"), F.size("words"), F.col("language"), limits).alias("common"),
    )


def references(found: DataFrame, limits: Limits) -> DataFrame:
    """Mean histograms of each language over its texts of sufficient length; a row per listed language, and one for the rest."""
    classes = [F.avg(F.col("classes")[i]).alias(f"c{i}") for i in range(6)]
    bins = 1 + max((len(c) for c in limits.common_words.values()), default=0)
    common = [F.avg(F.try_element_at("common", F.lit(i + 1))).alias(f"w{i}") for i in range(bins)]
    means = found.filter(F.col("n_words") >= limits.guard_words).groupBy("language").agg(*classes, *common)
    return means.select(
        "language",
        F.array(*[f"c{i}" for i in range(6)]).alias("usual_classes"),
        F.array_compact(F.array(*[f"w{i}" for i in range(bins)])).alias("usual_common"),
    )


def _limit(base_and_spread: tuple[float, float]) -> Column:
    """Short texts stray further from their language by chance alone."""
    base, spread = base_and_spread
    return F.lit(base) + F.lit(spread) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))


def judged(
    docs: DataFrame,
    limits: Limits | None = None,
    text: str = "text",
    lang: str = "lang",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the input, or its columns ``carry``), the measures, both distances, ``base_failed`` and ``kept``.

    With ``carry`` the measures are written once and serve both the references
    and the verdicts; otherwise whole texts would have to be written, and
    measuring again is cheaper.
    """
    limits = limits or Limits()
    found = measured(docs, limits, text, lang, carry)
    if carry is not None:
        found = store(found, "quality").frame
    usual = references(found, limits)
    distance = lambda own, reference: F.coalesce(divergence(F.col(own), F.col(reference)), F.lit(0.0))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeated_percent * F.col("n_words"))
    # One row per listed language and one for the rest.
    beside = found.join(F.broadcast(usual), "language", "left").select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        distance("classes", "usual_classes").alias("class_distance"),
        distance("common", "usual_common").alias("word_distance"),
    )
    usual_enough = (F.col("class_distance") < _limit(limits.class_distance)) & (F.col("word_distance") < _limit(limits.word_distance))
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise((F.col("n_words") < limits.guard_words) | usual_enough)
    return beside.withColumn("kept", verdict)


def keep_good(docs: DataFrame, limits: Limits | None = None, **columns: str) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, limits, **columns).filter("kept").select("row.*")
