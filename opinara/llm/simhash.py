"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Two fingerprints that differ in at most ``limit`` bits agree up to ``t[i]``
bits in at least one part i of their bits, for any thresholds with
``sum(t[i] + 1) = limit + 1`` (-1 leaves a part out).  Bits that go together
are put into the same part, so that parts differ in how much they tell; a
dynamic programme then chooses the thresholds with the fewest estimated
candidates and probes, and the number of parts with them.  The estimate comes
from counts over all fingerprints.

Every fingerprint is indexed under its bits of each part in use and probes the
values within the part's threshold.  Buckets of few fingerprints yield pairs
that are verified.  The fingerprints of all larger buckets yield no pairs:
each of them names itself and its one-bit variants, and two fingerprints
within two bits share such a name; the smallest fingerprint of a name stands
for the rest.  That is exact too, and linear in the size of a bucket.

Everything runs on distinct fingerprints; documents only meet their own.

Defined cases: NULL counts as the empty text; texts without words have
fingerprint zero and are linked like any other; NULL ids are carried along and
name no component unless all ids in it are NULL; repeated rows are separate
members of a component; an empty table gives no rows; columns other than the
two named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import whole
from opinara.llm.components import connected
from opinara.sources.state import store

BITS = 64
#: A bucket with more fingerprints than this is linked by variants instead of pairs.
PAIR_BUCKET = 32
#: Cost of a probe row beside that of a verified candidate.
PROBE_COST = 4.0

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """Bit i is set when it is set in more than half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    array, counts = np.array(hashes, "<u8"), np.zeros(BITS, np.int64)
    for i in range(0, len(array), chunk):
        part = array[i : i + chunk].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(array)).tolist())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(
        per_batch, "doc_id bigint, fp bigint"
    )


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many set bits a and b together, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            rows += len(bits)
        cells = pa.array(np.arange(BITS * BITS + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(np.append(total.ravel(), rows).astype(np.int64))], ["cell", "n"])

    sums = distinct.select("fp").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(BITS * BITS + 1)
    for row in sums:
        table[row["cell"]] = row["n"]
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into equal parts, each grown around its strongest correlations."""
    p = np.diag(together) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(related, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        inner = related[np.ix_(left, left)]
        part = [left[int(inner.sum(axis=1).argmax())]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(max(rest, key=lambda b: (related[b, part].sum(), -b)))
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def _agreement(n: int, together: np.ndarray, part: list[int], threshold: int) -> float:
    """Estimated share of pairs that differ in at most ``threshold`` bits of the part."""
    p = np.diag(together) / max(n, 1)
    same = p**2 + (1 - p) ** 2
    share, seen = 1.0, []
    for bit in part:
        follow = same[bit]
        for other in seen:  # the earlier bit that tells most about this one
            both = together[bit, other] / max(n, 1)
            cells = (both, p[bit] - both, p[other] - both, 1 - p[bit] - p[other] + both)
            follow = max(follow, min(1.0, sum(c * c for c in cells) / same[other]))
        share *= follow
        seen.append(bit)
    odds = (1 - same[part]) / same[part]
    exact = [1.0] + [0.0] * max(threshold, 0)
    for x in odds:  # elementary symmetric sums: which bits differ
        for t in range(len(exact) - 1, 0, -1):
            exact[t] += exact[t - 1] * x
    return min(1.0, share * sum(exact))


def _probes(bits: int, threshold: int) -> int:
    from math import comb

    return sum(comb(bits, t) for t in range(threshold + 1))


def allocate(n: int, together: np.ndarray, limit: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """Parts in use with their thresholds, of the lowest estimated cost."""
    best = None
    for parts in range(1, most_parts + 1):
        groups = group_bits(n, together, parts)
        # table[s]: lowest cost of the parts so far with thresholds that use s of limit + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for threshold in range(-1, limit - used + 1):
                    more = 0.0
                    if threshold >= 0:
                        probes = _probes(len(group), threshold)
                        more = PROBE_COST * n * probes + n * n / 2 * _agreement(n, together, group, threshold)
                    key, value = used + threshold + 1, cost + more
                    if key not in step or value < step[key][0]:
                        step[key] = (value, [*chosen, threshold])
            table = step
        cost, chosen = table[limit + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int], threshold: int) -> list[int]:
    """Masks that flip at most ``threshold`` of the bits, in the signed form of the column."""
    return [_signed(sum(1 << b for b in chosen)) for t in range(threshold + 1) for chosen in combinations(bits, t)]


def _key(part: int, masked: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), masked.alias("value"))


def links(distinct: DataFrame, limit: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` whose components are those of all links.

    ``limit`` is at most 2: the variants of large buckets meet within two bits.
    """
    if limit not in (0, 1, 2):
        raise ValueError("limit must be 0, 1 or 2")
    n, together = bit_statistics(distinct)
    plan = allocate(n, together, limit)
    keys, probes = [], []
    for i, (bits, threshold) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        keys.append(_key(i, F.col("fp").bitwiseAND(mask)))
        for flip in _flips(bits, threshold)[1:]:
            probes.append(_key(i, F.col("fp").bitwiseAND(mask).bitwiseXOR(F.lit(flip))))
    indexed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.part", "key.value", "fp")
    # Probes count as members: a bucket is light when all that meets in it is.
    entries = indexed.withColumn("own", F.lit(True))
    if probes:
        probing = distinct.select("fp", F.explode(F.array(*probes)).alias("key"))
        entries = entries.unionAll(probing.select("key.part", "key.value", "fp", F.lit(False).alias("own")))
    sizes = entries.groupBy("part", "value").agg(F.count("*").alias("size"), F.max("own").alias("indexed"))
    shared = store(sizes.filter("size > 1 AND indexed").select("part", "value", "size"), "simhash_buckets").frame
    joined = store(entries.join(shared, ["part", "value"]), "simhash_candidates").frame
    light = joined.filter(F.col("size") <= pair_bucket)
    other = light.filter("own").select("part", "value", F.col("fp").alias("b"))
    pairs = (
        light.select("part", "value", F.col("fp").alias("a"))
        .join(other, ["part", "value"])
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit))
        .select("a", "b")
    )
    dense = joined.filter(F.col("size") > pair_bucket).select("fp").distinct()
    if limit == 0:
        return pairs
    # limit 1: a name is a fingerprint itself, met by the one-bit variants of the others.
    variants = F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _flips(list(range(BITS)), 1)])
    named = dense.select("fp", F.posexplode(variants).alias("at", "name"))
    if limit == 1:
        real = dense.select(F.col("fp").alias("name"))
        return pairs.unionAll(named.filter("at > 0").join(real, "name").select(F.col("fp").alias("a"), F.col("name").alias("b")))
    first = named.groupBy("name").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("name", "a")
    return pairs.unionAll(named.join(first, "name").filter("fp <> a").select("a", F.col("fp").alias("b")))


def near_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 2, pair_bucket: int = PAIR_BUCKET
) -> DataFrame:
    """Per document: ``doc_id``, ``fp`` and ``component_id``, the smallest id it is linked to over any steps."""
    prints = store(fingerprints(docs, id, text, shingle), "fingerprints").frame
    classes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint_classes").frame
    found = connected(links(classes.select("fp"), limit, pair_bucket)).frame.withColumnRenamed("node", "fp")
    linked = found.join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(found.join(least, "root").select("fp", "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of each component, with all columns; ids have to be unique, NULL ids stay."""
    dropped = near_groups(docs, id, text, **options).filter(F.col("doc_id") != F.col("component_id"))
    return docs.join(
        dropped.select(F.col("doc_id").alias("__dropped")), F.col(id).cast("long") == F.col("__dropped"), "left_anti"
    )
