"""K-means rounds against plain NumPy, however the points are partitioned."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinara.operators import cluster, kmeans, selection
from opinara.operators.ranking import most_useful_per
from opinara.plans import experiments

ROWS = "business_id string, doc_id bigint, point array<double>"


def grouped_rows(rng, sizes, width=6, whole=False):
    rows, at = [], 0
    for name, n in sizes.items():
        middles = rng.normal(size=(4, width)) * 5
        for _ in range(n):
            v = middles[rng.integers(4)] + rng.normal(size=width)
            v[rng.random(width) < 0.3] = 0
            rows.append((name, at, [float(x) for x in (np.rint(v) if whole else v)]))
            at += 1
    return rows


def hash32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def brute_rounds(points, centers, rounds):
    centers = [np.array(c, float) for c in centers]
    for _ in range(rounds):
        own = [min(range(len(centers)), key=lambda c: (((p - centers[c]) ** 2).sum(), c)) for p in points]
        centers = [np.mean([p for p, o in zip(points, own) if o == c], axis=0) if c in own else centers[c] for c in range(len(centers))]
    return centers


def by_group(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["group_id"], {})[r["cluster_id"]] = r["center"]
    return out


@pytest.mark.parametrize("rounds, cells", [(0, 1 << 20), (1, 0), (4, 1 << 20)])
def test_rounds_of_every_group(spark, monkeypatch, rounds, cells):
    monkeypatch.setattr(kmeans, "SMALL_CELLS", cells)
    rows = grouped_rows(np.random.default_rng(rounds), {"a": 90, "b": 11, "c": 3, "d": 1})
    frame = spark.createDataFrame(rows, ROWS)
    points = kmeans.points_of_arrays(frame, F.col("point"), F.col("business_id"))
    found = kmeans.KMeans(5, rounds, seed=7, start="hash").fit(points)
    got = by_group(found.centers)
    for name in "abcd":
        own = sorted((d, np.array(p)) for b, d, p in rows if b == name)
        first = sorted(own, key=lambda x: (hash32(f"{x[0]}:7"), x[0]))[:5]
        expected = brute_rounds([p for _, p in own], [p for _, p in first], rounds)
        assert len(got[name]) == len(expected)
        for c, center in enumerate(expected):
            assert got[name][c] == pytest.approx(center.tolist(), abs=1e-9)
    placed = {r["doc_id"]: r for r in found.assigned().collect()}
    assert len(placed) == len(rows)
    for name, d, p in rows:
        distances = {c: ((np.array(p) - np.array(v)) ** 2).sum() for c, v in got[name].items()}
        assert placed[d]["distance"] == pytest.approx(min(distances.values()), abs=1e-8)
        assert distances[placed[d]["cluster_id"]] == pytest.approx(min(distances.values()), abs=1e-8)
    costs = {r["group_id"]: (r["n"], r["cost"]) for r in found.cost().collect()}
    for name in "abcd":
        own = [placed[d]["distance"] for b, d, _ in rows if b == name]
        assert costs[name] == (len(own), pytest.approx(sum(own)))


@pytest.mark.parametrize("start", ["hash", "parallel"])
def test_partitions_and_the_way_of_the_centers_do_not_matter(spark, monkeypatch, start):
    frame = spark.createDataFrame(grouped_rows(np.random.default_rng(1), {"a": 300, "b": 40}), ROWS)
    seen = set()
    for parts, cells in ((1, 0), (1, 1 << 20), (4, 1 << 20), (64, 0), (64, 1 << 20)):
        monkeypatch.setattr(kmeans, "SMALL_CELLS", cells)
        points = kmeans.points_of_arrays(frame.repartition(parts), F.col("point"), F.col("business_id"))
        found = kmeans.KMeans(4, 5, seed=3, start=start).fit(points)
        seen.add(str(sorted(map(tuple, found.centers.collect()))))  # to the last bit
    assert len(seen) == 1


def test_parallel_draws(spark):
    """Whole numbers, so the share that each point has of the cost is exact."""
    rows = grouped_rows(np.random.default_rng(4), {"a": 120, "b": 9}, whole=True)
    means = kmeans.KMeans(3, seed=5)
    points = kmeans.points_of_arrays(spark.createDataFrame(rows, ROWS), F.col("point"), F.col("business_id"))
    held = means.prepare(points, 6)
    got = {}
    for r in means.drawn(held).collect():
        got.setdefault(r["group_id"], []).append((r["place"], r["doc_id"], r["weight"]))
    for name in "ab":
        own = sorted((d, np.array(p)) for b, d, p in rows if b == name)
        drawn = [min(own, key=lambda x: (hash32(f"{x[0]}:5"), x[0]))]
        for number in (1, 2):
            least = {d: min(((p - c) ** 2).sum() for _, c in drawn) for d, p in own}
            total = sum(least.values())
            drawn += [(d, p) for d, p in own if (hash32(f"{d}:5:{number}") + 1) / 4294967297.0 * total < 6.0 * least[d]]
        nearest = [min(range(len(drawn)), key=lambda c: (((p - drawn[c][1]) ** 2).sum(), c)) for _, p in own]
        expected = [(c, d, nearest.count(c)) for c, (d, _) in enumerate(drawn) if c in nearest]
        assert sorted(got[name]) == expected


def test_weighted_kmeans_of_the_draws():
    rng = np.random.default_rng(0)
    middles = np.array([[0.0, 0], [50, 0], [0, 50]])
    points = np.concatenate([m + rng.normal(size=(8, 2)) for m in middles])
    centers = kmeans.weighted_kmeans(points, np.arange(1.0, 25), 3, [0, 1])
    for m, part, weights in zip(middles, np.split(points, 3), np.split(np.arange(1.0, 25), 3)):
        assert min(((c - np.average(part, axis=0, weights=weights)) ** 2).sum() for c in centers) < 1e-12
    few = kmeans.weighted_kmeans(np.array([[2.0], [1.0], [2.0]]), np.ones(3), 5, [0])
    assert few.tolist() == [[2.0], [1.0]]


def test_parallel_start_finds_clusters_apart(spark):
    rng = np.random.default_rng(8)
    rows = [("x", i, [float(x) for x in np.eye(5)[i % 5] * 100 + rng.normal(size=5)]) for i in range(500)]
    found = kmeans.KMeans(5, 10).fit(kmeans.points_of_arrays(spark.createDataFrame(rows, ROWS), F.col("point")))
    assert found.cost().first()["cost"] < 500 * 5 * 1.5
    assert found.rounds < 10  # nothing moves any more


def test_unusable_points_are_left_out(spark):
    good = [("a", i, [float(i % 4), 1.0]) for i in range(20)]
    bad = [("a", 100, None), ("a", 101, [None, 1.0]), ("a", 102, [float("nan")]), ("a", 103, [float("inf")]), ("a", None, [1.0]), ("b", 104, None)]
    frame = spark.createDataFrame(good + bad, ROWS)
    points = kmeans.points_of_arrays(frame, F.col("point"), F.col("business_id"))
    assert {r["doc_id"] for r in points.collect()} == set(range(20))
    found = kmeans.KMeans(2, 2).fit(points)
    assert set(by_group(found.centers)) == {"a"}
    # Zero vectors, arrays of different lengths and a NULL group are points like any other.
    odd = spark.createDataFrame([(None, 1, []), (None, 2, [0.0, 0.0]), (None, 3, [0.0, 0.0, 5.0])], ROWS)
    assert kmeans.points_of_arrays(odd, F.col("point"), F.coalesce("business_id", F.lit("none"))).count() == 3
    nothing = kmeans.KMeans(2, 2).fit(points.limit(0))
    assert nothing.centers.count() == 0 and nothing.assigned().count() == 0


def test_transform_of_vectors(spark):
    rows = [(i, Vectors.dense([float(i % 3) * 10, 1.0 * (i % 2)]), "x") for i in range(30)]
    vectors = spark.createDataFrame(rows, ["doc_id", "features", "centers"])
    model = cluster.train_kmeans(vectors, 3, start="hash")
    placed = model.transform(vectors)
    assert placed.columns == ["doc_id", "features", "centers", "cluster_id"]
    centers = np.array(model.centers())
    for r in placed.collect():
        distances = ((centers - r["features"].toArray()) ** 2).sum(axis=1)
        assert distances[r["cluster_id"]] == distances.min()
    unknown = spark.createDataFrame([(1, Vectors.dense([float("nan"), 0.0])), (2, None)], vectors.select("doc_id", "features").schema)
    assert [r["cluster_id"] for r in model.transform(unknown).collect()] == [None, None]
    with pytest.raises(ValueError, match="nothing"):
        cluster.train_kmeans(vectors.limit(0), 3)


def test_dense_arrays(spark):
    rows = [([],), ([(0, 1.0)],), ([(2, 3.0)],), ([(0, 1.0), (3, 2.0)],)]
    frame = spark.createDataFrame(rows, "entries array<struct<i:int,v:double>>")
    got = [r[0] for r in frame.select(kmeans._dense(F.col("entries"), 4)).collect()]
    assert got == [[0, 0, 0, 0], [1, 0, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]


def test_rankings_of_every_business(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    sizes = {"large": 60, "small": 8, "tiny": 2}
    rows = [(b, " ".join(rng.choice(words, rng.integers(1, 9)))) for b, n in sizes.items() for _ in range(n)]
    rows = [(i, b, t) for i, (b, t) in enumerate(rows)] + [(100, "small", ""), (101, "large", None)]
    reviews = spark.createDataFrame(rows, "doc_id bigint, business_id string, text string")
    scored = reviews.select("doc_id", (F.col("doc_id") % 7).cast("double").alias("prediction"))
    businesses = selection.review_counts(reviews)
    got = experiments.rank_every(reviews, businesses, scored, minimum=5, k=3, iterations=2)
    by_business = {r["business_id"]: r for r in got.collect()}
    assert set(by_business) == {"large", "small"}
    best = {r["business_id"]: r["doc_id"] for r in most_useful_per(reviews.join(scored, "doc_id"), "business_id").collect()}
    from opinara.operators.regression import packed_tf

    terms = {r["doc_id"]: {t["bucket"]: t["tf"] for t in r["terms"]} for r in packed_tf(reviews.select("doc_id", "text")).collect()}
    packed = reviews.select("doc_id", "business_id").join(packed_tf(reviews.select("doc_id", "text")), "doc_id", "left")
    kept = packed.where("business_id <> 'tiny'")
    centers = by_group(kmeans.KMeans(3, 2).fit(kmeans.points_of_terms(kept, F.col("business_id")), 1000).centers)

    def distance(doc, center):
        v = np.zeros(1000)
        for bucket, n in terms.get(doc, {}).items():
            v[bucket] = n
        return ((v - np.array(center)) ** 2).sum()

    for name, row in by_business.items():
        assert row["most_useful_doc_id"] == best[name]
        far = max(centers[name], key=lambda c: (distance(best[name], centers[name][c]), -c))
        assert row["furthest_cluster_id"] == far
        own = [d for d, b, _ in rows if b == name]
        assert row["closest_distance"] == pytest.approx(min(distance(d, centers[name][far]) for d in own), abs=1e-8)
        assert row["closest_doc_id"] in own
        assert distance(row["closest_doc_id"], centers[name][far]) == pytest.approx(row["closest_distance"], abs=1e-8)


def test_the_seed_matters(spark):
    frame = spark.createDataFrame(grouped_rows(np.random.default_rng(2), {"a": 60}), ROWS)
    points = kmeans.points_of_arrays(frame, F.col("point"))
    first, second = (str(sorted(map(tuple, kmeans.KMeans(4, 0, seed=s).fit(points).centers.collect()))) for s in (0, 1))
    assert first != second
