import math
import random

import pytest

from opinara.operators import center_blocks, ranking

CENTERS = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [6.0, 8.0])]
POINTS = [(10, [0.0, 0.0]), (11, [1.0, 0.0]), (12, [6.0, 8.0])]


@pytest.fixture(scope="module")
def centers(spark):
    return spark.createDataFrame(CENTERS, "cluster_id bigint, center array<double>")


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "doc_id bigint, point array<float>")


def rows(frame):
    return {tuple(r) for r in frame.collect()}


def test_furthest(points, centers):
    assert (10, 2, 100.0) in rows(ranking.furthest_nth_cluster(points, centers))
    assert (10, 1, 25.0) in rows(ranking.furthest_nth_cluster(points, centers, 2))
    assert (12, 2, 0.0) in rows(ranking.furthest_nth_cluster(points, centers, 3))


def test_closest(points, centers):
    for n, wanted in ((1, (10, 0.0)), (2, (11, 1.0)), (3, (12, 100.0))):
        assert rows(ranking.closest_nth_point(points, centers, 0, n)) == {wanted}
        nth = ranking.closest_nth_points(points, centers, n).where("cluster_id = 0")
        assert rows(nth.select("doc_id", "distance")) == {wanted}


def test_errors(spark, points, centers):
    for n in (0, 4):
        with pytest.raises(ValueError):
            ranking.furthest_nth_cluster(points, centers, n)
        with pytest.raises(ValueError):
            ranking.closest_nth_point(points, centers, 0, n)
    with pytest.raises(ValueError):
        ranking.closest_nth_point(points, centers, 7)
    with pytest.raises(ValueError):
        ranking.closest_nth_point(points, centers.unionByName(centers), 0)
    with pytest.raises(ValueError):
        ranking.furthest_nth_cluster(points, centers.limit(0))


def test_ties_go_to_the_lower_id(spark):
    centers = spark.createDataFrame([(5, [1.0]), (3, [1.0]), (4, [-1.0])], "cluster_id bigint, center array<double>")
    points = spark.createDataFrame([(2, [0.0]), (1, [0.0])], "doc_id bigint, point array<double>")
    assert rows(ranking.furthest_nth_cluster(points, centers).select("cluster_id")) == {(3,)}
    assert rows(ranking.nearest_center(points, centers).select("cluster_id")) == {(3,)}
    assert rows(ranking.closest_nth_points(points, centers).select("doc_id")) == {(1,)}
    assert rows(ranking.closest_nth_point(points, centers, 4, 2)) == {(2, 1.0)}


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(center_blocks, "PER_BLOCK", 3)
    draw = random.Random(3)
    vectors = [[draw.random() for _ in range(4)] for _ in range(60)]
    centers = spark.createDataFrame(list(enumerate(vectors[:25])), "cluster_id bigint, center array<double>")
    points = spark.createDataFrame(list(enumerate(vectors[25:])), "doc_id bigint, point array<double>")
    small = 96 * 6  # about six centers a block
    for n in (1, 4, 25):
        wanted = rows(ranking.furthest_nth_cluster(points, centers, n))
        assert rows(ranking.furthest_nth_cluster(points, centers, n, small)) == wanted
    assert rows(ranking.center_distances(points, centers, small)) == rows(ranking.center_distances(points, centers))
    brute = {
        (i, min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(vectors[:25]))[1])
        for i, p in enumerate(vectors[25:])
    }
    assert rows(ranking.nearest_center(points, centers, small).select("doc_id", "cluster_id")) == brute


def test_blocks_rank_centers_in_batches(spark, monkeypatch):
    """Ties, equal points, very large and very small numbers; no pair of point and block carries the block's centers."""
    monkeypatch.setattr(center_blocks, "PER_BLOCK", 5)
    draw = random.Random(11)
    for scale in (1.0, 1e153, 1e-160):
        vectors = [[scale * draw.randrange(4) for _ in range(3)] for _ in range(70)]
        centers = spark.createDataFrame(list(enumerate(vectors[:30])), "cluster_id bigint, center array<double>")
        points = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(vectors[30:])], "doc_id string, point array<double>")
        for n in (1, 3):
            assert rows(ranking.furthest_nth_cluster(points, centers, n, 88 * 6)) == rows(ranking.furthest_nth_cluster(points, centers, n))
        assert rows(ranking.nearest_center(points, centers, 88 * 6)) == rows(ranking.nearest_center(points, centers))
    plan = ranking.nearest_center(points, centers, 88 * 6)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_closest_points_by_fold_and_by_window(spark, monkeypatch):
    monkeypatch.setattr(center_blocks, "PER_BLOCK", 3)
    draw = random.Random(5)
    vectors = [[float(draw.randrange(3)) for _ in range(3)] for _ in range(90)]  # many ties
    centers = spark.createDataFrame(list(enumerate(vectors[:12])), "cluster_id bigint, center array<double>")
    data = list(enumerate(vectors[12:])) + [(900, None), (901, [1.0]), (902, [None, 0.0, 0.0])]
    points = spark.createDataFrame(data, "doc_id bigint, point array<double>").repartition(5)
    for n in (1, 2, 7):
        brute = set()
        for c, center in enumerate(vectors[:12]):
            near = sorted((sum((a - b) ** 2 for a, b in zip(p, center)), i) for i, p in enumerate(vectors[12:]))
            brute.add((c, near[n - 1][1], near[n - 1][0]))
        assert rows(ranking.closest_nth_points(points, centers, n)) == brute
        assert rows(ranking.closest_nth_points(points, centers, n, block_bytes=88 * 4)) == brute
        assert rows(ranking.closest_nth_points(points, centers, n, fold_cells=0)) == brute
    assert rows(ranking.closest_nth_points(points, centers, 500)) == set()
    assert rows(ranking.closest_nth_points(points.limit(0), centers)) == set()


def test_blocks_are_bounded_and_rule_others_out(spark):
    draw = random.Random(9)
    middles = [[draw.uniform(-100, 100) for _ in range(3)] for _ in range(12)]
    vectors = [[x + draw.gauss(0, 1) for x in middles[i % 12]] for i in range(900)]
    vectors += [vectors[0]] * 60  # equal centers have one pivot and several blocks
    centers = spark.createDataFrame(list(enumerate(vectors)), "cluster_id bigint, center array<double>")
    points = spark.createDataFrame([(i, [x + 0.1 for x in vectors[i]]) for i in range(0, 900, 9)], "doc_id bigint, point array<double>")
    blocks = center_blocks.build(centers, 960, 3, 1 << 20, 20)
    table = blocks.stored.frame.collect()
    assert sum(b["n"] for b in table) == 960 and max(b["n"] for b in table) <= 60
    for b in table:
        assert b["n"] == len(b["centers"])
        for c in b["centers"]:
            assert math.dist(c["center"], b["pivot"]) <= b["radius"] + 1e-9
    assert blocks.needed(points, 1, 1).count() < 100 * len(table) / 3
    assert blocks.needed(points, 1, -1).count() < 100 * len(table) / 2
    everywhere = {(p, c): math.dist([x + 0.1 for x in vectors[p]], v) ** 2 for p in range(0, 900, 9) for c, v in enumerate(vectors)}
    small = 1 << 12
    for n in (1, 3):
        got = ranking.closest_nth_points(points, centers, n, small).collect()
        assert len(got) == 960
        for r in got:
            near = sorted(everywhere[p, r["cluster_id"]] for p in range(0, 900, 9))
            assert r["distance"] == pytest.approx(near[n - 1])
    for r in ranking.nearest_center(points, centers, small).collect():
        assert r["distance"] == pytest.approx(min(everywhere[r["doc_id"], c] for c in range(960)))


def test_unusable_points_are_left_out_everywhere(spark, points, centers):
    width = len(centers.first()["center"])
    bad = [(None, [0.0] * width), (70, None), (71, [0.0] * (width - 1)), (72, [None] * width), (73, [float("nan")] * width), (74, [float("inf")] * width)]
    more = points.unionByName(spark.createDataFrame(bad, "doc_id bigint, point array<double>"))
    for rank in (
        lambda p: ranking.nearest_center(p, centers),
        lambda p: ranking.furthest_nth_cluster(p, centers, 2),
        lambda p: ranking.center_distances(p, centers),
        lambda p: ranking.closest_nth_points(p, centers),
        lambda p: ranking.closest_nth_point(p, centers, 0),
        lambda p: ranking.within_set_error(p, centers),
        lambda p: ranking.nearest_center(p, centers, 1),
    ):
        assert rows(rank(more)) == rows(rank(points))
    for center in (None, [None] * width, [float("nan")] * width):
        with pytest.raises(ValueError, match="center"):
            ranking.nearest_center(points, centers.unionByName(spark.createDataFrame([(9, center)], "cluster_id bigint, center array<double>")))


def test_first_centers_are_not_sorted(points, centers):
    for frame in (ranking.nearest_center(points, centers), ranking.furthest_nth_cluster(points, centers)):
        main = frame._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "array_sort" not in main and "Sort" not in main.replace("sort_array", "")
    folded = ranking.closest_nth_points(points, centers, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in folded and "MapInArrow" in folded
    assert folded.count("Generate explode") == 0  # no pair rows


def test_within_set_error(points, centers):
    assert ranking.within_set_error(points, centers).first()[0] == pytest.approx(1.0)


def test_most_useful(spark):
    scored = spark.createDataFrame(
        [("a", 1, -2.0), ("a", 2, -1.0), ("a", 3, -1.0), ("b", 4, 0.5)], "g string, doc_id bigint, prediction double"
    )
    assert [r.doc_id for r in ranking.most_useful(scored.where("g = 'a'")).collect()] == [2]
    assert [r.doc_id for r in ranking.most_useful(scored, 3).collect()] == [4, 2, 3]
    assert rows(ranking.most_useful_per(scored, "g")) == {("a", 2, -1.0), ("b", 4, 0.5)}


def test_points_are_not_shuffled(points, centers):
    plan = ranking.nearest_center(points, centers)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Join" not in plan and "Cartesian" not in plan
    assert "Exchange" not in main
