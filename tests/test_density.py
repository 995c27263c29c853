from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from geotext.catalog import geo
from geotext.operators import density, neighbours
from geotext.operators.cells import Geometry
from geotext.operators.density import density_cluster
from geotext.operators.neighbours import neighbour_count, neighbour_join

SCHEMA = "user_id long, post_id long, lat double, lon double"
LINE = [(1, i, 0.0, float(i)) for i in range(4)]


def labels_of(df, eps, m):
    rows = df.where((F.col("eps") == eps) & (F.col("m") == m)).collect()
    return {r["post_id"]: r["cluster_id"] for r in rows}


def check_labels(spark, posts, eps_values, ms, mode, geometry=Geometry(), **options):
    df = spark.createDataFrame(posts, SCHEMA)
    labelled = density_cluster(df, eps_values, ms, mode, geometry=geometry, **options).cache()
    expected = brute.one_hop if mode == "one_hop" else brute.dbscan
    for eps in eps_values:
        for m in ms:
            want = expected(posts, eps, m, brute.DISTANCES[geometry.distance])
            assert labels_of(labelled, eps, m) == want, (eps, m)


def test_line_of_four(spark):
    df = spark.createDataFrame(LINE, SCHEMA)
    plane = Geometry("euclidean")
    one = density_cluster(df, [1.5], [1], geometry=plane)
    assert labels_of(one, 1.5, 1) == {0: 0, 1: 0, 2: 2, 3: 2}
    full = density_cluster(df, [1.5], [1], "dbscan", geometry=plane)
    assert labels_of(full, 1.5, 1) == {0: 0, 1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("m", [1, 2, 3])
def test_as_many_posts_as_neighbours_wanted_gives_no_cluster(spark, m):
    df = spark.createDataFrame([(1, i, 5.0, 5.0) for i in range(m)], SCHEMA)
    assert density_cluster(df, [1.0], [m]).count() == 0


def test_distance_of_exactly_eps_is_not_near(spark):
    df = spark.createDataFrame(LINE[:2], SCHEMA)
    assert density_cluster(df, [1.0], [1], geometry=Geometry("euclidean")).count() == 0


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
def test_bounded_authors(spark, mode):
    check_labels(spark, brute.skewed_posts(1), [0.05, 0.3], [1, 3, 10], mode)


def test_dbscan_of_bounded_authors_is_one_pass(spark, monkeypatch):
    monkeypatch.setattr(density, "cut", None)  # no checkpoint, no rounds
    posts = [*brute.edge_posts(11, 80), *[(2, 1000 + i, i * 0.01, 0.0) for i in range(60)]]
    check_labels(spark, posts, [1.2, 3.0], [1, 2, 4], "dbscan")
    check_labels(spark, posts, [0.011, 0.3], [1, 2], "dbscan", Geometry("manhattan"))


def test_dbscan_agrees_on_both_sides_of_the_limit(spark):
    df = spark.createDataFrame(brute.skewed_posts(12, 200), SCHEMA)
    order = ["eps", "m", "user_id", "post_id"]
    folded, rounds = (
        density_cluster(df, [0.05, 0.3], [1, 4], "dbscan", fold_sites=n).toPandas().sort_values(order, ignore_index=True)
        for n in (2000, 1)
    )
    assert folded.equals(rounds[folded.columns])


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
def test_sites_without_a_place_or_author_are_noise(spark, mode):
    posts = [*LINE, (1, 10, None, 1.0), (1, 11, 1.0, None), (None, 12, 0.0, 0.0), (None, 13, 0.0, 0.5)]
    df = spark.createDataFrame(posts, SCHEMA)
    found = density_cluster(df, [1.5], [1], mode, geometry=Geometry("euclidean"))
    assert sorted(r["post_id"] for r in found.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
def test_hot_author_hot_spot_and_crowded_cells(spark, tiny_limits, mode):
    check_labels(spark, brute.skewed_posts(2, 160), [0.2], [1, 4], mode, fold_sites=20)


@pytest.mark.parametrize("fold_sites", [2000, 5])
def test_poles_and_the_180_degree_line(spark, fold_sites):
    posts = brute.edge_posts(3, 120)
    check_labels(spark, posts, [3.0], [2], "one_hop", fold_sites=fold_sites)
    check_labels(spark, posts, [2.0], [2], "dbscan", fold_sites=fold_sites)


def test_a_seed_that_covers_the_last_seen_site_of_a_cell_does_not_cover_the_rest(spark):
    cell = [(1, i, 0.9 + (i - 2) / 800, 0.1) for i in range(2, 11)]
    posts = [(1, 1, 0.0, 0.1), *cell, (1, 11, 1.2, 0.1), (1, 12, 2.1, 0.1)]
    check_labels(spark, posts, [1.0], [1], "one_hop", Geometry("euclidean"), fold_sites=5)


@pytest.mark.parametrize("distance", ["euclidean", "manhattan"])
def test_plane_distances(spark, tiny_limits, distance):
    posts = brute.skewed_posts(4, 120)
    check_labels(spark, posts, [0.003], [2], "one_hop", Geometry(distance), fold_sites=30)
    check_labels(spark, posts, [0.002], [2], "dbscan", Geometry(distance), fold_sites=30)


@pytest.mark.parametrize(("radii", "cell_sites"), [(64, 8), (1, 1), (2, 3)])
def test_an_ordered_track_stays_exact(spark, monkeypatch, radii, cell_sites):
    monkeypatch.setattr(density, "BLOCK_RADII", radii)
    monkeypatch.setattr(density, "CELL_SITES", cell_sites)
    posts = [(1, i, 40 + i * 0.0003, -80.0) for i in range(12)]
    check_labels(spark, posts, [0.07], [1], "one_hop", fold_sites=1)


def test_small_blocks_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK_RADII", 2)
    monkeypatch.setattr(density, "CELL_SITES", 2)
    check_labels(spark, brute.skewed_posts(9, 120), [0.2], [1, 4], "one_hop", fold_sites=1)


def test_a_long_track_takes_few_rounds(spark, monkeypatch):
    rounds = []
    whole = density.meet
    monkeypatch.setattr(density, "meet", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    posts = [(1, i, 40 + i * 0.0003, -80.0) for i in range(5000)]
    df = spark.createDataFrame(posts, SCHEMA)
    labels = labels_of(density_cluster(df, [0.07], [1], fold_sites=1), 0.07, 1)
    assert len(rounds) <= 20
    want, last = {}, None
    for i in range(5000):  # a seed covers the two after it, and the one between takes the earlier
        last = i if last is None or i - last > 2 else last
        want[i] = last
    assert labels == want


def test_labels_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(brute.skewed_posts(5), SCHEMA)
    a = density_cluster(df.repartition(1), [0.1], [2]).toPandas()
    b = density_cluster(df.repartition(7, "post_id"), [0.1], [2]).toPandas()
    order = ["user_id", "post_id"]
    assert a.sort_values(order, ignore_index=True).equals(b.sort_values(order, ignore_index=True))


@pytest.mark.parametrize("limits", ["usual", "tiny"])
@pytest.mark.parametrize("posts", [brute.skewed_posts(6, 160), brute.edge_posts(7, 120)], ids=["skew", "edge"])
def test_neighbour_join_and_count(spark, request, limits, posts):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    df = spark.createDataFrame(posts, SCHEMA)
    for eps in (0.25,):
        around = brute.near(posts, eps, brute.km)
        pairs = {(r["i"], r["j"]) for r in neighbour_join(df, eps).collect()}
        assert pairs == {(i, j) for i, js in around.items() for j in js}
        counted = {r["post_id"]: r["k"] for r in neighbour_count(df, eps).collect()}
        assert counted == {i: len(js) for i, js in around.items()}


def test_neighbour_rule_as_a_condition(spark):
    posts = brute.skewed_posts(8, 60)
    df = spark.createDataFrame(posts, SCHEMA)
    later = neighbour_join(df, 0.2, condition=F.col("post_id_j") > F.col("post_id_i"))
    both = neighbour_join(df, 0.2)
    assert later.count() * 2 == both.count() > 0


def test_a_crowded_tile_is_many_small_joins(spark, monkeypatch):
    """All pairs of a tile are tried, so one task takes far fewer of its rows than of a key that is only looked up."""
    rows = [(k % 3, k, 40.0 + k % 7 * 1e-5, -80.0 + k % 11 * 1e-5) for k in range(60)]
    df = spark.createDataFrame(rows, "user_id long, post_id long, lat double, lon double")
    want = {(i, j) for _, i, *a in rows for _, j, *b in rows if i != j and brute.DISTANCES["haversine"](tuple(a), tuple(b)) < 0.001}
    for limit in (20_000, 9):
        monkeypatch.setattr(neighbours, "JOIN_ROWS", limit)
        pairs = neighbour_join(df, 0.001, by=None)
        assert ("part_i" in pairs._jdf.queryExecution().toString()) == (limit == 9)
        got = [(r.i, r.j) for r in pairs.select("i", "j").collect()]
        assert len(got) == len(want) and set(got) == want


def _shuffled(plan) -> tuple[int, int]:
    """Rows written and exchanges made below a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    if name == "ReusedExchangeExec":
        return 0, 0
    rows = made = 0
    if name == "ShuffleExchangeExec":
        rows, made = plan.metrics().get("shuffleRecordsWritten").get().value(), 1
    children = plan.children()
    for k in range(children.size()):
        below = _shuffled(children.apply(k))
        rows, made = rows + below[0], made + below[1]
    return rows, made


def test_pairs_come_of_one_shuffle_of_the_posts(spark, monkeypatch):
    """What is written to disk on the way follows the posts, and the tasks that make the pairs do too."""
    rng = random.Random(3)
    rows = [(1, k, 40 + rng.random() / 20, -80 + rng.random() / 20) for k in range(1_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((i, j) for _, i, *a in rows for _, j, *b in rows if i != j and brute.km(a, b) < 0.1)
    pairs = neighbour_join(df, 0.1, by=None)
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    written, exchanges = _shuffled(pairs._jdf.queryExecution().executedPlan())
    assert exchanges == 1 and len(rows) <= written < 1.4 * len(rows)
    monkeypatch.setattr(neighbours, "JOIN_ROWS", 50)
    assert neighbour_join(df, 0.1, by=None).rdd.getNumPartitions() >= len(rows) / 50


@pytest.mark.parametrize("most_tasks", [50_000, 2], ids=["hashed", "sorted"])
@pytest.mark.parametrize("name, eps", [("haversine", 40.0), ("euclidean", 0.4), ("manhattan", 0.4)])
def test_each_pair_comes_once_whatever_the_units(spark, monkeypatch, most_tasks, name, eps):
    """Posts in one clump, at the pole, across 180 degrees, twice and without a place; wide tiles split and whole."""
    rng = random.Random(4)
    spots = [(0.0, 0.0)] * 3 + [(89.9, 0.0), (89.9, 175.0), (-10.0, 179.9), (-10.0, -179.9)]
    rows = []
    for k in range(160):
        lat, lon = rng.choice(spots)
        rows.append((k % 3, k, min(90.0, lat + rng.gauss(0, 0.3)), lon + rng.gauss(0, 0.3)))
    rows += [rows[0], rows[0], rows[5]]
    df = spark.createDataFrame([*rows, (1, 900, None, 0.0), (1, 901, 0.0, None), (1, None, 0.0, 0.0)], SCHEMA)
    distance = brute.DISTANCES[name]
    monkeypatch.setattr(neighbours, "MOST_TASKS", most_tasks)
    for by in (None, "user_id"):
        want = sorted(
            (i, j) for u, i, *a in rows for v, j, *b in rows if i != j and (by is None or u == v) and distance(a, b) < eps
        )
        for limit in (20_000, 60, 9):
            monkeypatch.setattr(neighbours, "JOIN_ROWS", limit)
            got = neighbour_join(df, eps, by=by, geometry=Geometry(name)).collect()
            assert sorted((r.i, r.j) for r in got) == want, (by, limit)
            assert all(abs(r.d - distance(*[next(p[2:] for p in rows if p[1] == k) for k in (r.i, r.j)])) < 1e-6 for r in got[::50])


def test_quick_rounding_is_rounding(spark):
    values = [0.1234565, 0.1234575, 0.0123455, 1e-9, 5e-7, 4.9999999e-7, 0.0, -0.0, -1e-9, -0.1234565, 1e12 + 0.1234567, float("nan"), float("inf"), None]
    values += [random.Random(5).random() / 10 for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, d double")
    quick = {r.k: repr(r.d) for r in geo._rounded_quickly(df, "d").collect()}
    assert quick == {r.k: repr(r.d) for r in geo._rounded(df, "d").collect()}
