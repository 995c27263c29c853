from __future__ import annotations

import statistics

import pytest

import brute
from geotext.operators import centres
from geotext.operators.density import cluster_sites, split_sites
from geotext.plans import homes

SCHEMA = "user_id long, post_id long, lat double, lon double"
SETTINGS = homes.Settings(eps_values=[0.1, 0.3], min_neighbours=[1, 3])


def truth_of(spark, posts):
    places = sorted({u for u, *_ in posts})
    return spark.createDataFrame([(u, 40.0, -80.0) for u in places], "user_id long, lat double, lon double")


def expected_candidates(posts, eps, m):
    size = {}
    for u, *_ in posts:
        size[u] = size.get(u, 0) + 1
    labels = brute.one_hop(posts, eps, m)
    members = {}
    for u, i, lat, lon in posts:
        if size[u] < m:
            members[(u, i)] = [(lat, lon)]
        elif i in labels:
            members.setdefault((u, labels[i]), []).append((lat, lon))
    return {k: tuple(statistics.fmean(axis) for axis in zip(*v)) for k, v in members.items()}


@pytest.mark.parametrize("fold_sites", [2000, 15])
def test_grid_search_and_prediction(spark, request, fold_sites):
    if fold_sites == 15:
        request.getfixturevalue("tiny_limits")
    posts = brute.skewed_posts(11, 120) + [(50, 5000, 41.0, -80.0), (50, 5001, 42.0, -80.0)]
    s = homes.Settings(**{**SETTINGS.__dict__, "fold_sites": fold_sites})
    df, truth = spark.createDataFrame(posts, SCHEMA), truth_of(spark, posts)
    predicted = homes.predict_homes(df, s).collect()
    scores = {(r["eps"], r["m"]): r for r in homes.grid_search(df, truth, s).collect()}
    authors = len({u for u, *_ in posts})
    for eps in s.eps_values:
        for m in s.min_neighbours:
            want = expected_candidates(posts, eps, m)
            got = {
                (r["user_id"], r["cluster_id"]): (r["lat"], r["lon"])
                for r in predicted
                if (r["eps"], r["m"]) == (eps, m)
            }
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
            nearest = {}
            for (u, _), place in want.items():
                nearest[u] = min(nearest.get(u, 1e9), brute.km(place, (40.0, -80.0)))
            r = scores[(eps, m)]
            assert r["error"] == pytest.approx(statistics.fmean(nearest.values()))
            assert (r["n_listed"], r["n_nonempty"]) == (authors, len(nearest))
            assert r["score"] == pytest.approx(1 / (1 + r["error"]) + 1)


def test_author_with_exactly_m_posts_is_listed_without_candidate(spark):
    posts = [(1, 1, 40.0, -80.0), (1, 2, 40.0, -80.0), (2, 3, 40.0, -80.0)]
    s = homes.Settings(eps_values=[1.0], min_neighbours=[2])
    df = spark.createDataFrame(posts, SCHEMA)
    assert {r["user_id"] for r in homes.predict_homes(df, s).collect()} == {2}
    dropped = homes.Settings(eps_values=[1.0], min_neighbours=[2], small_group="drop")
    assert homes.predict_homes(df, dropped).count() == 0
    r = homes.coverage(homes.predict_homes(df, s), df, truth_of(spark, posts)).first()
    assert (r["pct_listed"], r["pct_nonempty"]) == (100.0, 50.0)


def test_a_configuration_that_predicts_nothing(spark):
    posts = [(1, 1, 40.0, -80.0), (1, 2, 50.0, -80.0)]
    df, truth = spark.createDataFrame(posts, SCHEMA), truth_of(spark, posts)
    s = homes.Settings(eps_values=[0.001], min_neighbours=[1])
    none = homes.grid_search(df, truth, s)
    assert none.first()["error"] is None and homes.best_config(none).count() == 0
    exact = homes.grid_search(df, truth, s, empty_error=0.0)
    assert homes.best_config(exact).first()["score"] == 2.0


def test_score_ties_go_to_the_smallest_parameters(spark):
    rows = [(0.2, 1, 1.0, 100.0), (0.1, 5, 1.0, 100.0), (0.1, 3, 1.0, 100.0), (0.05, 1, 9.0, 0.0)]
    scores = spark.createDataFrame(rows, "eps double, m int, score double, pct_listed double")
    best = homes.best_config(scores).first()
    assert (best["eps"], best["m"]) == (0.1, 3)


@pytest.mark.parametrize("median_sites", [1000, 4])
def test_median_centres(spark, median_sites):
    posts = [(1, i, 40 + v / 1e6, -80.0) for i, v in enumerate([10, 1, 4, 2, 2, 2])]
    posts += [(2, 100 + i, 40 + v / 1e6, -80 + v / 1e6) for i, v in enumerate([1, 2, 4, 10])]
    sites = split_sites(spark.createDataFrame(posts, SCHEMA))
    labels = cluster_sites(sites, [1.0], [1])
    got = centres.cluster_centres(labels, method="median", median_sites=median_sites).collect()
    lat = {r["user_id"]: r["lat"] for r in got}
    lon = {r["user_id"]: r["lon"] for r in got}
    assert lat[1] == pytest.approx(40 + 2 / 1e6, abs=1e-12)
    assert lat[2] == pytest.approx(40 + 3 / 1e6, abs=1e-12)
    assert lon[2] == pytest.approx(-80 + 3 / 1e6, abs=1e-12)


def test_author_truth_and_gate(spark):
    posts = spark.createDataFrame(
        [(1, 2, 9.0, 9.0), (1, 1, 5.0, 6.0), (2, 3, 7.0, 8.0)],
        "user_id long, post_id long, home_lat double, home_lon double",
    )
    truth = {r["user_id"]: (r["lat"], r["lon"]) for r in homes.author_truth(posts).collect()}
    assert truth == {1: (5.0, 6.0), 2: (7.0, 8.0)}
    gate = homes.min_rows_gate(posts, 2).select("user_id", "clustered").distinct().collect()
    assert {tuple(r) for r in gate} == {(1, True), (2, False)}


def test_nearest_candidate_ties_and_unknown_places(spark):
    candidates = spark.createDataFrame(
        [(1, 7, 0.0, 1.0), (1, 8, 0.0, -1.0), (2, 9, 3.0, 3.0)],
        "user_id long, cluster_id long, lat double, lon double",
    )
    truth = spark.createDataFrame([(1, 0.0, 0.0)], "user_id long, lat double, lon double")
    s = homes.Settings(distance="euclidean")
    got = {r["user_id"]: (r["d"], r["lon"]) for r in homes.nearest_candidate(candidates, truth, [], s).collect()}
    assert got == {1: (1.0, -1.0), 2: (None, 3.0)}


def test_the_default_grid_runs_in_one_plan(spark):
    df = spark.createDataFrame(brute.skewed_posts(12, 60), SCHEMA)
    scores = homes.grid_search(df, truth_of(spark, brute.skewed_posts(12, 60)))
    assert scores.count() == 20
