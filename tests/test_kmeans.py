from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from geotext.operators import kmeans

SCHEMA = "id long, vec array<double>"


def clumps(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    middle = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    vecs = middle[np.arange(n) % 3] + rng.normal(scale=0.5, size=(n, 2))
    return vecs, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], SCHEMA)


def starts(spark, *vecs):
    rows = [(0, i, list(map(float, v))) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, kmeans.CENTROID_SCHEMA)


def test_ties_go_to_the_lowest_index(spark):
    point = spark.createDataFrame([(1, [0.0])], SCHEMA)
    got = kmeans.kmeans_assign(point, starts(spark, [-1], [1])).first()
    assert (got["cid"], got["d"]) == (0, 1.0)


@pytest.mark.parametrize("distance", ["euclidean", "manhattan", "haversine", "cosine"])
def test_lloyd_matches_a_plain_loop(spark, distance):
    from geotext.functions.distance import DISTANCES

    vecs, points = clumps(spark)
    vecs = vecs + 20
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], SCHEMA)
    centres = vecs[:3].copy()
    for _ in range(4):
        d = np.stack([DISTANCES[distance].on_rows(vecs, c) for c in centres], axis=1)
        total, nearest = (d.min(axis=1) ** 2).sum(), d.argmin(axis=1)
        centres = np.array([vecs[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(3)])
    got = kmeans.kmeans_lloyd(
        points.repartition(4), 3, distance, starts=starts(spark, *vecs[:3]), max_rounds=4, min_change=-1
    )
    assert got.dispersion == pytest.approx(total)
    assert np.allclose([r["vec"] for r in got.centroids.orderBy("cid").collect()], centres)


def test_dispersion_does_not_rise_with_rounds(spark):
    _, points = clumps(spark)
    values = [
        kmeans.kmeans_lloyd(points, 3, restarts=1, max_rounds=n, min_change=-1).dispersion
        for n in (1, 2, 4, 8)
    ]
    assert values == sorted(values, reverse=True)


def test_best_of_several_restarts_finds_the_clumps(spark):
    _, points = clumps(spark)
    result = kmeans.kmeans_lloyd(points, 3, restarts=6)
    found = sorted(tuple(round(x) for x in r["vec"]) for r in result.centroids.collect())
    assert found == [(0, 0), (0, 10), (10, 0)]
    best = kmeans.best_restart(result.restarts).first()
    assert (best["restart"], best["dispersion"]) == (result.restart, result.dispersion)


def test_empty_clusters_are_kept_or_dropped(spark):
    _, points = clumps(spark)
    far = starts(spark, [0, 0], [10, 0], [0, 10], [1e6, 1e6])
    kept = kmeans.kmeans_lloyd(points, 4, starts=far).centroids
    assert [1e6, 1e6] in [r["vec"] for r in kept.collect()]
    assert kmeans.kmeans_lloyd(points, 4, starts=far, empty="drop").centroids.count() == 3


def test_sample_k(spark):
    _, points = clumps(spark, 500)
    a = kmeans.sample_k(points.repartition(1), 20, restarts=4, seed=5).collect()
    b = kmeans.sample_k(points.repartition(6), 20, restarts=4, seed=5).collect()
    picks = {r: {x["id"] for x in a if x["restart"] == r} for r in range(4)}
    assert all(len(p) == 20 for p in picks.values()) and len(set(map(frozenset, picks.values()))) == 4
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert kmeans.sample_k(points.limit(5), 20).count() == 5


def test_one_round_by_its_parts(spark):
    vecs, points = clumps(spark)
    assigned = kmeans.kmeans_assign(points, starts(spark, *vecs[:3]))
    moved = {r["cid"]: r["vec"] for r in kmeans.centroid_update(assigned).collect()}
    result = kmeans.kmeans_lloyd(points, 3, starts=starts(spark, *vecs[:3]), max_rounds=1)
    for r in result.centroids.collect():
        assert r["vec"] == pytest.approx(moved[r["cid"]])
    assert kmeans.dispersion(assigned).first()[0] == pytest.approx(result.dispersion)


def test_zero_vectors_have_no_cluster_under_cosine(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)] + [(10 + i, [0.01 * i, 1.0]) for i in range(10)] + [(99, [0.0, 0.0])]
    points = spark.createDataFrame(rows, "id int, vec array<double>")
    starts = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "restart int, cid int, vec array<double>")
    result = kmeans.kmeans_lloyd(points, 2, "cosine", starts=starts)
    assert result.without_cluster == 1
    assert result.restarts.first()["rounds"] < 10
    assigned = kmeans.kmeans_assign(points, result.centroids, "cosine")
    assert [tuple(r) for r in assigned.where("cid IS NULL").select("id", "d").collect()] == [(99, None)]
    assert {r["cid"] for r in kmeans.centroid_update(assigned).collect()} == {0, 1}
    got = kmeans.dispersion(assigned).first()["dispersion"]
    assert got == pytest.approx(result.final_dispersion) and got <= result.dispersion + 1e-12


def test_workers_get_the_package(spark):
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, %r); from pyspark.sql import SparkSession; from geotext.session import configure; "
        "from geotext.operators import kmeans; "
        "s = configure(SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()); "
        "p = s.createDataFrame([(0, [1.0]), (1, [2.0])], 'id int, vec array<double>'); "
        "c = s.createDataFrame([(0, [1.0])], 'cid int, vec array<double>'); "
        "print('rows', kmeans.kmeans_assign(p, c).count(), len(kmeans.kmeans_assign(p, c).collect()))"
    ) % str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True, timeout=120)
    assert "rows 2 2" in done.stdout, done.stderr[-2000:]
