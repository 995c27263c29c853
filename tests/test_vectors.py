from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.functions.distance import distance
from geotext.operators import metric, neighbourhoods, skew
from geotext.operators.density import density_cluster
from geotext.operators.metric import close_vectors
from geotext.operators.neighbourhoods import cluster_pairs, cluster_vectors
from geotext.operators.neighbours import neighbour_join

SCHEMA = "id long, vec array<double>"


def clumps(seed, n=260, dim=5):
    """Tight clumps, a line, copies and far points, under shuffled ids."""
    maker = np.random.default_rng(seed)
    centres = maker.normal(size=(6, dim)) * 4
    rows = [centres[k % 6] + maker.normal(size=dim) * (0.05 if k % 3 else 0.6) for k in range(n)]
    rows += [np.full(dim, 9.0) + np.eye(dim)[0] * 0.2 * k for k in range(25)]
    rows += [rows[3]] * 30 + [maker.normal(size=dim) * 40 for _ in range(10)]
    ids = maker.permutation(len(rows)) + 100
    return [(int(i), [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)]


def brute_pairs(rows, eps, name):
    found = set()
    vectors = np.array([v for _, v in rows])
    for i, (a, _) in enumerate(rows):
        d = distance(name).on_rows(vectors, vectors[i])
        found |= {(rows[k][0], a) for k in np.flatnonzero(d < eps).tolist() if k != i}
    return found


def brute_clusters(ids, pairs, m, mode):
    near = {i: set() for i in ids}
    for i, j in pairs:
        near[i].add(j)
    core = [i for i in sorted(ids) if len(near[i]) >= m]
    label = {}
    if mode == "one_hop":
        seeds = []
        for p in core:
            if not any(p in near[s] for s in seeds):
                seeds.append(p)
        for s in seeds:
            label[s] = s
        for s in seeds:
            for q in near[s]:
                label.setdefault(q, s)
        return label
    cores = set(core)
    for p in core:
        todo = [p] if p not in label else []
        while todo:
            q = todo.pop()
            if q not in label:
                label[q] = p
                todo += near[q] & cores
    named = dict(label)
    for p in core:
        for q in near[p] - cores:
            named[q] = min(named.get(q, label[p]), label[p])
    return named


@pytest.mark.parametrize("name,eps", [("euclidean", 0.5), ("euclidean", 30.0), ("manhattan", 0.8), ("cosine", 0.02)])
@pytest.mark.parametrize("cell_rows", [40, 10_000])
def test_no_pair_is_lost(spark, name, eps, cell_rows):
    rows = clumps(3)
    got = close_vectors(spark.createDataFrame(rows, SCHEMA), eps, name, cell_rows).collect()
    assert len(got) == len({(r.i, r.j) for r in got})
    assert {(r.i, r.j) for r in got} == brute_pairs(rows, eps, name)


def test_copies_become_blocks(spark):
    rows = [(k, [1.0, 2.0]) for k in range(50)] + [(99, [1.0, 2.5])]
    got = close_vectors(spark.createDataFrame(rows, SCHEMA), 1.0, cell_rows=4)
    assert got.count() == 51 * 50


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
@pytest.mark.parametrize("name,eps", [("euclidean", 0.5), ("cosine", 0.01)])
@pytest.mark.parametrize("m", [6])
def test_clusters_equal_brute_force(spark, monkeypatch, mode, name, eps, m):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = clumps(5)
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA), eps, m, mode, name, cell_rows=30)
    want = brute_clusters([i for i, _ in rows], brute_pairs(rows, eps, name), m, mode)
    assert {r.id: r.cluster_id for r in got.collect()} == want


def test_vectors_without_distance_are_noise(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [float("nan"), 1.0])]
    points = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in cluster_vectors(points, 0.1, 1, "dbscan", "cosine").collect()} == {(4, 4), (5, 4)}
    assert {tuple(r) for r in cluster_vectors(points, 0.1, 1).collect()} == {(1, 1), (2, 1)}
    assert cluster_vectors(points.where(F.lit(False)), 0.1, 1).count() == 0
    with pytest.raises(ValueError):
        close_vectors(points, 0.0)


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
def test_given_pairs_equal_the_geometric_result(spark, mode):
    maker = random.Random(8)
    rows = [(1, k, 40 + maker.random() / 500, -80 + maker.random() / 500) for k in range(150)]
    points = spark.createDataFrame(rows, "user_id long, post_id long, lat double, lon double")
    want = density_cluster(points, [0.02], [3], mode)
    vertices = points.select(F.col("post_id").alias("id"), F.lit(1).alias("weight"))
    got = cluster_pairs(vertices, neighbour_join(points, 0.02), 3, mode)
    assert {(r.id, r.cluster_id) for r in got.collect()} == {(r.post_id, r.cluster_id) for r in want.collect()}


def test_one_sided_pairs(spark):
    """A rule that need not hold both ways: what a core names joins it."""
    vertices = spark.createDataFrame([(k, 1) for k in range(1, 7)], "id long, weight int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 1), (2, 6)], "i long, j long")
    got = {(r.id, r.cluster_id) for r in cluster_pairs(vertices, pairs, 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_pivots_are_bounded(monkeypatch, spark):
    monkeypatch.setattr(metric, "PIVOTS", 8)
    rows = clumps(6, n=60)
    got = close_vectors(spark.createDataFrame(rows, SCHEMA), 0.4, cell_rows=40)
    assert {(r.i, r.j) for r in got.collect()} == brute_pairs(rows, 0.4, "euclidean")


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
@pytest.mark.parametrize("name,eps", [("euclidean", 0.5), ("euclidean", 6.0), ("cosine", 0.01)])
def test_clusters_by_small_batches_equal_brute_force(spark, monkeypatch, mode, name, eps):
    """Several batches of cores, thin rests, and components that only pairs between them join."""
    monkeypatch.setattr(metric, "BATCH", 12)
    rows = clumps(9, n=120)
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA), eps, 4, mode, name, cell_rows=40)
    want = brute_clusters([i for i, _ in rows], brute_pairs(rows, eps, name), 4, mode)
    assert {r.id: r.cluster_id for r in got.collect()} == want


@pytest.mark.parametrize("mode", ["one_hop", "dbscan"])
def test_dense_vectors_list_no_pairs(spark, monkeypatch, mode):
    """Where each vector is near a share of all others, pairs grow with the square of the table: they are not listed."""
    listed = []

    def counted(*args, **options):
        pairs = close_vectors(*args, **options)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(neighbourhoods, "close_vectors", counted)
    monkeypatch.setattr(metric, "BATCH", 100)
    maker = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(maker.normal(size=(400, 3)))]
    got = {r.id: r.cluster_id for r in cluster_vectors(spark.createDataFrame(rows, SCHEMA), 1.5, 3, mode).collect()}
    pairs = brute_pairs(rows, 1.5, "euclidean")
    assert got == brute_clusters(range(400), pairs, 3, mode)
    assert listed and sum(listed) < len(pairs) / 20


@pytest.mark.parametrize("name", ["euclidean", "cosine", "manhattan"])
def test_table_of_near_vectors_is_exact_at_the_edge(name):
    """Copies, and vectors at eps itself: the product's rounding decides nothing."""
    rows = np.array([[1e6, 0.0], [1e6, 0.0], [1e6, 1e-4], [1e6, 3.0], [1e6 + 4.0, 3.0], [3.0, 4.0], [0.5, 0.5]])
    for eps in (1e-4, 3.0, 5.0, distance(name).on_rows(rows, rows[0])[3]):
        want = np.stack([distance(name).on_rows(rows, c) < eps for c in rows], axis=1)
        assert (metric.Space(distance(name)).near(rows, rows, eps) == want).all()
