"""Queries over vectors: k-means steps, k-means itself and the array distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geotext.catalog.inputs import table
from geotext.catalog.registry import query
from geotext.functions import distance as dist
from geotext.operators import kmeans
from geotext.operators.neighbourhoods import cluster_vectors

K = 8
ROUNDS = 3

VECTORS_SQL = """
vecs AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cid, vec FROM vecs ORDER BY id LIMIT {k})"""

DISTANCE_SQL = "sqrt(list_sum(list_transform(generate_series(1, len({a})), lambda i: pow({a}[i] - {b}[i], 2))))"


def _round_sql(n: int) -> str:
    """Assignment to the centroids of round n, and the centroids after it."""
    d = DISTANCE_SQL.format(a="v.vec", b="c.vec")
    return f"""
a{n} AS (
  SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d
  FROM (SELECT v.id, c.cid, {d} AS d FROM vecs v CROSS JOIN c{n} c) GROUP BY id),
m{n} AS (
  SELECT cid, list(x ORDER BY axis) AS vec FROM (
    SELECT cid, axis, avg(vec[axis]) AS x
    FROM a{n} JOIN vecs USING (id) CROSS JOIN generate_series(1, 64) AS g(axis) GROUP BY cid, axis)
  GROUP BY cid),
c{n + 1} AS (SELECT cid, coalesce(m{n}.vec, c{n}.vec) AS vec FROM c{n} LEFT JOIN m{n} USING (cid))"""


def vectors_sql(rounds: int, select: str) -> str:
    parts = [VECTORS_SQL.format(k=K), *[_round_sql(n) for n in range(rounds)]]
    return "WITH " + ",".join(parts) + "\n" + select


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def first_centroids(points: DataFrame) -> DataFrame:
    """Fixed starts: the first K vectors by id."""
    starts = points.orderBy("id").limit(K).agg(
        F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("c")
    )
    return starts.select(F.posexplode("c").alias("cid", "c")).select(
        F.lit(0).alias("restart"), "cid", "c.vec"
    )


def _assigned(spark, sf):
    points = vectors(spark, sf)
    return kmeans.kmeans_assign(points, first_centroids(points))


def _by_axis(centroids: DataFrame) -> DataFrame:
    return centroids.select("cid", F.posexplode("vec").alias("axis", "x")).select(
        "cid", "axis", F.round("x", 6).alias("x")
    )


_ASSIGNED = vectors_sql(1, "SELECT id, cid, round(d, 6) AS d FROM a0")


@query("kmeans_assign", _ASSIGNED)
def kmeans_assign_query(spark, sf):
    return _assigned(spark, sf).select("id", "cid", F.round("d", 6).alias("d"))


@query("nearest_centroid", vectors_sql(1, "SELECT cid, count(*) AS n FROM a0 GROUP BY cid"))
def nearest_centroid_query(spark, sf):
    return _assigned(spark, sf).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@query("dispersion", vectors_sql(1, "SELECT round(sum(d * d), 6) AS dispersion FROM a0"))
def dispersion_query(spark, sf):
    total = kmeans.dispersion(_assigned(spark, sf))
    return total.select(F.round("dispersion", 6).alias("dispersion"))


_AXES = """SELECT cid, CAST(axis - 1 AS INTEGER) AS axis, round(vec[axis], 6) AS x
  FROM {} CROSS JOIN generate_series(1, 64) AS g(axis)"""


@query("centroid_update", vectors_sql(1, _AXES.format("m0")))
def centroid_update_query(spark, sf):
    return _by_axis(kmeans.centroid_update(_assigned(spark, sf)))


@query("kmeans_lloyd", vectors_sql(ROUNDS, _AXES.format(f"c{ROUNDS}")))
def kmeans_lloyd_query(spark, sf):
    """Three rounds from fixed starts."""
    points = vectors(spark, sf)
    result = kmeans.kmeans_lloyd(points, K, starts=first_centroids(points), max_rounds=ROUNDS)
    return _by_axis(result.centroids)


def spaced_starts(points: DataFrame, restarts: int) -> DataFrame:
    """Fixed starts: restart r begins with K vectors from the (r * K)-th id on."""
    first = points.orderBy("id").limit(restarts * K).select("id", "vec")
    place = F.row_number().over(Window.orderBy("id")) - 1  # over restarts * K rows
    return first.select(
        F.floor(place / K).cast("int").alias("restart"), (place % K).cast("int").alias("cid"), "vec"
    )


_RESTARTS = 25


def _restarts_sql(rounds: int) -> str:
    """Dispersion of each restart against its centroids before round ``rounds``."""
    parts = [
        "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
        f"""c0 AS (SELECT CAST((n - 1) // {K} AS INTEGER) AS restart, CAST((n - 1) % {K} AS INTEGER) AS cid, vec
          FROM (SELECT vec, row_number() OVER (ORDER BY id) AS n FROM vecs) WHERE n <= {_RESTARTS * K})""",
    ]
    d = DISTANCE_SQL.format(a="v.vec", b="c.vec")
    for n in range(rounds):
        parts.append(
            f"""a{n} AS (SELECT restart, id, arg_min(cid, (d, cid)) AS cid, min(d) AS d
            FROM (SELECT v.id, c.restart, c.cid, {d} AS d FROM vecs v CROSS JOIN c{n} c) GROUP BY restart, id)"""
        )
        parts.append(
            f"""m{n} AS (SELECT restart, cid, list(x ORDER BY axis) AS vec FROM (
              SELECT restart, cid, axis, avg(vec[axis]) AS x
              FROM a{n} JOIN vecs USING (id) CROSS JOIN generate_series(1, 64) AS g(axis) GROUP BY restart, cid, axis)
            GROUP BY restart, cid)"""
        )
        parts.append(
            f"""c{n + 1} AS (SELECT restart, cid, coalesce(m{n}.vec, c{n}.vec) AS vec
            FROM c{n} LEFT JOIN m{n} USING (restart, cid))"""
        )
    return "WITH " + ",".join(parts) + f"\nSELECT restart, round(sum(d * d), 6) AS dispersion FROM a{rounds - 1} GROUP BY restart"


@query("kmeans_restart_dispersion", _restarts_sql(2))
def kmeans_restart_dispersion_query(spark, sf):
    """All restarts from fixed starts, two rounds: few enough for SQL to follow."""
    points = vectors(spark, sf)
    result = kmeans.kmeans_lloyd(points, K, starts=spaced_starts(points, _RESTARTS), max_rounds=2)
    return result.restarts.select("restart", F.round("dispersion", 6).alias("dispersion"))


@query("kmeans_lloyd_restarts")
def kmeans_lloyd_restarts_query(spark, sf):
    return kmeans.kmeans_lloyd(vectors(spark, sf), K, restarts=_RESTARTS, max_rounds=100).restarts


@query("best_restart")
def best_restart_query(spark, sf):
    result = kmeans.kmeans_lloyd(vectors(spark, sf), K, restarts=_RESTARTS, max_rounds=100)
    return kmeans.best_restart(result.restarts)


@query(
    "sample_k",
    f"""SELECT CAST(r AS INTEGER) AS restart, {K} AS picks, {K} AS distinct_picks, {K} AS among_vectors
    FROM generate_series(0, {_RESTARTS - 1}) AS g(r)""",
)
def sample_k_query(spark, sf):
    """Per restart: how many picks, how many distinct ones, and how many are vectors of the table."""
    points = vectors(spark, sf)
    picks = kmeans.sample_k(points, K, restarts=_RESTARTS, seed=13)
    known = points.select("id", F.col("vec").alias("known"))
    same = F.count_if(F.col("vec") == F.col("known"))
    return picks.join(known, "id", "left").groupBy("restart").agg(
        F.count(F.lit(1)).cast("int").alias("picks"),
        F.count_distinct("id").cast("int").alias("distinct_picks"),
        same.cast("int").alias("among_vectors"),
    )


def _to_centre(name: str, on_arrays, sql: str) -> None:
    @query(
        name,
        f"""WITH {VECTORS_SQL.format(k=K)},
        means AS (
          SELECT label, list(x ORDER BY axis) AS centre FROM (
            SELECT label, axis, avg(vec[axis]) AS x
            FROM vecs CROSS JOIN generate_series(1, 64) AS g(axis) GROUP BY label, axis)
          GROUP BY label)
        SELECT id, round({sql}, 6) AS d FROM vecs JOIN means USING (label)""",
    )
    def run(spark, sf):
        points = vectors(spark, sf).withColumnRenamed("label", "cid")
        centres = kmeans.centroid_update(points).withColumnRenamed("vec", "centre")
        d = on_arrays("vec", "centre")
        return points.join(centres, "cid").select("id", F.round(d, 6).alias("d"))


_to_centre("cosine_distance", dist.array_cosine, "1 - list_cosine_similarity(vec, centre)")
_to_centre("euclidean_vectors", dist.array_euclidean, "list_distance(vec, centre)")
_to_centre(
    "manhattan_vectors",
    dist.array_manhattan,
    "list_sum(list_transform(generate_series(1, len(vec)), lambda i: abs(vec[i] - centre[i])))",
)


#: Radius by distance at which vectors have a few neighbours each, and how many make a core.
VECTOR_EPS = {"euclidean": 1.2, "cosine": 0.72}
VECTOR_NEIGHBOURS = 5

_VECTOR_PAIRS = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
pairs AS MATERIALIZED (
  SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id <> b.id WHERE {d}(a.vec, b.vec) < {eps}),
core AS MATERIALIZED (SELECT i AS p, list(j) AS near FROM pairs GROUP BY i HAVING count(*) >= {m}),"""

_VECTOR_CLUSTERS = {
    "one_hop": """
seeds(p, taken) AS (
  SELECT min(p), [min(p)] FROM core
  UNION ALL
  SELECT min(c.p), list_append(s.taken, min(c.p))
  FROM seeds s JOIN core c ON c.p > s.p AND NOT list_has_any(c.near, s.taken) GROUP BY s.taken)
SELECT id, min(p) AS cluster_id
FROM (SELECT p AS id, p FROM seeds UNION ALL SELECT j, p FROM seeds JOIN pairs ON i = p) GROUP BY id""",
    "dbscan": """
edges AS (SELECT i AS a, j AS b FROM pairs WHERE i IN (SELECT p FROM core) AND j IN (SELECT p FROM core)),
reach(a, b) AS (SELECT p, p FROM core UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS p, min(b) AS cluster_id FROM reach GROUP BY a)
SELECT p AS id, cluster_id FROM roots
UNION ALL
SELECT j, min(cluster_id) FROM pairs JOIN roots ON i = p WHERE j NOT IN (SELECT p FROM core) GROUP BY j""",
}


def _vector_clusters(distance: str, mode: str) -> None:
    function = {"euclidean": "list_distance", "cosine": "list_cosine_distance"}[distance]
    pairs = _VECTOR_PAIRS.format(d=function, eps=VECTOR_EPS[distance], m=VECTOR_NEIGHBOURS)

    @query(f"vector_clusters_{distance}_{mode}", "WITH RECURSIVE" + pairs + _VECTOR_CLUSTERS[mode])
    def run(spark, sf):
        return cluster_vectors(vectors(spark, sf), VECTOR_EPS[distance], VECTOR_NEIGHBOURS, mode, distance)


for _distance in VECTOR_EPS:
    for _mode in _VECTOR_CLUSTERS:
        _vector_clusters(_distance, _mode)
