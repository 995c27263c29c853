"""Tables the queries read: the stored ones, and geo posts derived from ``events``.

Coordinates are whole numbers divided once, so any engine gets the same doubles. Each
author has five clumps of posts. ``visits`` are the same points with authors cut finer,
so that most have only a few posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geotext.plans.homes import Settings

EPS = (0.05, 0.1, 0.2)
MIN_NEIGHBOURS = (1, 3, 5)
GRID = Settings(eps_values=EPS, min_neighbours=MIN_NEIGHBOURS)

#: As many configurations as the full search has, at sizes where the derived posts have neighbours.
FULL_EPS = (0.02, 0.05, 0.1, 0.2)
FULL_MIN_NEIGHBOURS = (1, 2, 3, 5, 10)
FULL_GRID = Settings(eps_values=FULL_EPS, min_neighbours=FULL_MIN_NEIGHBOURS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geo posts with the author's stated place."""
    user, event = F.col("user_id"), F.col("event_id")
    home_lat = F.lit(400000) + (user % 50) * 1000
    home_lon = F.lit(-800000) + (user % 70) * 1000
    return table(spark, sf_dir, "events").select(
        user,
        event.alias("post_id"),
        ((home_lat + (event % 5) * 200 + (event * 7) % 37) / 10000).alias("lat"),
        ((home_lon + (event % 5) * 300 + (event * 11) % 41) / 10000).alias("lon"),
        (home_lat / 10000).alias("home_lat"),
        (home_lon / 10000).alias("home_lon"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("user_id", "post_id", "lat", "lon")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts with one author per user and stretch of 400 events."""
    author = F.col("user_id") * 1000000 + F.floor(F.col("post_id") / 400)
    return posts(spark, sf_dir).withColumn("user_id", author)


POSTS_SQL = """
posts AS (
  SELECT user_id, event_id AS post_id,
    CAST(400000 + (user_id % 50) * 1000 + (event_id % 5) * 200 + (event_id * 7) % 37 AS DOUBLE) / 10000 AS lat,
    CAST(-800000 + (user_id % 70) * 1000 + (event_id % 5) * 300 + (event_id * 11) % 41 AS DOUBLE) / 10000 AS lon,
    CAST(400000 + (user_id % 50) * 1000 AS DOUBLE) / 10000 AS home_lat,
    CAST(-800000 + (user_id % 70) * 1000 AS DOUBLE) / 10000 AS home_lon
  FROM events)"""

VISITS_SQL = (
    POSTS_SQL.replace("posts AS", "raw_posts AS")
    + """,
posts AS (
  SELECT * REPLACE (user_id * 1000000 + post_id // 400 AS user_id) FROM raw_posts)"""
)

TRUTH_SQL = """
truth AS (
  SELECT user_id, arg_min(home_lat, post_id) AS lat, arg_min(home_lon, post_id) AS lon
  FROM posts GROUP BY user_id)"""


def km_sql(a: str, b: str) -> str:
    """Great-circle kilometres between two aliases with lat and lon."""
    return f"""(2 * 6372.8 * asin(least(1.0, sqrt(
      pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
      + pow(sin(radians({b}.lon - {a}.lon) / 2), 2) * cos(radians({a}.lat)) * cos(radians({b}.lat))))))"""


def _grid_sql(eps_values: tuple[float, ...], min_neighbours: tuple[int, ...]) -> str:
    rows = ", ".join(f"(CAST({e} AS DOUBLE), {m})" for e in eps_values for m in min_neighbours)
    return f"grid(eps, m) AS (VALUES {rows})"


GRID_SQL = _grid_sql(EPS, MIN_NEIGHBOURS)
FULL_GRID_SQL = _grid_sql(FULL_EPS, FULL_MIN_NEIGHBOURS)

PAIRS_SQL = f"""
pairs AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.user_id, a.post_id AS i, b.post_id AS j, {km_sql('a', 'b')} AS d
    FROM posts a JOIN posts b ON a.user_id = b.user_id AND a.post_id <> b.post_id)
  WHERE d < {max(EPS)})"""

CORE_SQL = """
core AS MATERIALIZED (
  SELECT eps, m, user_id, i AS p, list(j) AS near
  FROM pairs JOIN grid ON d < eps GROUP BY eps, m, user_id, i HAVING count(*) >= m)"""

# Each step takes the next core post with no seed near it.
SEEDS_SQL = """
seed_steps(eps, m, user_id, p, taken) AS (
  SELECT eps, m, user_id, min(p), [min(p)] FROM core GROUP BY eps, m, user_id
  UNION ALL
  SELECT s.eps, s.m, s.user_id, min(c.p), list_append(s.taken, min(c.p))
  FROM seed_steps s JOIN core c ON c.eps = s.eps AND c.m = s.m AND c.user_id = s.user_id
    AND c.p > s.p AND NOT list_has_any(c.near, s.taken)
  GROUP BY s.eps, s.m, s.user_id, s.taken),
seeds AS (SELECT eps, m, user_id, p FROM seed_steps),
labels AS (
  SELECT eps, m, user_id, post_id, min(p) AS cluster_id FROM (
    SELECT eps, m, user_id, p AS post_id, p FROM seeds
    UNION ALL
    SELECT s.eps, s.m, s.user_id, j AS post_id, p
    FROM seeds s JOIN pairs ON pairs.user_id = s.user_id AND i = p AND d < eps)
  GROUP BY eps, m, user_id, post_id)"""

CENTRES_SQL = """
centres AS (
  SELECT eps, m, user_id, cluster_id, avg(lat) AS lat, avg(lon) AS lon
  FROM labels JOIN posts USING (user_id, post_id) GROUP BY eps, m, user_id, cluster_id)"""

CANDIDATES_SQL = """
sizes AS (SELECT user_id, count(*) AS n FROM posts GROUP BY user_id),
candidates AS (
  SELECT * FROM centres
  UNION ALL
  SELECT eps, m, user_id, post_id AS cluster_id, lat, lon
  FROM posts JOIN sizes USING (user_id) JOIN grid ON n < m)"""


def clustering_sql(select: str, source: str = POSTS_SQL, *more: str) -> str:
    """The recursive one-hop clustering, followed by a query over its tables."""
    parts = [source, GRID_SQL, PAIRS_SQL, CORE_SQL, SEEDS_SQL, *more]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
