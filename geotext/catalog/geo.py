"""Queries over geo posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotext.catalog.inputs import (
    CANDIDATES_SQL,
    CENTRES_SQL,
    FULL_GRID,
    FULL_GRID_SQL,
    GRID,
    GRID_SQL,
    POSTS_SQL,
    TRUTH_SQL,
    VISITS_SQL,
    clustering_sql,
    km_sql,
    points,
    posts,
    table,
    visits,
)
from geotext.catalog.registry import query
from geotext.functions import distance as dist
from geotext.functions.scores import combined_score
from geotext.operators.centres import cluster_centres
from geotext.operators.density import cluster_sites, density_cluster, split_sites
from geotext.operators.neighbours import neighbour_count, neighbour_join
from geotext.operators.ordered import collect_chunks
from geotext.operators.rows import map_columns
from geotext.plans import homes
from geotext.sources.posts import cast_geo, count_rejects, points_of

EPS = 0.1
ROUND = 6
# Coordinates have four decimals, so means of up to 31 posts cannot lie half-way at eight.
ROUND_CENTRE = 8


def _rounded(df, *columns, to=ROUND):
    return df.withColumns({c: F.round(c, to) for c in columns})


def _rounded_quickly(df, column, to=ROUND):
    """As ``_rounded``, at a small part of its cost a row: decimals only where the value is near half-way."""
    scaled = F.col(column) * 10.0**to
    plain = F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4
    quick = F.when(plain & scaled.between(0, 1e9), F.abs(F.rint(scaled)) / 10.0**to)
    return df.withColumn(column, quick.otherwise(F.round(column, to)))


def _as_stored(posts_df):
    """Geo posts as their source holds them: every field a string."""
    names = {
        "post_id": "post_id",
        "user_id": "user_id",
        "lat": "tweet_latitude",
        "lon": "tweet_longitude",
        "home_lat": "user_city_latitude",
        "home_lon": "user_city_longitude",
    }
    return posts_df.select(*[F.col(a).cast("string").alias(b) for a, b in names.items()])


@query("cast_geo", f"WITH {POSTS_SQL} SELECT user_id, post_id, lat, lon, home_lat, home_lon FROM posts")
def cast_geo_query(spark, sf):
    return cast_geo(_as_stored(posts(spark, sf)))


@query(
    "cast_geo_lenient",
    """SELECT count(*) FILTER (event_type = 'error' OR value IS NULL) AS rejected FROM events""",
)
def cast_geo_lenient_query(spark, sf):
    """Counts the posts a lenient cast drops, on a copy with words among the latitudes."""
    value = F.col("value").cast("string")
    raw = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(value).alias(
            "tweet_latitude"
        ),
        value.alias("tweet_longitude"),
        value.alias("user_city_latitude"),
        value.alias("user_city_longitude"),
    )
    return count_rejects(raw)


@query(
    "points_per_author",
    f"""WITH {POSTS_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id) - 1 AS pos FROM posts)
    SELECT user_id, CAST(pos // 50 AS BIGINT) AS chunk, count(*) AS n,
      string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY post_id) AS post_ids,
      round(arg_min(lat, post_id), 6) AS first_lat, round(arg_max(lon, post_id), 6) AS last_lon
    FROM numbered GROUP BY ALL""",
)
def points_per_author_query(spark, sf):
    point = F.struct("post_id", "lat", "lon")
    chunks = collect_chunks(points(spark, sf), ["user_id"], point, ["post_id"], chunk_rows=50)
    items = F.col("items")
    ids = F.transform(items, lambda p: p["post_id"].cast("string"))
    return chunks.select(
        "user_id",
        "chunk",
        F.size(items).cast("long").alias("n"),
        F.array_join(ids, ",").alias("post_ids"),
        F.round(items[0]["lat"], ROUND).alias("first_lat"),
        F.round(F.element_at(items, -1)["lon"], ROUND).alias("last_lon"),
    )


@query("author_truth", f"WITH {POSTS_SQL}, {TRUTH_SQL} SELECT * FROM truth")
def author_truth_query(spark, sf):
    return homes.author_truth(posts(spark, sf))


def _home_distance(name: str, sql: str) -> None:
    @query(
        name,
        f"""WITH {POSTS_SQL},
        a AS (SELECT post_id, lat, lon, home_lat, home_lon FROM posts)
        SELECT post_id, round({sql}, 6) AS d FROM a""",
    )
    def run(spark, sf):
        between = {
            "haversine_km": dist.haversine_km,
            "euclidean": dist.euclidean,
            "manhattan": dist.manhattan,
        }[name]
        d = between("lat", "lon", "home_lat", "home_lon")
        return posts(spark, sf).select("post_id", F.round(d, ROUND).alias("d"))


_home_distance(
    "haversine_km",
    """2 * 6372.8 * asin(least(1.0, sqrt(pow(sin(radians(home_lat - lat) / 2), 2)
      + pow(sin(radians(home_lon - lon) / 2), 2) * cos(radians(lat)) * cos(radians(home_lat)))))""",
)
_home_distance("euclidean", "sqrt(pow(lat - home_lat, 2) + pow(lon - home_lon, 2))")
_home_distance("manhattan", "abs(lat - home_lat) + abs(lon - home_lon)")


@query(
    "degrees_to_km",
    f"""WITH {POSTS_SQL}
    SELECT round(sqrt(pow(lat - home_lat, 2) + pow(lon - home_lon, 2)) / 180 * pi() * 6372.8, 6) AS km
    FROM posts""",
)
def degrees_to_km_query(spark, sf):
    def km(lat, lon, home_lat, home_lon):
        return F.round(dist.degrees_to_km(dist.euclidean(lat, lon, home_lat, home_lon)), ROUND)

    return map_columns(posts(spark, sf), ["lat", "lon", "home_lat", "home_lon"], km, "km")


@query(
    "neighbour_join",
    f"""WITH {POSTS_SQL}
    SELECT user_id, i, j, round(d, 6) AS d FROM (
      SELECT a.user_id, a.post_id AS i, b.post_id AS j, {km_sql('a', 'b')} AS d
      FROM posts a JOIN posts b ON a.user_id = b.user_id AND a.post_id <> b.post_id)
    WHERE d < {EPS}""",
)
def neighbour_join_query(spark, sf):
    return _rounded_quickly(neighbour_join(points(spark, sf), EPS), "d")


@query(
    "neighbour_join_grid",
    f"""WITH {POSTS_SQL}
    SELECT i, j, round(d, 6) AS d FROM (
      SELECT a.post_id AS i, b.post_id AS j, {km_sql('a', 'b')} AS d
      FROM posts a JOIN posts b ON a.post_id <> b.post_id AND abs(a.lat - b.lat) < 0.001)
    WHERE d < {EPS}""",
)
def neighbour_join_grid_query(spark, sf):
    """Posts of any author near one another: no group key narrows the join, only the tiles."""
    return _rounded_quickly(neighbour_join(points(spark, sf), EPS, by=None), "d")


@query(
    "neighbour_count",
    f"""WITH {POSTS_SQL}
    SELECT p.user_id, p.post_id, count(j) AS k FROM posts p LEFT JOIN (
      SELECT a.post_id AS i, b.post_id AS j
      FROM posts a JOIN posts b ON a.user_id = b.user_id AND a.post_id <> b.post_id
      WHERE {km_sql('a', 'b')} < {EPS}) n ON n.i = p.post_id
    GROUP BY p.user_id, p.post_id""",
)
def neighbour_count_query(spark, sf):
    return neighbour_count(points(spark, sf), EPS)


@query(
    "is_core",
    f"""WITH {POSTS_SQL}
    SELECT p.user_id, p.post_id, count(j) >= 3 AS is_core FROM posts p LEFT JOIN (
      SELECT a.post_id AS i, b.post_id AS j
      FROM posts a JOIN posts b ON a.user_id = b.user_id AND a.post_id <> b.post_id
      WHERE {km_sql('a', 'b')} < {EPS}) n ON n.i = p.post_id
    GROUP BY p.user_id, p.post_id""",
)
def is_core_query(spark, sf):
    counted = neighbour_count(points(spark, sf), EPS)
    return counted.select("user_id", "post_id", (F.col("k") >= 3).alias("is_core"))


@query("density_cluster_one_hop", clustering_sql("SELECT * FROM labels"))
def density_cluster_one_hop_query(spark, sf):
    return density_cluster(points(spark, sf), GRID.eps_values, GRID.min_neighbours)


@query(
    "density_cluster_dbscan",
    clustering_sql("SELECT * FROM dbscan", POSTS_SQL).replace(
        "SELECT * FROM dbscan",
        """, reach(eps, m, user_id, p, q) AS (
      SELECT eps, m, user_id, p, p FROM core
      UNION
      SELECT r.eps, r.m, r.user_id, r.p, c.p
      FROM reach r JOIN pairs ON pairs.user_id = r.user_id AND pairs.i = r.q AND pairs.d < r.eps
      JOIN core c ON c.eps = r.eps AND c.m = r.m AND c.user_id = r.user_id AND c.p = pairs.j),
    comp AS (SELECT eps, m, user_id, p, min(q) AS cluster_id FROM reach GROUP BY eps, m, user_id, p)
    SELECT eps, m, user_id, p AS post_id, cluster_id FROM comp
    UNION ALL
    SELECT c.eps, c.m, c.user_id, j AS post_id, min(cluster_id) AS cluster_id
    FROM comp c JOIN pairs ON pairs.user_id = c.user_id AND i = p AND d < eps
    WHERE NOT EXISTS (SELECT 1 FROM core k WHERE k.eps = c.eps AND k.m = c.m AND k.p = j)
    GROUP BY c.eps, c.m, c.user_id, j""",
    ),
)
def density_cluster_dbscan_query(spark, sf):
    return density_cluster(points(spark, sf), GRID.eps_values, GRID.min_neighbours, mode="dbscan")


def _centres(spark, sf, method):
    sites = split_sites(points(spark, sf))
    labels = cluster_sites(sites, GRID.eps_values, GRID.min_neighbours)
    return _rounded(cluster_centres(labels, method=method), "lat", "lon", to=ROUND_CENTRE)


_CENTRES = "SELECT eps, m, user_id, cluster_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM centres"


@query("cluster_centre_mean", clustering_sql(_CENTRES, POSTS_SQL, CENTRES_SQL))
def cluster_centre_mean_query(spark, sf):
    return _centres(spark, sf, "mean")


@query(
    "cluster_centre_median",
    clustering_sql(_CENTRES, POSTS_SQL, CENTRES_SQL.replace("avg(", "median(")),
)
def cluster_centre_median_query(spark, sf):
    return _centres(spark, sf, "median")


@query(
    "run_density",
    clustering_sql(
        _CENTRES,
        POSTS_SQL,
        CENTRES_SQL,
    ),
)
def run_density_query(spark, sf):
    sites = split_sites(points(spark, sf))
    return _rounded(homes.cluster_candidates(sites, GRID), "lat", "lon", to=ROUND_CENTRE)


@query(
    "min_rows_gate",
    f"""WITH {VISITS_SQL}, sizes AS (SELECT user_id, count(*) AS n_points FROM posts GROUP BY user_id)
    SELECT user_id, post_id, n_points, n_points >= 3 AS clustered FROM posts JOIN sizes USING (user_id)""",
)
def min_rows_gate_query(spark, sf):
    gated = homes.min_rows_gate(visits(spark, sf), 3)
    return gated.select("user_id", "post_id", "n_points", "clustered")


_CANDIDATES = """SELECT eps, m, user_id, cluster_id, round(lat, 8) AS lat, round(lon, 8) AS lon
  FROM candidates"""


@query("predict_homes", clustering_sql(_CANDIDATES, VISITS_SQL, CENTRES_SQL, CANDIDATES_SQL))
def predict_homes_query(spark, sf):
    candidates = homes.predict_homes(points_of(visits(spark, sf)), GRID)
    return _rounded(candidates, "lat", "lon", to=ROUND_CENTRE)


@query(
    "drop_empty_predictions",
    clustering_sql(
        "SELECT DISTINCT eps, m, user_id FROM candidates", VISITS_SQL, CENTRES_SQL, CANDIDATES_SQL
    ),
)
def drop_empty_predictions_query(spark, sf):
    candidates = homes.predict_homes(points_of(visits(spark, sf)), GRID)
    return candidates.select("eps", "m", "user_id").distinct()


_NEAREST_SQL = f"""
nearest AS (
  SELECT c.eps, c.m, c.user_id, min(d) AS d, arg_min(c.lat, (d, c.lat, c.lon)) AS lat,
    arg_min(c.lon, (d, c.lat, c.lon)) AS lon
  FROM (SELECT candidates.*, {km_sql('candidates', 'truth')} AS d
        FROM candidates JOIN truth USING (user_id)) c
  GROUP BY c.eps, c.m, c.user_id)"""

_EVALUATION = (CENTRES_SQL, CANDIDATES_SQL, TRUTH_SQL, _NEAREST_SQL)


def _predicted(spark, sf):
    """Candidates and truth of the finer authors."""
    made = visits(spark, sf)
    return homes.predict_homes(points_of(made), GRID), homes.author_truth(made), points_of(made)


@query(
    "join_truth_predictions",
    clustering_sql(
        """SELECT eps, m, user_id, cluster_id, round(c.lat, 8) AS lat, round(c.lon, 8) AS lon,
          truth.lat AS true_lat, truth.lon AS true_lon FROM candidates c JOIN truth USING (user_id)""",
        VISITS_SQL,
        *_EVALUATION[:3],
    ),
)
def join_truth_predictions_query(spark, sf):
    candidates, truth, _ = _predicted(spark, sf)
    renamed = truth.withColumnsRenamed({"lat": "true_lat", "lon": "true_lon"})
    return _rounded(candidates.join(renamed, "user_id"), "lat", "lon", to=ROUND_CENTRE)


@query(
    "nearest_candidate",
    clustering_sql(
        "SELECT eps, m, user_id, round(d, 6) AS d, round(lat, 8) AS lat, round(lon, 8) AS lon FROM nearest",
        VISITS_SQL,
        *_EVALUATION,
    ),
)
def nearest_candidate_query(spark, sf):
    candidates, truth, _ = _predicted(spark, sf)
    nearest = homes.nearest_candidate(candidates, truth, ["eps", "m"], GRID)
    nearest = _rounded(nearest, "lat", "lon", to=ROUND_CENTRE)
    return _rounded(nearest.select("eps", "m", "user_id", "d", "lat", "lon"), "d")


@query(
    "mean_error",
    clustering_sql(
        "SELECT eps, m, round(avg(d), 6) AS error FROM nearest GROUP BY eps, m",
        VISITS_SQL,
        *_EVALUATION,
    ),
)
def mean_error_query(spark, sf):
    candidates, truth, _ = _predicted(spark, sf)
    scored = homes.evaluate_homes(candidates, truth, s=GRID)
    return _rounded(scored.select("eps", "m", "error"), "error")


_M3 = homes.Settings(eps_values=(EPS,), min_neighbours=(3,))


@query(
    "coverage",
    clustering_sql(
        f"""SELECT n_total, n_listed, n_nonempty, round(100.0 * n_listed / n_total, 6) AS pct_listed,
          round(100.0 * n_nonempty / n_total, 6) AS pct_nonempty
        FROM (SELECT (SELECT count(*) FROM truth) AS n_total, (SELECT count(*) FROM sizes) AS n_listed,
          (SELECT count(DISTINCT user_id) FROM candidates WHERE eps = {EPS} AND m = 3) AS n_nonempty)""",
        VISITS_SQL,
        *_EVALUATION[:3],
    ),
)
def coverage_query(spark, sf):
    made = visits(spark, sf)
    candidates = homes.predict_homes(points_of(made), _M3)
    covered = homes.coverage(candidates, points_of(made), homes.author_truth(made))
    return _rounded(covered, "pct_listed", "pct_nonempty")


_SCORES_SQL = """
scores AS (
  SELECT eps, m, error, n_listed, coalesce(n_nonempty, 0) AS n_nonempty,
    100.0 * n_listed / n_total AS pct_listed, 100.0 * coalesce(n_nonempty, 0) / n_total AS pct_nonempty,
    1 / (1 + error) + 100.0 * n_listed / n_total / 100 AS score
  FROM grid
  LEFT JOIN (SELECT eps, m, avg(d) AS error, count(*) AS n_nonempty FROM nearest GROUP BY eps, m)
    USING (eps, m)
  CROSS JOIN (SELECT (SELECT count(*) FROM sizes) AS n_listed, (SELECT count(*) FROM truth) AS n_total))"""

_SCORES = """SELECT eps, m, round(error, 6) AS error, n_listed, n_nonempty,
  round(pct_listed, 6) AS pct_listed, round(pct_nonempty, 6) AS pct_nonempty, round(score, 6) AS score
  FROM scores"""


def _rounded_scores(scores):
    return _rounded(scores, "error", "pct_listed", "pct_nonempty", "score")


def _searched(made):
    return homes.grid_search(points_of(made), homes.author_truth(made), GRID)


@query("grid_search", clustering_sql(_SCORES, POSTS_SQL, *_EVALUATION, _SCORES_SQL))
def grid_search_query(spark, sf):
    return _rounded_scores(_searched(posts(spark, sf)))


@query(
    "grid_search_full",
    clustering_sql(_SCORES, POSTS_SQL, *_EVALUATION, _SCORES_SQL).replace(GRID_SQL, FULL_GRID_SQL),
)
def grid_search_full_query(spark, sf):
    """Four distances by five numbers of neighbours."""
    made = posts(spark, sf)
    return _rounded_scores(homes.grid_search(points_of(made), homes.author_truth(made), FULL_GRID))


@query("grid_search_small_authors", clustering_sql(_SCORES, VISITS_SQL, *_EVALUATION, _SCORES_SQL))
def grid_search_small_authors_query(spark, sf):
    return _rounded_scores(_searched(visits(spark, sf)))


@query(
    "best_config",
    clustering_sql(
        _SCORES + " ORDER BY scores.score DESC NULLS LAST, eps, m LIMIT 1",
        POSTS_SQL,
        *_EVALUATION,
        _SCORES_SQL,
    ),
)
def best_config_query(spark, sf):
    return _rounded_scores(homes.best_config(_searched(posts(spark, sf))))


@query(
    "combined_score",
    clustering_sql(
        "SELECT eps, m, round(score, 6) AS score FROM scores", VISITS_SQL, *_EVALUATION, _SCORES_SQL
    ),
)
def combined_score_query(spark, sf):
    candidates, truth, all_points = _predicted(spark, sf)
    scored = homes.on_grid(homes.evaluate_homes(candidates, truth, s=GRID), GRID)
    covered = homes.coverage(candidates, all_points, truth).select("pct_listed").scalar()
    score = combined_score(F.col("error"), covered)
    return scored.select("eps", "m", F.round(score, ROUND).alias("score"))
