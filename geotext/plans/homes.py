"""Home locations: candidates from each author's posts, scored against where they say they live."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from geotext.functions.distance import distance as distance_by_name
from geotext.functions.scores import combined_score, percentage
from geotext.operators.cells import Geometry
from geotext.operators.centres import cluster_centres
from geotext.operators.density import FOLD_SITES, Sites, cluster_sites, split_sites
from geotext.operators.skew import attach
from geotext.session import cut

# The parameter grid the reference results are stated for. The unit of eps
# is that of the distance: kilometres under haversine, degrees under euclidean.
DEFAULT_EPS = (1e-6, 1e-5, 1e-4, 1e-3)
DEFAULT_MIN_NEIGHBOURS = (1, 2, 3, 5, 10)


@dataclass(frozen=True)
class Settings:
    """How homes are predicted and scored."""

    eps_values: Sequence[float] = DEFAULT_EPS
    min_neighbours: Sequence[int] = DEFAULT_MIN_NEIGHBOURS
    centre: str = "mean"  # or "median"
    distance: str = "haversine"  # or "euclidean", "manhattan"
    mode: str = "one_hop"  # or "dbscan"
    small_group: str = "passthrough"  # or "drop": authors with fewer than m posts
    by: str = "user_id"
    key: str = "post_id"
    fold_sites: int = FOLD_SITES

    @property
    def geometry(self) -> Geometry:
        return Geometry(self.distance)


def author_truth(posts: DataFrame, by: str = "user_id", key: str = "post_id") -> DataFrame:
    """Each author's stated place: that of their earliest post."""
    place = F.struct("home_lat", "home_lon")
    return (
        posts.groupBy(by)
        .agg(F.min_by(place, F.col(key)).alias("p"))
        .select(by, F.col("p.home_lat").alias("lat"), F.col("p.home_lon").alias("lon"))
    )


def min_rows_gate(
    points: DataFrame, min_rows: int, by: str = "user_id", rows: int | None = None
) -> DataFrame:
    """Mark each point with ``clustered``: whether its author has at least ``min_rows`` points."""
    sizes = points.groupBy(by).agg(F.count(F.lit(1)).alias("n_points"))
    return attach(points, sizes, [by], rows=rows, count="n_points").withColumn(
        "clustered", F.col("n_points") >= min_rows
    )


def _small_authors(points: DataFrame, s: Settings, most_posts: int) -> DataFrame:
    """Points of authors with too few posts for some m of the grid, with that author's count."""
    sizes = points.groupBy(s.by).agg(F.count(F.lit(1)).alias("n_points"))
    few = sizes.where(F.col("n_points") < max(s.min_neighbours))
    return attach(points, few, [s.by], rows=most_posts)


def _grid(s: Settings) -> Column:
    return F.array(
        *[
            F.struct(F.lit(float(e)).alias("eps"), F.lit(int(m)).alias("m"))
            for e in s.eps_values
            for m in s.min_neighbours
        ]
    )


def on_grid(scores: DataFrame, s: Settings) -> DataFrame:
    """Every configuration of the grid, also those that have no row in ``scores``."""
    grid = scores.sparkSession.range(1).select(F.inline(_grid(s)))
    return grid.join(scores, ["eps", "m"], "left")


def cluster_candidates(sites: Sites, s: Settings) -> DataFrame:
    """Cluster centres of all authors: ``(eps, m, by, cluster_id, lat, lon)``.

    An author with fewer than m posts has no core post, so no gate is needed here.
    """
    labels = cluster_sites(
        sites, s.eps_values, s.min_neighbours, s.mode, s.by, s.geometry, s.fold_sites
    )
    centres = cluster_centres(labels, s.by, s.centre)
    # Large authors come out of checkpointed rounds: store their centres before counting them.
    return centres if sites.large is None else cut(centres)


def _most_candidates(sites: Sites, s: Settings) -> int | None:
    """A bound on one author's candidates, if no author is large."""
    if sites.large is not None:
        return None
    return s.fold_sites * len(s.eps_values) * len(s.min_neighbours)


def predict_homes(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Candidate homes ``(eps, m, by, cluster_id, lat, lon)`` for every point of the grid.

    An author with fewer than m posts gets each post as a candidate, with the post id as
    cluster id. An author with exactly m posts cannot have a core post and gets none.
    """
    sites = split_sites(points, s.by, s.key, s.fold_sites)
    centres = cluster_candidates(sites, s)
    if s.small_group == "drop":
        return centres
    raw = (
        _small_authors(points, s, sites.most_posts)
        .select("*", F.inline(_grid(s)))
        .where(F.col("n_points") < F.col("m"))
        .select("eps", "m", s.by, F.col(s.key).alias("cluster_id"), "lat", "lon")
    )
    return centres.unionByName(raw)


def nearest_candidate(
    candidates: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    s: Settings = Settings(),
    rows: int | None = None,
) -> DataFrame:
    """Per key, the candidate nearest to the author's true place, ties by lat then lon.

    Authors without a known place stay, with a NULL distance.
    """
    d = distance_by_name(s.distance).on_points("lat", "lon", "true_lat", "true_lon")
    known = truth.select(s.by, F.col("lat").alias("true_lat"), F.col("lon").alias("true_lon"))
    best = F.min(F.struct(d.alias("d"), F.col("lat"), F.col("lon")))
    return (
        attach(candidates, known, [s.by], "left", rows)
        .groupBy(*keys, s.by)
        .agg(best.alias("best"))
        .select(*keys, s.by, "best.d", "best.lat", "best.lon")
    )


def evaluate_homes(
    candidates: DataFrame,
    truth: DataFrame,
    keys: Sequence[str] = ("eps", "m"),
    s: Settings = Settings(),
    rows: int | None = None,
) -> DataFrame:
    """Mean distance from truth to the nearest candidate, over authors with a candidate."""
    nearest = nearest_candidate(candidates, truth, keys, s, rows)
    return nearest.groupBy(*keys).agg(
        F.avg("d").alias("error"), F.count(F.lit(1)).alias("n_nonempty")
    )


def coverage(candidates: DataFrame, points: DataFrame, truth: DataFrame, by: str = "user_id") -> DataFrame:
    """Percent of authors that are listed, and that have a candidate, against those with a truth.

    ``listed`` counts every author with posts, also one whose list of candidates is empty.
    """
    listed = points.agg(F.count_distinct(by)).scalar()
    nonempty = candidates.agg(F.count_distinct(by)).scalar()
    return (
        truth.agg(F.count(F.lit(1)).alias("n_total"))
        .withColumns({"n_listed": listed, "n_nonempty": nonempty})
        .withColumns(
            {
                "pct_listed": percentage("n_listed", "n_total"),
                "pct_nonempty": percentage("n_nonempty", "n_total"),
            }
        )
    )


def grid_search(
    points: DataFrame,
    truth: DataFrame,
    s: Settings = Settings(),
    score_on: str = "pct_listed",
    empty_error: float | None = None,
) -> DataFrame:
    """Error, coverage and score of every (eps, m), in one plan.

    ``empty_error`` is the error of a configuration that predicts nothing: None means it
    has no score and cannot win, 0.0 makes it score as if it were exact.
    """
    keys = ["eps", "m"]
    sites = split_sites(points, s.by, s.key, s.fold_sites)
    per_author = nearest_candidate(
        cluster_candidates(sites, s), truth, keys, s, _most_candidates(sites, s)
    )
    if s.small_group == "passthrough":
        # A small author's nearest post is the same for every (eps, m): find it once.
        small = _small_authors(points, s, sites.most_posts)
        few = nearest_candidate(small, truth, ["n_points"], s, max(s.min_neighbours))
        per_author = per_author.unionByName(
            few.select("*", F.inline(_grid(s)))
            .where(F.col("n_points") < F.col("m"))
            .drop("n_points")
        )
    scores = per_author.groupBy(*keys).agg(
        F.avg("d").alias("error"), F.count(F.lit(1)).alias("n_nonempty")
    )
    totals = truth.agg(F.count(F.lit(1))).scalar()
    listed = points.agg(F.count_distinct(s.by)).scalar()
    error = F.col("error") if empty_error is None else F.coalesce("error", F.lit(empty_error))
    return (
        on_grid(scores, s)
        .withColumns(
            {
                "error": error,
                "n_nonempty": F.coalesce("n_nonempty", F.lit(0)),
                "n_listed": listed,
                "pct_listed": percentage(listed, totals),
            }
        )
        .withColumn("pct_nonempty", percentage(F.col("n_nonempty"), totals))
        .withColumn("score", combined_score("error", score_on))
        .select(
            *keys, "error", "n_listed", "n_nonempty", "pct_listed", "pct_nonempty", "score"
        )
    )


def best_config(scores: DataFrame, score_on: str = "pct_listed") -> DataFrame:
    """The highest score with any coverage; ties go to the smallest eps, then the smallest m."""
    return (
        scores.where((F.col(score_on) > 0) & F.col("score").isNotNull())
        .orderBy(F.desc("score"), "eps", "m")
        .limit(1)
    )
