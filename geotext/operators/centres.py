"""Cluster centres from labelled sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geotext.operators.ordered import running_totals
from geotext.operators.skew import attach
from geotext.session import cut

MEDIAN_SITES = 100_000


def cluster_centres(
    labels: DataFrame, by: str = "user_id", method: str = "mean", median_sites: int = MEDIAN_SITES
) -> DataFrame:
    """``(eps, m, by, cluster_id, lat, lon)``, the mean or per-axis median of each cluster's posts.

    Longitudes are averaged as plain numbers: a cluster across 180 degrees is not unwrapped.
    """
    keys = ["eps", "m", by, "cluster_id"]
    if method == "mean":
        weight = F.sum("weight")
        return labels.groupBy(*keys).agg(
            (F.sum(F.col("lat") * F.col("weight")) / weight).alias("lat"),
            (F.sum(F.col("lon") * F.col("weight")) / weight).alias("lon"),
        )
    if method != "median":
        raise ValueError(f"unknown centre method {method!r}")
    labels = cut(labels)  # sized first, then read
    sizes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("sites"))
    if (sizes.agg(F.max("sites")).first()[0] or 0) <= median_sites:
        return _median_in_task(labels, keys)
    sized = attach(labels, sizes, keys)
    is_small = F.col("sites") <= median_sites
    small = _median_in_task(sized.where(is_small), keys)
    return small.unionByName(_median_by_rank(sized.where(~is_small).drop("sites"), keys))


def _median_in_task(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Exact weighted median; the aggregate holds the sites of one cluster."""
    return labels.groupBy(*keys).agg(
        F.expr("percentile(lat, 0.5D, weight)").alias("lat"),
        F.expr("percentile(lon, 0.5D, weight)").alias("lon"),
    )


def _median_by_rank(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Exact weighted median by rank: the one or two middle posts of each sorted cluster."""
    halves = labels.groupBy(*keys).agg(F.sum("weight").alias("posts"))
    axes = []
    for axis in ("lat", "lon"):
        ranked = running_totals(labels, {"rank": F.col("weight")}, [axis, "first_id"], keys)
        low, high = F.floor((F.col("posts") + 1) / 2), F.floor((F.col("posts") + 2) / 2)
        first = F.col("rank") - F.col("weight")
        middle = attach(ranked, halves, keys).select(
            *keys,
            F.when((first < low) & (F.col("rank") >= low), F.col(axis)).alias("low"),
            F.when((first < high) & (F.col("rank") >= high), F.col(axis)).alias("high"),
        )
        axes.append(
            middle.groupBy(*keys).agg(((F.max("low") + F.max("high")) / 2).alias(axis))
        )
    return axes[0].join(axes[1], keys)
