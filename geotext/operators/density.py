"""Density clustering of sites, for a whole grid of (eps, min_neighbours) in one plan.

A site is *core* at (eps, m) if at least m other posts of its author lie closer than eps.

``one_hop``: scanning in post order, a core site not yet covered opens a cluster and
covers everything closer than eps. So a seed is a core site with no earlier seed near
it, and every other site joins the earliest seed near it. This is not the textbook
algorithm: clusters do not grow past one hop.

``dbscan``: the textbook algorithm. Clusters are the connected components of core sites;
the other sites join the lowest cluster id among the core sites near them.

A cluster id is the lowest post id of its seed site (one_hop) or core sites (dbscan).
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from geotext.functions.distance import EARTH_RADIUS_KM, distance
from geotext.operators import blocks
from geotext.operators.blocks import linked_cells
from geotext.operators.cells import CELL, TILE, Geometry
from geotext.operators.components import connected_components
from geotext.operators.neighbours import collapse, crowd, meet, place
from geotext.operators.skew import attach
from geotext.session import cut

#: Sites of an author that one task takes whole; dbscan holds a distance for each two of them, 32 MB.
FOLD_SITES = 2_000

#: A block of large authors is three times so many eps wide, with a margin of so many.
BLOCK_RADII = 64
#: Sites of one cell that a block goes through in one round.
CELL_SITES = 8


@dataclass(frozen=True)
class Sites:
    """An author's sites, split by how much one author holds."""

    small: DataFrame  # hashed by author; no author has more than FOLD_SITES sites
    large: DataFrame | None  # the other authors, spread over the cluster
    most_posts: int  # of any one author


def split_sites(
    points: DataFrame, by: str = "user_id", key: str = "post_id", fold_sites: int = FOLD_SITES
) -> Sites:
    """Collapse posts to sites and separate the authors too large for one task."""
    sites = collapse(points, by, key).persist(StorageLevel.DISK_ONLY)
    sizes = sites.groupBy(by).agg(
        F.count(F.lit(1)).alias("author_sites"), F.sum("weight").alias("author_posts")
    )
    largest, posts = sizes.agg(F.max("author_sites"), F.max("author_posts")).first()
    largest, posts = largest or 0, posts or 0
    sizes = sizes.drop("author_posts")
    if largest <= fold_sites:
        split = Sites(_by_author(sites, by), None, posts)
        sites.unpersist()
        return split
    sized = attach(sites, sizes, [by])
    is_small = F.col("author_sites") <= fold_sites
    split = Sites(
        _by_author(sized.where(is_small).drop("author_sites"), by),
        cut(sized.where(~is_small).drop("author_sites")),
        posts,
    )
    sites.unpersist()
    return split


def _by_author(sites: DataFrame, by: str) -> DataFrame:
    """One exchange by author; every later grouping and join on (author, ...) reuses it."""
    hashed = sites.repartition(by).persist(StorageLevel.DISK_ONLY)
    hashed.count()  # a cached table shows its partitioning to the planner once it is filled
    return hashed


def cluster_sites(
    sites: Sites,
    eps_values: Sequence[float],
    min_neighbours: Sequence[int],
    mode: str = "one_hop",
    by: str = "user_id",
    geometry: Geometry = Geometry(),
    fold_sites: int = FOLD_SITES,
) -> DataFrame:
    """Label sites: ``(eps, m, by, first_id, lat, lon, weight, cluster_id)``, noise left out."""
    if mode not in ("one_hop", "dbscan"):
        raise ValueError(f"unknown mode {mode!r}")
    if min(eps_values) <= 0 or min(min_neighbours) < 1:
        raise ValueError("eps must be positive and min_neighbours at least 1")
    label = _one_hop if mode == "one_hop" else _dbscan
    labels = label(sites.small, eps_values, min_neighbours, by, geometry, fold_sites)
    if sites.large is not None:
        labels = labels.unionByName(
            label(sites.large, eps_values, min_neighbours, by, geometry, None)
        )
    return labels


def density_cluster(
    points: DataFrame,
    eps_values: Sequence[float],
    min_neighbours: Sequence[int],
    mode: str = "one_hop",
    by: str = "user_id",
    key: str = "post_id",
    geometry: Geometry = Geometry(),
    fold_sites: int = FOLD_SITES,
) -> DataFrame:
    """Label posts: ``(eps, m, by, key, cluster_id)``, noise left out."""
    sites = split_sites(points, by, key, fold_sites)
    labels = cluster_sites(sites, eps_values, min_neighbours, mode, by, geometry, fold_sites)
    config = F.struct("eps", "m", "cluster_id")
    # One row per site with all its labels: bounded by the grid.
    per_site = labels.groupBy(by, "lat", "lon").agg(F.collect_list(config).alias("labels"))
    posts = points.select(by, key, "lat", "lon")
    return attach(posts, per_site, [by, "lat", "lon"], rows=sites.most_posts).select(
        by, key, F.inline("labels")
    )


def _cores(crowded: DataFrame, min_neighbours: Sequence[int]) -> DataFrame:
    """One row per core site and m."""
    ms = F.array(*[F.lit(int(m)) for m in min_neighbours])
    return crowded.withColumn("m", F.explode(F.filter(ms, lambda m: m <= F.col("k"))))


def _one_hop(sites, eps_values, min_neighbours, by, geometry, fold_sites) -> DataFrame:
    rows = fold_sites
    placed = place(sites, eps_values, geometry)
    if not fold_sites:
        placed = cut(placed)
    crowded = crowd(placed, max(min_neighbours), by, geometry, rows)
    cores = _cores(crowded, min_neighbours)
    if fold_sites:
        seeds = _seeds_by_fold(cores, by, geometry)
    else:
        seeds = _seeds_by_rounds(cores, by, geometry)
    return _join_earliest_seed(placed, seeds, by, geometry, rows)


def _seeds_by_fold(cores: DataFrame, by: str, geometry: Geometry) -> DataFrame:
    """Seeds of authors of bounded size: one ordered pass over each author's core sites."""
    site = F.struct("first_id", "lat", "lon")
    grouped = cores.groupBy("eps_id", "m", by).agg(
        F.max("eps").alias("eps"), F.sort_array(F.collect_list(site)).alias("cores")
    )
    none = F.array().cast("array<struct<first_id:bigint,lat:double,lon:double>>")

    def step(seeds: Column, p: Column) -> Column:
        covered = F.exists(
            seeds, lambda s: geometry.within(s["lat"], s["lon"], p["lat"], p["lon"], F.col("eps"))
        )
        return F.when(covered, seeds).otherwise(F.array_append(seeds, p))

    return grouped.select("eps_id", "eps", "m", by, F.inline(F.aggregate("cores", none, step)))


def _seeds_by_rounds(cores: DataFrame, by: str, geometry: Geometry) -> DataFrame:
    """Seeds of authors of any size, in parallel rounds over large blocks of the map.

    A block is ``3 * BLOCK_RADII`` eps wide and sees a margin around it. In each round a task goes
    through the undecided sites of its block in post order: one that no seed covers, with no
    earlier site near it that waits, is a seed. Sites of the margin wait for their own block.
    Of a crowded cell a block sees the first ``CELL_SITES``, and what comes near the rest and after
    them waits too. So a block's task is bounded, however many sites there are.

    Seeds leave the table with everything they cover, until nothing is left. Rounds follow the number of
    blocks, not of sites, along the longest chain of sites that wait for one another.
    """
    where = ["eps_id", "m", by]
    site = ["eps", "first_id", "lat", "lon"]
    undecided = cut(cores.select(*where, *site, *CELL, *TILE))
    found = cut(undecided.select(*where, *site).limit(0))
    wide = F.col("eps") * BLOCK_RADII
    in_cell = Window.partitionBy(*where, *CELL).orderBy("first_id")
    fold = _block_fold(where, geometry)
    while not undecided.isEmpty():
        seen = undecided.withColumn("_n", F.row_number().over(in_cell)).where(F.col("_n") <= CELL_SITES + 1)
        home = geometry.tile(F.col("lat"), F.col("lon"), wide)
        placed = seen.select(
            *where, *site, (F.col("_n") > CELL_SITES).alias("more"), *[c.alias("_" + n) for n, c in home.items()]
        )
        spread = geometry.spread(placed.withColumn("_wide", wide), "_wide").withColumn(
            "own", (F.col("_" + TILE[0]) == F.col(TILE[0])) & (F.col("_" + TILE[1]) == F.col(TILE[1]))
        )
        schema = undecided.select(*where, *site).schema
        seeds = cut(spread.groupBy(*where, *TILE).applyInPandas(fold, schema))
        found = cut(found.unionByName(seeds))
        # A seed is near itself, so it leaves too.
        covered = meet(undecided, seeds, where, geometry).select(*where, "first_id").distinct()
        undecided = cut(undecided.join(covered, [*where, "first_id"], "left_anti"))
    return found


def _block_fold(where: list[str], geometry: Geometry):
    """The ordered pass over one block's sites: returns its own new seeds."""
    on_rows, round_earth = distance(geometry.distance).on_rows, geometry.distance == "haversine"

    def fold(sites: pd.DataFrame) -> pd.DataFrame:
        sites = sites.sort_values("first_id", ignore_index=True)
        eps, at = float(sites["eps"].iloc[0]), sites[["lat", "lon"]].to_numpy(float)
        if round_earth:
            phi, lam = np.radians(at).T
            x = np.c_[np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)]
            reach = 2 * np.sin(min(eps / (2 * EARTH_RADIUS_KM), np.pi / 2)) * 1.001
        else:
            x, reach = at, eps * 1.001
        # Cubes two reaches wide: what is within two reaches lies in this cube or one beside it.
        cubes = [tuple(c) for c in np.floor(x / (2 * reach)).astype(np.int64).tolist()]
        beside = list(itertools.product((-1, 0, 1), repeat=x.shape[1]))
        seeds: dict[tuple, list[int]] = {}
        waiting: dict[tuple, list[int]] = {}
        crowded: dict[tuple, list[int]] = {}

        def near(held: dict[tuple, list[int]], i: int, limit: float) -> bool:
            some = [j for d in beside for j in held.get(tuple(map(operator.add, cubes[i], d)), ())]
            return bool(some) and bool((on_rows(at[some], at[i]) < limit).any())

        new = []
        for i, (own, more) in enumerate(zip(sites["own"], sites["more"], strict=True)):
            if more:  # also when a seed covers it, which need not cover the rest
                crowded.setdefault(cubes[i], []).append(i)
            if near(seeds, i, eps):
                continue
            if not own or more or near(waiting, i, eps) or near(crowded, i, 2 * eps):
                waiting.setdefault(cubes[i], []).append(i)
            else:
                seeds.setdefault(cubes[i], []).append(i)
                new.append(i)
        return sites.loc[new, [*where, "eps", "first_id", "lat", "lon"]]

    return fold


def _join_earliest_seed(placed, seeds, by, geometry, rows) -> DataFrame:
    """Each site takes, for each m, the earliest seed closer than eps.

    A cell holds at most one seed per m, so there are boundedly many.
    """
    keys = ["eps_id", by]
    site = ["eps", "lat", "lon", "weight"]
    return (
        meet(placed, seeds, keys, geometry, rows)
        .groupBy(*keys, F.col("p_m").alias("m"), "first_id")
        .agg(
            *[F.max(c).alias(c) for c in site],  # the same on every row of a site
            F.min("p_first_id").alias("cluster_id"),
        )
        .select("eps", "m", by, "first_id", "lat", "lon", "weight", "cluster_id")
    )


def _dbscan(sites, eps_values, min_neighbours, by, geometry, fold_sites) -> DataFrame:
    if fold_sites:
        return _dbscan_by_fold(sites, eps_values, min_neighbours, by, geometry)
    return _dbscan_by_rounds(sites, eps_values, min_neighbours, by, geometry)


def _dbscan_by_fold(sites, eps_values, min_neighbours, by, geometry) -> DataFrame:
    """Labels of authors of bounded size: one pass over each author's sites, for the whole grid.

    Sites without an author or a place have no neighbours and are noise.
    """
    site = ["first_id", "lat", "lon", "weight"]
    known = sites.select(by, *site).dropna(subset=[by, "lat", "lon"])
    types = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    columns = {"eps": "double", "m": "int", **{c: types[c] for c in (by, *site)}, "cluster_id": types["first_id"]}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    return known.groupBy(by).applyInPandas(
        _component_fold(list(columns), eps_values, min_neighbours, geometry), schema
    )


def _component_fold(columns: list[str], eps_values, min_neighbours, geometry: Geometry):
    """Labels of one author's sites. The distances are worked out once and serve every (eps, m)."""
    on_rows = distance(geometry.distance).on_rows
    grid_eps, ms = [float(e) for e in eps_values], [int(m) for m in min_neighbours]

    def fold(sites: pd.DataFrame) -> pd.DataFrame:
        sites = sites.sort_values("first_id", ignore_index=True)
        at, weight, n = sites[["lat", "lon"]].to_numpy(float), sites["weight"].to_numpy(float), len(sites)
        apart = np.array([on_rows(at, place) for place in at])
        rows, labels, epss, sizes = [], [], [], []
        for eps in grid_eps:
            near = apart < eps
            k = near.astype(float) @ weight - 1
            for m in ms:
                label = _components(near, k >= m)
                rows.append(np.flatnonzero(label < n))
                labels.append(label[rows[-1]])
                epss.append(np.full(len(rows[-1]), eps))
                sizes.append(np.full(len(rows[-1]), m, np.int32))
        out = sites.take(np.concatenate(rows)).reset_index(drop=True)
        out["eps"], out["m"] = np.concatenate(epss), np.concatenate(sizes)
        out["cluster_id"] = sites["first_id"].to_numpy()[np.concatenate(labels)]
        return out[columns]

    return fold


def _components(near: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The lowest core site that each site is linked to by core sites; their number for noise."""
    n = len(core)
    label = np.full(n, n)
    for first in np.flatnonzero(core):
        front = [first] if label[first] == n else []
        while len(front):
            label[front] = first
            front = np.flatnonzero(near[front].any(axis=0) & core & (label == n))
    edge = np.flatnonzero(~core)
    label[edge] = np.where(near[edge] & core, label, n).min(axis=1, initial=n)
    return label


def _dbscan_by_rounds(sites, eps_values, min_neighbours, by, geometry) -> DataFrame:
    """Components of core sites of authors of any size, found on cells: the core sites of one cell always belong together."""
    placed = cut(place(sites, eps_values, geometry))
    ms = F.array(*[F.lit(int(m)) for m in min_neighbours])
    each = crowd(placed, max(min_neighbours), by, geometry).withColumn("m", F.explode(ms))
    each = cut(each.withColumn("is_core", F.col("k") >= F.col("m")))
    keys = ["eps_id", "m", by]
    cores = each.where("is_core")
    cells = cut(
        cores.groupBy(*keys, *CELL).agg(
            F.min("first_id").alias("v"), F.count(F.lit(1)).alias("cell_sites")
        )
    )
    cores = cut(attach(cores, cells, [*keys, *CELL]))
    edges = _core_edges(cores, keys, geometry)
    roots = connected_components(edges, keys)
    cores = attach(cores, roots, [*keys, "v"], "left").withColumn(
        "cluster_id", F.coalesce("root", "v")
    )
    # A site that is not core shares its cell with few others.
    site = ["first_id", "lat", "lon", "eps", "weight"]
    others = each.where(~F.col("is_core")).select(*keys, *site)
    borders = (
        meet(cores.select(*keys, *site, *TILE, "cluster_id"), others, keys, geometry)
        .groupBy(*keys, F.col("p_first_id").alias("first_id"))
        .agg(
            *[F.max("p_" + c).alias(c) for c in ("lat", "lon", "weight")],
            F.max("eps").alias("eps"),
            F.min("cluster_id").alias("cluster_id"),
        )
    )
    label = ["eps", "m", by, "first_id", "lat", "lon", "weight", "cluster_id"]
    return cores.select(label).unionByName(borders.select(label))


def _core_edges(cores, keys, geometry) -> DataFrame:
    """``(keys, a, b)``: cells, named by their lowest core post, with close core sites."""
    crowded = F.col("cell_sites") > blocks.CROWDED_SITES
    few = cores.where(~crowded).select(*keys, "first_id", "lat", "lon", "eps", "v")
    edges = (
        meet(cores, few, keys, geometry)
        .where(F.col("v") != F.col("p_v"))
        .select(*keys, F.col("v").alias("a"), F.col("p_v").alias("b"))
    )
    dense = cores.where(crowded)
    if not dense.isEmpty():
        linked = linked_cells(dense, keys, geometry)
        names = dense.select(*keys, *CELL, "v").distinct()
        for side, end in (("a_", "a"), ("b_", "b")):
            own = names.withColumnsRenamed({**{c: side + c for c in CELL}, "v": end})
            linked = linked.join(own, [*keys, *[side + c for c in CELL]])
        edges = edges.unionByName(linked.select(*keys, "a", "b"))
    return edges
