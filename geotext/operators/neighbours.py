"""Pairs of close points, and neighbour counts that do not need the pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geotext.operators import blocks, skew
from geotext.operators.blocks import count_between
from geotext.operators.cells import CELL, TILE, TILE_RADII, Geometry
from geotext.operators.skew import attach, hot_keys
from geotext.session import cut

#: Rows of a wide tile that one task joins with one another.
JOIN_ROWS = 20_000

#: Sides of a wide tile, in tiles, of which the one with the fewest rows to shuffle is taken.
WIDE = (4, 2, 1)
WIDE_TILE = ["wide_band", "wide_col"]

#: Tasks of one join, as many as a driver can well keep.
MOST_TASKS = 50_000


def collapse(points: DataFrame, by: str = "user_id", key: str = "post_id") -> DataFrame:
    """Merge posts at identical coordinates into one site with a weight.

    Copies are merged before the shuffle, so a spot that holds a large share of all
    posts costs one row per task. Copies share their neighbours, and all but the first
    are covered by whatever covers the first, so clustering needs only the site.
    """
    return points.groupBy(by, "lat", "lon").agg(
        F.min(key).alias("first_id"), F.count(F.lit(1)).alias("weight")
    )


def neighbour_join(
    points: DataFrame,
    eps: float,
    by: str | None = "user_id",
    key: str = "post_id",
    geometry: Geometry = Geometry(),
    hot_rows: int | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """All ordered pairs ``(by, i, j, d)``, i <> j, strictly closer than eps.

    The output holds every pair, so it is quadratic in a crowded spot: use it where the pairs are
    wanted, and ``neighbour_count`` or the clustering where they are not. Far less is shuffled:
    a point goes to its own wide tile and, from the rim, to lower ones it reaches into, so two
    points meet in one task only, which gives the pair in both orders. There they meet in tiles of
    eps. A crowded wide tile is dealt to n parts that meet two at a time, so its points are sent
    n times. ``condition`` is a further test on columns of the two sides, which carry the
    suffixes ``_i`` and ``_j``.
    """
    e = F.lit(float(eps))
    group = [by] if by else []
    rest = [c for c in points.columns if c not in group]
    size = hot_rows or min(skew.HOT_ROWS, JOIN_ROWS)
    dealt, unit, how = _units(points, e, group, key, geometry, size)
    at = geometry.embed(F.col("lat"), F.col("lon"))
    placed = dealt.withColumns({f"_{axis}": v for axis, v in at.items()})
    carried, fine = [*rest, *[f"_{axis}" for axis in at]], e / TILE_RADII
    tile = geometry.tile(F.col("lat"), F.col("lon"), fine)
    home = placed.select(
        *unit,
        *[F.col(c).alias(c + "_j") for c in carried],
        # Never null here. As Spark knows that, it adds no tests for it, and both sides read one shuffle.
        *_named({name: F.coalesce(v, F.lit(0)) for name, v in tile.items()}),
        F.col("_home").alias("_wanted"),
        F.col("_own").alias("_meets"),
    )
    # Own points ask for own points and for the rim's, the rim's ask for own points.
    wanted = F.when(F.col("_home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    reach = geometry.spread(placed, e, fine).select(
        *unit,
        *[F.col(c).alias(c + "_i") for c in carried],
        *TILE,
        F.explode(wanted).alias("_wanted"),
        (_part("part_i", unit) + _part("part_j", unit) - F.col("_own")).alias("_meets"),
    )
    d = geometry.between("lat_i", "lon_i", "lat_j", "lon_j")
    near = geometry.near(*[tuple(F.col(f"_{axis}_{side}") for axis in at) for side in "ij"], d, e)
    pairs = reach.join(home.hint(how), [*unit, *TILE, "_wanted", "_meets"]).where(
        (F.col(key + "_i") != F.col(key + "_j")) & near
    )
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.select(
        *group, F.col(key + "_i").alias("i"), F.col(key + "_j").alias("j"), d.alias("d")
    )


def _units(
    points: DataFrame, e: Column, group: list[str], key: str, geometry: Geometry, size: int
) -> tuple[DataFrame, list[str], str]:
    """Points dealt to the tasks that join them, the columns that name a unit of this work, and the join to use.

    ``_home`` is false for a point of a higher wide tile, ``_own`` is its part of a crowded tile.
    Each unordered pair closer than eps is in one unit as two points of which one is at home and,
    in a unit of two parts, each is of another part.
    """
    unit, count = [*group, *WIDE_TILE], points.count()
    # The wider the tiles, the fewer points of rims; the more crowded, the more copies for parts.
    plans = []
    for wide in WIDE:
        met = _met(points, e, e * wide, geometry)
        hot = hot_keys(met, unit, hot_rows=size)
        rows = count * (1 + ((1 + 2 / TILE_RADII / wide) ** 2 - 1) / 2)
        if hot is not None:
            # n parts, each meeting itself and every other one: bounded units.
            hot = hot.withColumn("parts", F.ceil(F.col("hot_rows") / size).cast("int"))
            rows += hot.agg(F.sum(F.col("hot_rows") * (F.col("parts") - 1.0))).first()[0]
        plans.append((rows, met, hot))
        if hot is None:
            break
    rows, met, hot = min(plans, key=lambda plan: plan[0])
    if hot is None:
        met = met.withColumn("_own", F.lit(0))
    else:
        met = met.join(skew.few_or_shuffled(hot.select(*unit, "parts")), unit, "left")
        n = F.coalesce("parts", F.lit(1))
        deal = F.coalesce(F.pmod(F.xxhash64(key), n).cast("int"), F.lit(0))
        met = met.withColumn("_own", deal).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), n - 1))
        )
        met = met.withColumns(
            {"part_i": F.least("_own", "_other"), "part_j": F.greatest("_own", "_other")}
        ).drop("parts", "_other")
        unit = [*unit, "part_i", "part_j"]
    # A task for every ``size`` rows: coalesced by the bytes they read, a few tasks would make all the pairs.
    cores = points.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, min(MOST_TASKS, math.ceil(rows / size)))
    # Hashed, a task's few rows stay in memory and nothing is spilled to disk; more rows are sorted.
    how = "shuffle_hash" if rows <= MOST_TASKS * size else "merge"
    return met.repartition(tasks, *unit), unit, how


def _met(points: DataFrame, e: Column, wide: Column, geometry: Geometry) -> DataFrame:
    """Each point in its own wide tile, and in the lower ones that may hold points closer than eps."""
    own = geometry.tile(F.col("lat"), F.col("lon"), wide)
    (band, col), (own_band, own_col) = [F.col(c) for c in TILE], [own[c] for c in TILE]
    lower = (band < own_band) | ((band == own_band) & (col <= own_col))
    at_home = (band == own_band) & (col == own_col)
    return (
        geometry.spread(points, e, wide)
        .where(lower)
        .withColumn("_home", F.coalesce(at_home, F.lit(False)))
        .withColumnsRenamed(dict(zip(TILE, WIDE_TILE)))
    )


def _part(name: str, unit: list[str]) -> Column:
    return F.col(name) if name in unit else F.lit(0)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def place(sites: DataFrame, eps_values, geometry: Geometry) -> DataFrame:
    """One copy of each site per eps, with its cell and home tile."""
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("eps_id"), F.lit(float(e)).alias("eps"))
            for i, e in enumerate(eps_values)
        ]
    )
    lat, lon, eps = F.col("lat"), F.col("lon"), F.col("eps")
    return sites.select("*", F.inline(grid)).withColumns(
        {**geometry.cell(lat, lon, eps), **geometry.tile(lat, lon, eps)}
    )


def meet(
    placed: DataFrame,
    few: DataFrame,
    keys: list[str],
    geometry: Geometry,
    rows: int | None = None,
) -> DataFrame:
    """Pairs of a site and one of the few closer than eps; columns of the few get a ``p_``.

    A site meets itself too. ``few`` must hold boundedly many sites per cell. Then a tile,
    with its margin of about 72 cells, has boundedly many as well: the join multiplies the
    sites by a constant at most, and its hot keys can be broadcast.
    """
    few = geometry.spread(few).drop("eps")
    few = few.withColumnsRenamed({c: "p_" + c for c in few.columns if c not in [*keys, *TILE]})
    return attach(placed, few, [*keys, *TILE], rows=rows).where(
        geometry.within(
            F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"), F.col("eps")
        )
    )


def probe(
    placed: DataFrame,
    probes: DataFrame,
    result: Column,
    name: str,
    by: str = "user_id",
    geometry: Geometry = Geometry(),
    rows: int | None = None,
) -> DataFrame:
    """Aggregate, for each probe, the other sites closer than eps: ``(eps_id, by, first_id, name)``.

    ``probes`` must hold boundedly many sites per cell. The pairs are folded into the
    aggregate where they arise; none is shuffled.
    """
    keys = ["eps_id", by]
    few = probes.select(*keys, "eps", "first_id", "lat", "lon")
    return (
        meet(placed, few, keys, geometry, rows)
        .where(F.col("p_first_id") != F.col("first_id"))
        .groupBy(*keys, F.col("p_first_id").alias("first_id"))
        .agg(result.alias(name))
    )


def crowd(
    placed: DataFrame,
    enough: int,
    by: str = "user_id",
    geometry: Geometry = Geometry(),
    rows: int | None = None,
) -> DataFrame:
    """Add ``k``, the number of other posts within eps: exact up to ``enough``, else at least that.

    A cell of more than ``enough`` posts settles all its sites at once. The other cells
    hold at most ``enough`` sites each, so a site is compared with at most about
    72 * enough of them: the work is linear in the sites, however crowded a place is.
    """
    keys = ["eps_id", by, *CELL]
    cells = placed.groupBy(*keys).agg(F.sum("weight").alias("cell_weight"))
    placed = attach(placed, cells, keys, rows=rows)
    if rows is None:
        placed = cut(placed)  # looked through for hot keys, and read twice
    settled = F.col("cell_weight") > enough
    met = probe(placed, placed.where(~settled), F.sum("weight"), "others", by, geometry, rows)
    k = F.when(settled, F.col("cell_weight")).otherwise(
        F.col("weight") + F.coalesce("others", F.lit(0))
    )
    # (eps_id, by, first_id) is unique on both sides: no hot key is possible.
    return (
        placed.join(met, ["eps_id", by, "first_id"], "left")
        .withColumn("k", k - 1)
        .drop("others", "cell_weight")
    )


def neighbour_count(
    points: DataFrame,
    eps: float,
    by: str = "user_id",
    key: str = "post_id",
    geometry: Geometry = Geometry(),
) -> DataFrame:
    """Exact number of other posts closer than eps: ``(by, key, k)``, zeros included.

    Sites in cells of at most CROWDED_SITES are compared with what is near them. In a
    crowded cell all sites are close to one another, and crowded cells are counted
    against one another by blocks.
    """
    keys = ["eps_id", by]
    placed = place(collapse(points, by, key), [eps], geometry)
    cells = placed.groupBy(*keys, *CELL).agg(
        F.sum("weight").alias("cell_weight"), F.count(F.lit(1)).alias("cell_sites")
    )
    placed = cut(attach(cut(placed), cells, [*keys, *CELL]))
    crowded = F.col("cell_sites") > blocks.CROWDED_SITES
    loose = placed.where(~crowded)
    found = probe(placed, loose, F.sum("weight"), "n", by, geometry)
    dense = placed.where(crowded)
    if not dense.isEmpty():
        # Seen from a crowded cell: its own sites, those of loose cells, those of crowded ones.
        own = dense.select(*keys, "first_id", (F.col("cell_weight") - F.col("weight")).alias("n"))
        few = loose.select(*keys, "first_id", "lat", "lon", "eps", "weight")
        met = meet(dense, few, keys, geometry).groupBy(*keys, "first_id").agg(
            F.sum("p_weight").alias("n")
        )
        parts = [found, own, met, count_between(dense, keys, geometry)]
        found = (
            reduce(DataFrame.unionByName, parts)
            .groupBy(*keys, "first_id")
            .agg(F.sum("n").alias("n"))
        )
    others = F.col("weight") - 1 + F.coalesce("n", F.lit(0))
    counted = placed.join(found, [*keys, "first_id"], "left").select(
        by, "lat", "lon", others.alias("k")
    )
    return attach(points, counted, [by, "lat", "lon"]).select(by, key, "k")
