"""Counting and finding close pairs between crowded cells without listing them.

Two crowded cells may hold any number of sites each. Their sites are summarised by
blocks: the cell itself, then ever finer squares of it, each with its number of sites,
weight and bounding box. A pair of blocks is settled at once if its boxes lie wholly
within eps of one another, or wholly apart. A pair with few sites is compared site by
site. Only what is left is split, both blocks into their parts, and looked at again. What
is compared is thereby confined to the rim of the eps-ball, and the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from geotext.operators.cells import CELL, TILE, Geometry
from geotext.operators.skew import attach
from geotext.session import cut

CROWDED_SITES = 64  # a cell with more sites is compared by blocks
PAIR_SITES = 4_096  # a pair of blocks with at most this many site pairs is compared site by site
LAST_LEVEL = 40  # squares of eps / 2**40 are points
MARGIN = 1e-9  # box bounds nearer to eps than this are left to the exact test

SQUARE = ["square_i", "square_j"]
BLOCK = [*CELL, *SQUARE]


@dataclass(frozen=True)
class Settled:
    """What one level of refinement settled."""

    level: int
    sites: DataFrame  # with their BLOCK of this level
    whole: DataFrame  # pairs of blocks all of whose sites are within eps of one another
    close: DataFrame  # pairs of sites within eps


def _with_block(sites: DataFrame, level: int, geometry: Geometry) -> DataFrame:
    if level == 0:
        return sites.withColumns({c: F.lit(0).cast("long") for c in SQUARE})
    width = geometry.degrees(F.col("eps"))
    scale = float(2**level)  # a power of two: squares nest exactly
    return sites.withColumns(
        {
            SQUARE[0]: F.floor(F.col("lat") / width * scale),
            SQUARE[1]: F.floor(F.col("lon") / width * scale),
        }
    )


def _summaries(sites: DataFrame, keys: list[str], geometry: Geometry) -> DataFrame:
    boxed = sites.withColumns(geometry.embed(F.col("lat"), F.col("lon")))
    bounds = [f(axis).alias(f"{axis}_{n}") for axis in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    return boxed.groupBy(*keys, *BLOCK).agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum("weight").alias("weight"),
        F.max("eps").alias("eps"),
        F.min_by(F.struct("lat", "lon"), "first_id").alias("spot"),
        *bounds,
    )


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def _first_pairs(cells: DataFrame, keys: list[str], geometry: Geometry, ordered: bool) -> DataFrame:
    """Pairs of crowded cells that may hold close sites: spots of such cells lie within 3 eps."""
    wide = cells.withColumns(
        {"lat": F.col("spot.lat"), "lon": F.col("spot.lon"), "eps": F.col("eps") * 3}
    ).select(*keys, *BLOCK, "lat", "lon", "eps")
    lat, lon, eps = F.col("lat"), F.col("lon"), F.col("eps")
    home = wide.withColumns(geometry.tile(lat, lon, eps)).select(*keys, *TILE, *BLOCK)
    near = geometry.spread(wide).select(*keys, *TILE, *BLOCK)
    # Cells, not sites: a tile of nine eps holds boundedly many.
    pairs = _prefixed(near, [*keys, *TILE], "a_").join(_prefixed(home, [*keys, *TILE], "b_"), [*keys, *TILE])
    a = F.struct(*["a_" + c for c in CELL])
    b = F.struct(*["b_" + c for c in CELL])
    return pairs.where(a != b if ordered else a < b).drop(*TILE)


def refine(sites: DataFrame, keys: list[str], geometry: Geometry, ordered: bool):
    """Yield what each level settles, for all pairs of sites in two different cells of ``sites``.

    With ``ordered`` a pair of cells is seen from both sides. The consumer may send back
    pairs of cells (``a_``/``b_`` CELL columns) that need no further look.
    """
    level = 0
    pairs = None
    while True:
        placed = _with_block(sites, level, geometry)
        blocks = cut(_summaries(placed, keys, geometry))
        if level == 0:
            pairs = _first_pairs(blocks, keys, geometry, ordered)
        else:
            # Both sides of every pair that is left fall into their parts.
            parent = {
                c: F.shiftright(c, 1) if level > 1 else F.lit(0).cast("long") for c in SQUARE
            }
            parts = blocks.select(
                *keys, *CELL, *[e.alias("parent_" + c) for c, e in parent.items()], *SQUARE
            )
            for side in ("a_", "b_"):
                own = parts.withColumnsRenamed(
                    {
                        **{c: side + c for c in CELL},
                        **{"parent_" + c: side + c for c in SQUARE},
                        **{c: side + "new_" + c for c in SQUARE},
                    }
                )
                pairs = pairs.join(own, [*keys, *[side + c for c in BLOCK]])
            pairs = pairs.select(
                *keys,
                *[s + c for s in ("a_", "b_") for c in CELL],
                *[F.col(s + "new_" + c).alias(s + c) for s in ("a_", "b_") for c in SQUARE],
            )
        for side in ("a_", "b_"):
            pairs = pairs.join(
                _prefixed(blocks.drop("spot"), keys, side), [*keys, *[side + c for c in BLOCK]]
            )
        low, high = geometry.box_bounds("a_", "b_")
        r = geometry.radius(F.col("a_eps"))
        pairs = cut(
            pairs.withColumns({"_low": low, "_high": high, "_r": r})
            .where(F.col("_low") <= F.col("_r") * (1 + MARGIN))
            .withColumn("_whole", F.col("_high") < F.col("_r") * (1 - MARGIN))
            .withColumn(
                "_few",
                (F.col("a_sites") * F.col("b_sites") <= PAIR_SITES) | F.lit(level >= LAST_LEVEL),
            )
            .select(
                *keys,
                *[s + c for s in ("a_", "b_") for c in BLOCK],
                "b_weight",
                "_whole",
                "_few",
            )
        )
        few = pairs.where(~F.col("_whole") & F.col("_few")).drop("b_weight", "_whole", "_few")
        close = few
        for side in ("a_", "b_"):
            # A block in such a pair is small: no hot key.
            own = _prefixed(
                placed.select(*keys, *BLOCK, "first_id", "lat", "lon", "weight", "eps"), keys, side
            )
            close = close.join(own, [*keys, *[side + c for c in BLOCK]])
        close = close.where(
            geometry.within(
                F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), F.col("a_eps")
            )
        )
        done = yield Settled(level, placed, pairs.where("_whole"), close)
        pairs = pairs.where(~F.col("_whole") & ~F.col("_few")).drop("b_weight", "_whole", "_few")
        if done is not None:
            cells = [s + c for s in ("a_", "b_") for c in CELL]
            pairs = pairs.join(done, [*keys, *cells], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return
        level += 1


def count_between(sites: DataFrame, keys: list[str], geometry: Geometry) -> DataFrame:
    """Per site, the weight of sites in other cells of ``sites`` closer than eps: ``(keys, first_id, n)``."""
    counted = None
    for settled in refine(sites, keys, geometry, ordered=True):
        whole = settled.whole.groupBy(*keys, *[F.col("a_" + c).alias(c) for c in BLOCK]).agg(
            F.sum("b_weight").alias("n")
        )
        by_block = attach(settled.sites, whole, [*keys, *BLOCK]).select(*keys, "first_id", "n")
        by_site = settled.close.groupBy(*keys, F.col("a_first_id").alias("first_id")).agg(
            F.sum("b_weight").alias("n")
        )
        level = cut(by_block.unionByName(by_site))
        counted = level if counted is None else counted.unionByName(level)
    return counted.groupBy(*keys, "first_id").agg(F.sum("n").alias("n"))


def linked_cells(sites: DataFrame, keys: list[str], geometry: Geometry) -> DataFrame:
    """Pairs of cells of ``sites`` with two sites closer than eps: ``(keys, a_ CELL, b_ CELL)``."""
    cells = [s + c for s in ("a_", "b_") for c in CELL]
    found = None
    steps = refine(sites, keys, geometry, ordered=False)
    settled = next(steps)
    while True:
        level = cut(
            settled.whole.select(*keys, *cells)
            .unionByName(settled.close.select(*keys, *cells))
            .distinct()
        )
        found = level if found is None else found.unionByName(level)
        try:
            settled = steps.send(level)
        except StopIteration:
            return found.distinct()
