"""Spatial keys that turn "closer than eps" into equi-joins.

Two kinds of key, both computed from a row's own columns:

* ``cell``: so small that any two points of one cell are closer than eps. A cell with
  enough points is dense without comparing any of them, and a set of points that keep
  eps apart has at most one per cell.
* ``tile``: three eps wide. A point's eps-ball meets at most two tiles per axis, about
  2.8 in all, so one side of a join is repeated 2.8 times where the usual scheme with
  eps-wide keys repeats it nine times. A tile with its margin covers about 72 cells.

On the sphere both are latitude bands cut into longitude columns whose width follows the
band, so nothing special happens at the poles or at 180 degrees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from geotext.functions.distance import EARTH_RADIUS_KM, distance

CELL = ["cell_band", "cell_col"]
TILE = ["tile_band", "tile_col"]

SLACK = 1e-4  # far above the rounding of floor(x / width), far below any effect on cost
TILE_RADII = 3.0
EMBED_ROUNDING = 1e-14  # above the rounding of coordinates on the unit sphere, which matters for the smallest eps


@dataclass(frozen=True)
class Geometry:
    """Cells, tiles and the exact test for one distance on (lat, lon) points."""

    distance: str = "haversine"

    def __post_init__(self):
        if self.distance not in ("haversine", "euclidean", "manhattan"):
            raise ValueError(f"no spatial cells for distance {self.distance!r}")

    def between(self, lat1, lon1, lat2, lon2) -> Column:
        return distance(self.distance).on_points(lat1, lon1, lat2, lon2)

    def within(self, lat1, lon1, lat2, lon2, eps) -> Column:
        """Strictly closer than eps; a cheap latitude test goes first."""
        reach = self._lat_reach(eps)
        return (F.abs(lat1 - lat2) <= reach) & (self.between(lat1, lon1, lat2, lon2) < eps)

    def _lat_reach(self, eps) -> Column:
        if self.distance == "haversine":
            return eps * ((1 + SLACK) * 180 / math.pi / EARTH_RADIUS_KM)
        return eps * (1 + SLACK)

    def cell(self, lat, lon, eps) -> dict[str, Column]:
        """The CELL columns of a point."""
        if self.distance == "haversine":
            side = F.sin(F.least(eps / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2))) * (
                2 / math.sqrt(2) * (1 - SLACK)
            )
            band = F.floor(F.radians(lat) / side)
            cols = F.greatest(
                F.lit(1.0), F.ceil(_widest_cos(band, side) * (2 * math.pi) / side).cast("double")
            )
            return dict(zip(CELL, (band, _wrap(F.radians(lon), cols))))
        side = eps * ((1 - SLACK) / (2 if self.distance == "manhattan" else math.sqrt(2)))
        return dict(zip(CELL, (F.floor(lat / side), F.floor(lon / side))))

    def tile(self, lat, lon, eps) -> dict[str, Column]:
        """The TILE columns of a point's home tile."""
        if self.distance == "haversine":
            height = eps * (TILE_RADII / EARTH_RADIUS_KM)
            band = F.floor(F.radians(lat) / height)
            return dict(zip(TILE, (band, _wrap(F.radians(lon), _tile_cols(band, height)))))
        side = eps * TILE_RADII
        return dict(zip(TILE, (F.floor(lat / side), F.floor(lon / side))))

    def embed(self, lat, lon) -> dict[str, Column]:
        """Coordinates x, y, z whose straight-line distance orders points as the distance does."""
        if self.distance != "haversine":
            return {"x": lat, "y": lon, "z": F.lit(0.0)}
        phi, lam = F.radians(lat), F.radians(lon)
        return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}

    def radius(self, eps) -> Column:
        """The straight-line distance in ``embed`` that stands for eps."""
        if self.distance != "haversine":
            return eps
        return 2 * F.sin(F.least(eps / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2)))

    def box_bounds(self, a: str, b: str) -> tuple[Column, Column]:
        """Least and greatest distance between the boxes with column prefixes a and b."""
        gaps, spans = [], []
        for axis in "xyz":
            a_low, a_high = F.col(f"{a}{axis}_low"), F.col(f"{a}{axis}_high")
            b_low, b_high = F.col(f"{b}{axis}_low"), F.col(f"{b}{axis}_high")
            gaps.append(F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high))
            spans.append(F.greatest(a_high - b_low, b_high - a_low))
        if self.distance == "manhattan":
            return sum(gaps[1:], gaps[0]), sum(spans[1:], spans[0])
        return tuple(
            F.sqrt(sum([v * v for v in parts[1:]], parts[0] * parts[0])) for parts in (gaps, spans)
        )

    def near(self, a: tuple[Column, ...], b: tuple[Column, ...], exact: Column, eps) -> Column:
        """Whether ``exact``, the distance of two points, is under eps, by their ``embed`` coordinates a and b if these tell.

        The distance is worked out only for points within SLACK of the rim.
        """
        gap = [u - v for u, v in zip(a, b)]
        square = sum([g * g for g in gap[1:]], gap[0] * gap[0])
        if self.distance == "manhattan":
            return (square <= _squared(eps * (1 + SLACK))) & (exact < eps)
        r = self.radius(eps)
        inner = F.greatest(F.lit(0.0), r * (1 - SLACK) - EMBED_ROUNDING)
        return (square < _squared(inner)) | (
            (square <= _squared(r * (1 + SLACK) + EMBED_ROUNDING)) & (exact < eps)
        )

    def degrees(self, eps) -> Column:
        """Eps as degrees of latitude, or as it is on the plane."""
        if self.distance == "haversine":
            return eps * (180 / math.pi / EARTH_RADIUS_KM)
        return eps

    def spread(self, df: DataFrame, eps="eps", tile_eps: Column | None = None) -> DataFrame:
        """Repeat each row for every tile that may hold a point closer than eps, with its TILE.

        The tiles are those of ``tile_eps`` if that is given.

        Two plain explodes, over bands and then over the columns of a band, so that the
        whole step stays in generated code.
        """
        lat, lon = F.col("lat"), F.col("lon")
        eps = F.col(eps) if isinstance(eps, str) else eps
        tile_eps = eps if tile_eps is None else tile_eps
        kept = df.columns
        if self.distance != "haversine":
            side, reach = tile_eps * TILE_RADII, eps * (1 + SLACK)
            return df.select("*", _span((lat - reach) / side, (lat + reach) / side, TILE[0])).select(
                *kept, TILE[0], _span((lon - reach) / side, (lon + reach) / side, TILE[1])
            )
        phi, lam = F.radians(lat), F.radians(lon)
        height = tile_eps * (TILE_RADII / EARTH_RADIUS_KM)
        reach = eps * ((1 + SLACK) / EARTH_RADIUS_KM)
        # Half the longitude width of the ball; all longitudes once it holds a pole.
        half = F.when(
            F.abs(phi) + reach < math.pi / 2 * (1 - 1e-9),
            F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(phi))) * (1 + SLACK),
        ).otherwise(F.lit(math.pi))
        banded = df.select(
            "*",
            half.alias("_half"),
            _span((phi - reach) / height, (phi + reach) / height, TILE[0]),
        ).withColumn("_cols", _tile_cols(F.col(TILE[0]), height))
        turn = F.col("_cols") / (2 * math.pi)
        spanned = banded.withColumns(
            {
                "_first": F.floor((lam + math.pi - F.col("_half")) * turn),
                "_last": F.floor((lam + math.pi + F.col("_half")) * turn),
            }
        )
        cols = F.col("_cols").cast("long")
        # A band with no more columns than the ball is wide is taken whole, each column once.
        last = F.least(F.col("_last"), F.col("_first") + cols - 1)
        return spanned.select(
            *kept, TILE[0], "_cols", F.explode(F.sequence(F.col("_first"), last)).alias("_at")
        ).select(*kept, TILE[0], F.pmod(F.col("_at"), cols).alias(TILE[1]))


def _squared(v: Column) -> Column:
    return v * v


def _span(low: Column, high: Column, name: str) -> Column:
    return F.explode(F.sequence(F.floor(low), F.floor(high))).alias(name)


def _widest_cos(band: Column, height) -> Column:
    """Cosine of the latitude nearest the equator within the band."""
    nearest = F.when(band >= 0, band * height).otherwise(-(band + 1) * height)
    return F.cos(F.least(nearest, F.lit(math.pi / 2)))


def _tile_cols(band: Column, height) -> Column:
    return F.greatest(
        F.lit(1.0), F.floor(_widest_cos(band, height) * (2 * math.pi) / height).cast("double")
    )


def _wrap(lam: Column, cols: Column) -> Column:
    return F.pmod(F.floor((lam + math.pi) / (2 * math.pi) * cols), cols.cast("long"))
