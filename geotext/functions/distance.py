"""Distances as Column expressions, with numpy twins for use inside Arrow batches.

Points on the map are ``(latitude, longitude)`` pairs of columns in degrees; feature
vectors are array columns. ``haversine`` returns kilometres, the others the unit of
their input (degrees on map points).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6372.8  # fixed value: results depend on it


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + half_lon * half_lon * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    # Rounding may lift h just over 1 at antipodes, where asin would give NaN.
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def euclidean(lat1, lon1, lat2, lon2) -> Column:
    dx, dy = _col(lat1) - _col(lat2), _col(lon1) - _col(lon2)
    return F.sqrt(dx * dx + dy * dy)


def manhattan(lat1, lon1, lat2, lon2) -> Column:
    return F.abs(_col(lat1) - _col(lat2)) + F.abs(_col(lon1) - _col(lon2))


def degrees_to_km(degrees) -> Column:
    return _col(degrees) / 180 * math.pi * EARTH_RADIUS_KM


def array_euclidean(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def array_manhattan(a, b) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def array_haversine(a, b) -> Column:
    """Kilometres between two ``[lat, lon]`` arrays; any other length is an error."""
    a, b = _col(a), _col(b)
    km = haversine_km(a[0], a[1], b[0], b[1])
    return F.when((F.size(a) == 2) & (F.size(b) == 2), km).otherwise(
        F.raise_error(F.lit("haversine needs [lat, lon] arrays")).cast("double")
    )


def array_cosine(a, b) -> Column:
    """One minus the cosine; NaN when either vector is zero."""
    dot = _fold(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_fold(F.transform(a, lambda x: x * x))) * F.sqrt(
        _fold(F.transform(b, lambda x: x * x))
    )
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - dot / norms)


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _np_haversine(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(points[:, 0]), np.radians(points[:, 1])
    lat0, lon0 = np.radians(centre[0]), np.radians(centre[1])
    h = np.sin((lat - lat0) / 2) ** 2 + np.sin((lon - lon0) / 2) ** 2 * np.cos(lat) * np.cos(lat0)
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _np_cosine(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(points, axis=1) * np.linalg.norm(centre)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, np.nan, 1 - points @ centre / norms)


@dataclass(frozen=True)
class Distance:
    """One distance in three forms: on map points, on array columns, on numpy rows."""

    name: str
    on_points: Callable[..., Column] | None
    on_arrays: Callable[..., Column]
    on_rows: Callable[[np.ndarray, np.ndarray], np.ndarray]


DISTANCES = {
    d.name: d
    for d in (
        Distance("haversine", haversine_km, array_haversine, _np_haversine),
        Distance(
            "euclidean", euclidean, array_euclidean, lambda p, c: np.sqrt(((p - c) ** 2).sum(axis=1))
        ),
        Distance("manhattan", manhattan, array_manhattan, lambda p, c: np.abs(p - c).sum(axis=1)),
        Distance("cosine", None, array_cosine, _np_cosine),
    )
}


def distance(name: str) -> Distance:
    try:
        return DISTANCES[name]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(DISTANCES)}") from None
