"""Coordinate systems as Column arithmetic: UTM (Krueger series), Web Mercator and a
local flat-earth approximation. All work on longitude / latitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c, let, vertex

STORAGE_SRID = 4326
WEB_MERCATOR = 3857

# WGS84 ellipsoid and UTM constants (fixed values).
_A = 6378137.0
_F = 1 / 298.257223563
_K0 = 0.9996
_EASTING = 500000.0
_SOUTH = 10000000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def is_projected(srid: int) -> bool:
    return srid == WEB_MERCATOR or 32601 <= srid <= 32660 or 32701 <= srid <= 32760


def assert_projected(srid: int) -> None:
    if not is_projected(srid):
        raise ValueError(f"EPSG:{srid} is not a supported metric system; distances and "
                         "areas would be in degrees")


def utm_srid(lon, lat) -> Column:
    """EPSG code of the UTM zone of a position."""
    zone = F.floor((_c(lon) + 180.0) / 6.0).cast("int") + 1
    return F.when(_c(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def utm_srid_of(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + int((lon + 180.0) / 6.0) + 1


def _meridian(srid: Column) -> Column:
    return F.radians((srid % 100) * 6.0 - 183.0)


def to_utm(lon, lat, srid) -> Column:
    """struct<x, y> in metres of the given UTM zone."""
    srid = _c(srid)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon)) - _meridian(srid)
    e = 2 * math.sqrt(_N) / (1 + _N)
    conformal = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    south = F.when(srid >= 32700, F.lit(_SOUTH)).otherwise(F.lit(0.0))

    def plane(w):
        x, y = w["y"], w["x"]
        for j, a in enumerate(_FORWARD, start=1):
            x = x + a * F.cos(2 * j * w["x"]) * F.sinh(2 * j * w["y"])
            y = y + a * F.sin(2 * j * w["x"]) * F.cosh(2 * j * w["y"])
        return vertex(_EASTING + _K0 * _RECT * x, south + _K0 * _RECT * y)

    return let(let(conformal, lambda t: vertex(
        F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)))), plane)


def from_utm(x, y, srid) -> Column:
    """struct<x, y> holding longitude and latitude."""
    srid = _c(srid)
    south = F.when(srid >= 32700, F.lit(_SOUTH)).otherwise(F.lit(0.0))
    start = vertex((_c(y) - south) / (_K0 * _RECT), (_c(x) - _EASTING) / (_K0 * _RECT))

    def sphere(w):
        xi, eta = w["x"], w["y"]
        for j, b in enumerate(_INVERSE, start=1):
            xi = xi - b * F.sin(2 * j * w["x"]) * F.cosh(2 * j * w["y"])
            eta = eta - b * F.cos(2 * j * w["x"]) * F.sinh(2 * j * w["y"])
        return vertex(xi, eta)

    def degrees(w):
        def series(chi):
            phi = chi
            for j, d in enumerate(_LATITUDE, start=1):
                phi = phi + d * F.sin(2 * j * chi)
            return phi
        lam = _meridian(srid) + F.atan2(F.sinh(w["y"]), F.cos(w["x"]))
        return vertex(F.degrees(lam), F.degrees(
            let(F.asin(F.sin(w["x"]) / F.cosh(w["y"])), series)))

    return let(let(start, sphere), degrees)


def to_web_mercator(lon, lat) -> Column:
    return vertex(_A * F.radians(_c(lon)),
                  _A * F.log(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2)))


def unproject_rings(rings, srid, digits: int = 6) -> Column:
    """Back to longitude / latitude, rounded for the map."""
    def back(v):
        p = from_utm(v["x"], v["y"], srid)
        return vertex(F.bround(p["x"], digits), F.bround(p["y"], digits))
    return F.transform(_c(rings), lambda r: F.transform(r, back))


def unproject_path(path, srid, digits: int = 6) -> Column:
    return F.element_at(unproject_rings(F.array(_c(path)), srid, digits), 1)


def mercator_distance(lon1, lat1, lon2, lat2) -> Column:
    """Web-Mercator metres; too long by 1 / cos(latitude)."""
    p, q = to_web_mercator(lon1, lat1), to_web_mercator(lon2, lat2)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def local_distance(lon1, lat1, lon2, lat2) -> Column:
    """Ground metres on a sphere flattened at the mid latitude."""
    mid = F.radians((_c(lat1) + _c(lat2)) / 2)
    return F.hypot(_A * F.radians(_c(lon2) - _c(lon1)) * F.cos(mid),
                   _A * F.radians(_c(lat2) - _c(lat1)))


def degree_distance(lon1, lat1, lon2, lat2) -> Column:
    """Degrees times 111 km, the coarse variant."""
    return F.hypot(_c(lon1) - _c(lon2), _c(lat1) - _c(lat2)) * 111000.0
