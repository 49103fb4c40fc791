"""Map projection and plane geometry as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 and the transverse Mercator scale and false easting in km (fixed values).
A_KM, FLAT, K0, EAST0, SOUTH0 = 6378.137, 1 / 298.257223563, 0.9996, 500.0, 10000.0
_N = FLAT / (2 - FLAT)
_A = A_KM / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to third order in the third flattening (fixed form).
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
CONSTANTS = {"n": _N, "a": _A, "alpha": _ALPHA, "beta": _BETA, "delta": _DELTA}


def atanh(x: Column) -> Column:
    return 0.5 * F.ln((1 + x) / (1 - x))


def utm_zone(mean_lon: float) -> int:
    """The zone of a longitude, 1 to 60."""
    return (math.floor((mean_lon + 180) / 6)) % 60 + 1


def find_zone(rows: DataFrame, lon: str, lat: str) -> tuple[int, bool]:
    """(zone, south) of all rows: the mean of longitudes counted from -180 or from 0, whichever spreads less; one aggregate."""
    turned = F.when(F.col(lon) < 0, F.col(lon) + 360.0).otherwise(F.col(lon))
    one = rows.agg(F.avg(lon).alias("m"), (F.max(lon) - F.min(lon)).alias("w"), F.avg(turned).alias("m2"), (F.max(turned) - F.min(turned)).alias("w2"), F.avg(lat).alias("y")).first()
    if one.m is None:
        return utm_zone(0.0), False
    return utm_zone(float(one.m if one.w < one.w2 else one.m2)), float(one.y or 0.0) < 0


def lon_lat_to_east_north(rows: DataFrame, lon: str = "Lon", lat: str = "Lat", zone: int | None = None) -> DataFrame:
    """rows with e_km and n_km in the zone given or found, as the older converters did."""
    found, south = find_zone(rows, lon, lat)
    e, n = utm_forward(F.col(lon), F.col(lat), zone or found, south)
    return rows.withColumns({"e_km": e, "n_km": n})


def utm_forward(lon: Column, lat: Column, zone: int, south: bool = False, flip: bool = False) -> tuple[Column, Column]:
    """(east, north) in km.  flip: turn the globe by half, for data across the date line; the zone turns with it."""
    if flip:
        lon, zone = F.pmod(lon + 360.0, F.lit(360.0)) - 180.0, (zone + 29) % 60 + 1
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(atanh(F.sin(phi)) - c * atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, al in enumerate(_ALPHA, 1):
        e = e + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + K0 * _A * e, (SOUTH0 if south else 0.0) + K0 * _A * n


def utm_inverse(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = (north - (SOUTH0 if south else 0.0)) / (K0 * _A), (east - EAST0) / (K0 * _A)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """As products, which all engines round alike."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def cross2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def barycentric(px: Column, py: Column, v: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """Weights of a point on a triangle's corners; they add up to 1."""
    (x0, y0), (x1, y1), (x2, y2) = v
    area = cross2(x1 - x0, y1 - y0, x2 - x0, y2 - y0)
    w1 = cross2(px - x0, py - y0, x2 - x0, y2 - y0) / area
    w2 = cross2(x1 - x0, y1 - y0, px - x0, py - y0) / area
    return 1 - w1 - w2, w1, w2
