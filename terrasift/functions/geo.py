"""Geodesy and planar geometry as Column expressions (no per-row Python)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_MILES = 3959.0
METRES_PER_DEGREE = 111139.0
SQ_METRES_PER_ACRE = 4046.86


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_KM)


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_MILES)


def line_length_km(vertices: Column) -> Column:
    """Great-circle length of an ``array<struct<lon,lat>>``."""
    pairs = F.when(F.size(vertices) < 2, F.array().cast("array<double>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(vertices) - 1),
            lambda i: haversine_km(
                F.element_at(vertices, i)["lat"],
                F.element_at(vertices, i)["lon"],
                F.element_at(vertices, i + 1)["lat"],
                F.element_at(vertices, i + 1)["lon"],
            ),
        )
    )
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


# --- UTM (WGS84 ellipsoid, Krueger series to third order in n) -----------------

_A = 6378137.0
_FLAT = 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0 = 0.9996
_E0 = 500000.0
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
_CONFORMAL = 2 * math.sqrt(_N) / (1 + _N)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def wgs84_to_utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """(easting, northing) in metres on the northern hemisphere."""
    phi = F.radians(lat)
    lam = F.radians(lon - central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - _CONFORMAL * _atanh(_CONFORMAL * s))
    xi = F.atan2(t, F.cos(lam))
    eta = _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * east, _K0 * _RADIUS * north


def utm_to_wgs84(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """(lat, lon) in degrees for northern-hemisphere UTM coordinates."""
    xi0 = northing / (_K0 * _RADIUS)
    eta0 = (easting - _E0) / (_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, start=1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return F.degrees(phi), F.degrees(lam) + central_meridian(zone)


def with_wgs84(df: DataFrame, easting: Column, northing: Column, zone: int) -> DataFrame:
    """Adds ``latitude`` and ``longitude``; the series runs in steps that reuse columns."""
    df = df.withColumns({"_xi0": northing / (_K0 * _RADIUS), "_eta0": (easting - _E0) / (_K0 * _RADIUS)})
    xi, eta = F.col("_xi0"), F.col("_eta0")
    for j, b in enumerate(_BETA, start=1):
        xi = xi - b * F.sin(2 * j * F.col("_xi0")) * F.cosh(2 * j * F.col("_eta0"))
        eta = eta - b * F.cos(2 * j * F.col("_xi0")) * F.sinh(2 * j * F.col("_eta0"))
    df = df.withColumns({"_xi": xi, "_eta": eta})
    df = df.withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    phi = F.col("_chi")
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * F.col("_chi"))
    lam = F.atan2(F.sinh("_eta"), F.cos("_xi"))
    return df.withColumns(
        {"latitude": F.degrees(phi), "longitude": F.degrees(lam) + central_meridian(zone)}
    ).drop("_xi0", "_eta0", "_xi", "_eta", "_chi")


# --- planar geometry -----------------------------------------------------------


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Strictly inside a closed or open ``array<struct<lon,lat>>`` ring: even-odd ray cast, edges excluded."""
    n = F.size(ring)
    crossings = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(ring, i).alias("a"),
            F.element_at(ring, F.when(i == n, 1).otherwise(i + 1)).alias("b"),
        ),
    )

    def flips(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        x_at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(
            b["lat"] - a["lat"], F.lit(0.0)
        )
        return F.when(spans & (lon < x_at), 1).otherwise(0)

    def touches(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        beside = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))
        level = lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        return (turn == 0) & beside & level

    total = F.aggregate(crossings, F.lit(0), lambda acc, e: acc + flips(e))
    return (total % 2 == 1) & ~F.exists(crossings, touches)


def point_in_box(lon: Column, lat: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def point_segment_distance_m(
    lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, shrink: Column | None = None
) -> Column:
    """Distance in metres on a local equirectangular plane centred on the point.

    ``shrink`` passes the cosine of the latitude where it is at hand already.
    """
    k = EARTH_KM * 1000.0 * math.pi / 180.0
    shrink = F.cos(F.radians(lat)) if shrink is None else shrink
    ax, ay = (lon1 - lon) * shrink * k, (lat1 - lat) * k
    bx, by = (lon2 - lon) * shrink * k, (lat2 - lat) * k
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, -(ax * dx + ay * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def _ring_terms(ring: Column, term) -> Column:
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0.0),
        lambda acc, i: acc
        + term(F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))),
    )


def ring_area_deg2(ring: Column) -> Column:
    return F.abs(_ring_terms(ring, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])) / 2


def polygon_area_acres(ring: Column) -> Column:
    return ring_area_deg2(ring) * (METRES_PER_DEGREE * METRES_PER_DEGREE) / SQ_METRES_PER_ACRE


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """(lon, lat) of the area centroid, computed relative to the first vertex."""
    o = F.element_at(ring, 1)

    def cross(a, b):
        return (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (b["lon"] - o["lon"]) * (
            a["lat"] - o["lat"]
        )

    twice = _ring_terms(ring, cross)
    sx = _ring_terms(ring, lambda a, b: (a["lon"] + b["lon"] - 2 * o["lon"]) * cross(a, b))
    sy = _ring_terms(ring, lambda a, b: (a["lat"] + b["lat"] - 2 * o["lat"]) * cross(a, b))
    return o["lon"] + sx / (3 * twice), o["lat"] + sy / (3 * twice)
