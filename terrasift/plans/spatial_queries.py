"""Polygons, habitat rules, coverage and layer profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.operators import habitat, polygons, spatial
from terrasift.operators.features import STUDY_AREA
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view

HEXAGON = [(-108.5, 42.0), (-107.0, 41.6), (-105.6, 42.1), (-105.4, 43.4), (-106.9, 44.1), (-108.4, 43.5)]


def _areas(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "areas")
    ring = spatial.box_ring(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
    return a.select("area_id", "name", "pack_size", "elk_count", ring.alias("ring"))


@query(
    "area_of_observation",
    "J13 F11",
    cte("obs", "areas")
    + """
, m AS (SELECT obs_id, arg_min((area_id, pack_size, elk_count), area_id) AS b FROM obs JOIN areas
   ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat GROUP BY 1)
SELECT obs_id, round(CASE WHEN b IS NULL THEN 0.5 ELSE b[2] / b[3] * 1000 END, 6) AS wolves_per_1000_elk FROM obs LEFT JOIN m USING (obs_id)
""",
)
def area_of_observation(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = spatial.with_wolf_density(o, _areas(spark, d))
    return rounded(out.select("obs_id", "wolves_per_1000_elk"), ["wolves_per_1000_elk"])


def _hexagon(spark: SparkSession) -> DataFrame:
    ring = [{"lon": x, "lat": y} for x, y in HEXAGON]
    return spark.createDataFrame([(1, ring)], "area_id int, ring array<struct<lon:double,lat:double>>")


_EDGES = ", e(ax, ay, bx, by_) AS (VALUES " + ", ".join(
    f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(HEXAGON, HEXAGON[1:] + HEXAGON[:1])
) + ")"
_BOUNDARY = (
    _EDGES
    + """
, g AS (SELECT obs_id, latitude, longitude, (ax - longitude) * cos(radians(latitude)) * k AS x1, (ay - latitude) * k AS y1,
   (bx - longitude) * cos(radians(latitude)) * k AS x2, (by_ - latitude) * k AS y2,
   CASE WHEN (ay > latitude) <> (by_ > latitude) AND longitude < ax + (latitude - ay) * (bx - ax) / nullif(by_ - ay, 0) THEN 1 ELSE 0 END AS flip
   FROM obs, e, (SELECT 6371000.0::DOUBLE * pi() / 180 AS k)),
t AS (SELECT *, greatest(0, least(1, -(x1*(x2-x1) + y1*(y2-y1)) / (pow(x2-x1, 2) + pow(y2-y1, 2)))) AS t FROM g),
b AS (SELECT obs_id, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
   CASE WHEN sum(flip) % 2 = 1 THEN 0 ELSE min(sqrt(pow(x1 + t*(x2-x1), 2) + pow(y1 + t*(y2-y1), 2))) / 1000 END AS km FROM t GROUP BY 1)
"""
)


@query(
    "distance_to_area",
    "J14 F12 F11",
    cte("obs")
    + _BOUNDARY
    + """
SELECT obs_id, round(km, 5) AS boundary_km,
  round(2*6371*asin(sqrt(pow(sin(radians(42.8 - latitude)/2), 2) + cos(radians(latitude))*cos(radians(42.8))*pow(sin(radians(-107.0 - longitude)/2), 2))), 5) AS centre_km FROM b
""",
)
def distance_to_area(spark: SparkSession, d: str) -> DataFrame:
    o = polygons.nearest_area(view(spark, d, "obs"), _hexagon(spark), "area_id")
    centre = spatial.centre_distance_km(F.col("latitude"), F.col("longitude"), 42.8, -107.0)
    return o.select("obs_id", F.round("area.distance_km", 5).alias("boundary_km"), F.round(centre, 5).alias("centre_km"))


@query(
    "share_near_area",
    "J14",
    cte("obs")
    + _BOUNDARY
    + "SELECT count(*) AS n, round(count(*) FILTER (km <= 50) / count(*), 6) AS within_50_km, round(count(*) FILTER (km <= 200) / count(*), 6) AS within_200_km FROM b",
)
def share_near_area(spark: SparkSession, d: str) -> DataFrame:
    o = polygons.nearest_area(view(spark, d, "obs"), _hexagon(spark), "area_id")
    return rounded(spatial.within_shares(o, F.col("area.distance_km"), [50, 200]), ["within_50_km", "within_200_km"])


_SHAPES = cte("obs", "areas") + """
, q AS (SELECT area_id, min_lon AS w, max_lon AS e, min_lat AS s, max_lat AS n, (min_lon + max_lon) / 2 AS mx, (min_lat + max_lat) / 2 AS my,
   min_lon + (max_lon - min_lon) / 4 AS w4, max_lon - (max_lon - min_lon) / 4 AS e4, min_lat + (max_lat - min_lat) / 4 AS s4, max_lat - (max_lat - min_lat) / 4 AS n4 FROM areas)
"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """By area id: a corner shape (concave), two parts, or a part with a hole."""
    c = {
        "w": F.col("min_lon"), "e": F.col("max_lon"), "s": F.col("min_lat"), "n": F.col("max_lat"),
        "mx": (F.col("min_lon") + F.col("max_lon")) / 2, "my": (F.col("min_lat") + F.col("max_lat")) / 2,
        "w4": F.col("min_lon") + (F.col("max_lon") - F.col("min_lon")) / 4, "e4": F.col("max_lon") - (F.col("max_lon") - F.col("min_lon")) / 4,
        "s4": F.col("min_lat") + (F.col("max_lat") - F.col("min_lat")) / 4, "n4": F.col("max_lat") - (F.col("max_lat") - F.col("min_lat")) / 4,
    }
    ring = lambda *at: F.array(*[F.struct(c[x].alias("lon"), c[y].alias("lat")) for x, y in (p.split() for p in at)])
    box = lambda w, s, e, n: ring(f"{w} {s}", f"{e} {s}", f"{e} {n}", f"{w} {n}")
    corner = F.array(ring("w s", "e s", "e my", "mx my", "mx n", "w n"))
    kind = F.col("area_id") % 3
    shape = F.when(kind == 0, corner).when(kind == 1, F.array(box("w", "s", "w4", "n"), box("e4", "s", "e", "n"))).otherwise(F.array(box("w", "s", "e", "n"), box("w4", "s4", "e4", "n4")))
    return view(spark, d, "areas").select("area_id", shape.alias("rings"))


@query(
    "area_shapes",
    "J13",
    _SHAPES
    + """
, h AS (SELECT obs_id, min(area_id) AS area_id FROM (SELECT *, longitude AS x, latitude AS y FROM obs, q WHERE longitude > w AND longitude < e AND latitude > s AND latitude < n)
   WHERE CASE area_id % 3 WHEN 0 THEN x < mx OR y < my WHEN 1 THEN x < w4 OR x > e4 ELSE x < w4 OR x > e4 OR y < s4 OR y > n4 END GROUP BY 1)
SELECT obs_id, area_id FROM obs LEFT JOIN h USING (obs_id)
""",
)
def area_shapes(spark: SparkSession, d: str) -> DataFrame:
    """First of concave, two-part and holed areas that holds an observation."""
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    return polygons.first_containing(o, _shapes(spark, d), "area_id", []).select("obs_id", "area.area_id")


@query(
    "distance_to_areas",
    "J14",
    cte("obs", "areas")
    + """
, k AS (SELECT 6371000.0::DOUBLE * pi() / 180 AS k), c AS (SELECT *, cos(radians(latitude)) * k AS kx, k AS ky FROM obs, k),
p AS (SELECT obs_id, area_id, greatest(min_lon - longitude, longitude - max_lon, 0) * kx AS dx, greatest(min_lat - latitude, latitude - max_lat, 0) * ky AS dy FROM c, areas),
m AS (SELECT obs_id, arg_min((sqrt(dx * dx + dy * dy) / 1000, area_id), (round(sqrt(dx * dx + dy * dy) / 1000, 6), area_id)) AS b FROM p GROUP BY 1)
SELECT obs_id, b[2] AS area_id, round(b[1], 5) AS boundary_km FROM m
""",
)
def distance_to_areas(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of a table of polygons, 0 inside."""
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = polygons.nearest_area(o, _areas(spark, d), "area_id")
    return out.select("obs_id", "area.area_id", F.round("area.distance_km", 5).alias("boundary_km"))


@query(
    "hunt_area_members",
    "J13",
    cte("obs", "areas")
    + """
, a AS (SELECT min(area_id) AS first FROM areas)
SELECT obs_id, latitude BETWEEN 43.0707 AND 43.7503 AND longitude BETWEEN -107.9076 AND -107.1333 AS by_bounds,
  longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat AS by_polygon FROM obs, a JOIN areas ON area_id = first
""",
)
def hunt_area_members(spark: SparkSession, d: str) -> DataFrame:
    """By the area's bounds without its polygon, and by a polygon filed under its code."""
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    areas = _areas(spark, d)
    first = areas.agg(F.min("area_id")).scalar()
    coded = areas.withColumn("hunt_area", F.when(F.col("area_id") == first, 48.0).otherwise(F.col("area_id") + 100.0))
    by_bounds = polygons.with_hunt_area(o, coded.filter("hunt_area <> 48"), out="by_bounds")
    return polygons.with_hunt_area(by_bounds, coded, out="by_polygon").select("obs_id", "by_bounds", "by_polygon")


@query(
    "polygon_measures",
    "F14",
    cte("areas")
    + """
SELECT area_id, round((max_lon - min_lon) * (max_lat - min_lat) * (111139.0::DOUBLE * 111139) / 4046.86, 2) AS acres,
  round((min_lon + max_lon) / 2, 6) AS centre_lon, round((min_lat + max_lat) / 2, 6) AS centre_lat FROM areas
""",
)
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.ring_centroid(F.col("ring"))
    return _areas(spark, d).select(
        "area_id",
        F.round(geo.polygon_area_acres(F.col("ring")), 2).alias("acres"),
        F.round(lon, 6).alias("centre_lon"),
        F.round(lat, 6).alias("centre_lat"),
    )


@query(
    "coverage_report",
    "P13",
    cte("hydro")
    + """
, a AS (SELECT count(*) AS n, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
  count(*) FILTER (lat >= 43 AND lon >= -107.5) AS n_ne, count(*) FILTER (lat >= 43 AND lon < -107.5) AS n_nw,
  count(*) FILTER (lat < 43 AND lon >= -107.5) AS n_se, count(*) FILTER (lat < 43 AND lon < -107.5) AS n_sw FROM hydro)
SELECT n, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat, round(min_lon, 6) AS min_lon, round(max_lon, 6) AS max_lon, n_ne, n_nw, n_se, n_sw,
  round(greatest(min_lat - 41, 0), 6) AS gap_south, round(greatest(45 - max_lat, 0), 6) AS gap_north,
  round(greatest(min_lon + 111, 0), 6) AS gap_west, round(greatest(-104 - max_lon, 0), 6) AS gap_east,
  round(greatest(least(max_lon, -104) - greatest(min_lon, -111), 0) * greatest(least(max_lat, 45) - greatest(min_lat, 41), 0) / 28 * 100, 6) AS overlap_pct FROM a
""",
)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.coverage_report(view(spark, d, "hydro"), STUDY_AREA)
    return rounded(out, [c for c in out.columns if not c.startswith("n")])


@query(
    "habitat_rules",
    "P9 P10 P11",
    cte("obs")
    + """
SELECT obs_id, elevation_ft BETWEEN 6000 AND 13500 AND slope_degrees < 45 AND water_distance_miles <= 5 AS suitable,
  elevation_ft < 4000 OR elevation_ft > 14000 OR slope_degrees > 60 OR land_cover_code IN (11,12,21,22,23,24,31) OR water_distance_miles > 10 AS unsuitable,
  elevation_ft < 4000 OR slope_degrees >= 45 OR water_distance_miles > 10 AS unsuitable_short,
  CASE WHEN month(date) IN (12,1,2,3) AND elevation_ft >= 9000 THEN 'winter_too_high' WHEN month(date) IN (6,7,8) AND elevation_ft <= 6000 THEN 'summer_too_low'
    WHEN month(date) IN (9,10,11) AND elevation_ft >= 11000 THEN 'fall_too_high' WHEN month(date) IN (9,10,11) AND elevation_ft <= 5000 THEN 'fall_too_low' END AS season_rule
FROM obs
""",
)
def habitat_rules(spark: SparkSession, d: str) -> DataFrame:
    e, s, w, c = (F.col(n) for n in ("elevation_ft", "slope_degrees", "water_distance_miles", "land_cover_code"))
    return view(spark, d, "obs").select(
        "obs_id",
        habitat.suitable(e, s, w).alias("suitable"),
        habitat.unsuitable(e, s, w, c).alias("unsuitable"),
        habitat.unsuitable(e, s, w, variant="worker").alias("unsuitable_short"),
        habitat.season_elevation_rule(F.month("date"), e).alias("season_rule"),
    )
