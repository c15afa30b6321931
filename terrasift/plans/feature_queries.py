"""Training features, incremental selection, unions and the assembled context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import features
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view

_ENV = ["elevation_ft", "slope_degrees", "water_distance_miles", "ndvi", "snow_crust_detected"]
_NEED = """(elevation_ft IS NULL OR abs(elevation_ft - 8500) <= 0.01 OR slope_degrees IS NULL OR abs(slope_degrees - 15) <= 0.01
  OR water_distance_miles IS NULL OR abs(water_distance_miles - 0.5) <= 0.01 OR ndvi IS NULL OR abs(ndvi - 0.5) <= 0.01
  OR snow_crust_detected IS NULL OR NOT snow_crust_detected)"""


@query(
    "rows_to_enrich",
    "P4 P6",
    cte("obs") + f"SELECT obs_id, {_NEED} AS needs FROM obs",
)
def rows_to_enrich(spark: SparkSession, d: str) -> DataFrame:
    todo, rest = features.split_for_enrichment(view(spark, d, "obs"), _ENV)
    return todo.select("obs_id", F.lit(True).alias("needs")).unionByName(rest.select("obs_id", F.lit(False).alias("needs")))


@query(
    "enrichment_dates",
    "P12 F2",
    cte("obs")
    + """
, x AS (SELECT obs_id, CASE WHEN obs_id % 4 = 0 THEN NULL ELSE date END AS date, CASE WHEN obs_id % 8 = 0 THEN 1990 END AS year FROM obs)
SELECT obs_id, coalesce(date, DATE '2024-01-01') AS enrichment_date, CAST(coalesce(year, year(date)) AS INT) AS year, month(date) AS month, dayofyear(date) AS day_of_year FROM x
""",
)
def enrichment_dates(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.plans.context import with_enrichment_date

    k = F.col("obs_id")
    o = view(spark, d, "obs").select(
        "obs_id", F.when(k % 4 != 0, F.col("date").cast("string")).alias("date"), F.when(k % 8 == 0, 1990).alias("year")
    )
    return with_enrichment_date(o).select("obs_id", "enrichment_date", "year", "month", "day_of_year")


@query(
    "training_features",
    "M13 P2 F3 F21 F22 F23",
    cte("obs")
    + """
, a AS (SELECT *, month(date) AS m, day(date) AS dd, dayofyear(date) AS doy FROM obs),
b AS (SELECT *, CASE WHEN m=9 AND dd<15 THEN 'pre_rut' WHEN m=9 OR (m=10 AND dd<10) THEN 'peak_rut' WHEN m=10 THEN 'post_rut' ELSE 'none' END AS phase FROM a)
SELECT elk_present, obs_id, elevation_ft, ndvi, round(cos(2*pi()*doy/365.25), 6) AS day_of_year_cos, round(sin(2*pi()*doy/365.25), 6) AS day_of_year_sin,
  phase AS rut_phase, CASE WHEN m >= 9 THEN doy - 243 END AS days_since_rut_start,
  CAST(CASE WHEN m >= 9 THEN (doy - 243) * elevation_ft END AS DOUBLE) AS rut_days_x_elevation,
  CAST(CASE phase WHEN 'pre_rut' THEN 1 WHEN 'peak_rut' THEN 2 WHEN 'post_rut' THEN 3 ELSE 0 END * elevation_ft AS DOUBLE) AS rut_phase_x_elevation,
  CASE phase WHEN 'pre_rut' THEN 1 WHEN 'peak_rut' THEN 2 WHEN 'post_rut' THEN 3 ELSE 0 END * m AS rut_phase_x_month, m AS month FROM b
""",
)
def training_features(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(
        "obs_id", "elk_present", "elevation_ft", "ndvi", "date", "dataset", "snow_station_name", "wolves_per_1000_elk",
        F.month("date").alias("month"), F.dayofyear("date").alias("day_of_year"),
    )
    out = features.prepare_training(o, include_interactions=True)
    return rounded(out, ["day_of_year_cos", "day_of_year_sin"])


@query(
    "optimised_features",
    "P3 F24 P1",
    cte("obs")
    + """
, q AS (SELECT quantile_cont(snow_depth_inches, 0.95) AS cap, min(temperature_f) AS t0 FROM obs)
SELECT obs_id, round(ln(1 + security_habitat_percent), 6) AS security_habitat_percent, round(least(snow_depth_inches, cap), 6) AS snow_depth_inches,
  round(sqrt(temperature_f - least(t0, 0)), 6) AS temperature_f, NOT (latitude BETWEEN 40.99 AND 45.01 AND longitude BETWEEN -111.06 AND -104.05) AS outside_bounds FROM obs, q
""",
)
def optimised_features(spark: SparkSession, d: str) -> DataFrame:
    o = features.drop_redundant(view(spark, d, "obs"))
    t = features.transform_skewed(
        o, {"security_habitat_percent": "log1p", "snow_depth_inches": "cap_95", "temperature_f": "sqrt"}
    )
    out = features.flag_outliers(t).select(
        "obs_id", "security_habitat_percent", "snow_depth_inches", "temperature_f", "outside_bounds"
    )
    return rounded(out, ["security_habitat_percent", "snow_depth_inches", "temperature_f"])


@query(
    "combined_table",
    "U1 U2 U3",
    cte("obs")
    + """
SELECT elk_present, elevation_ft, NULL::DOUBLE AS slope_degrees, obs_id FROM obs WHERE dataset = 'north'
UNION ALL SELECT elk_present, NULL, slope_degrees, obs_id FROM obs WHERE dataset = 'south'
UNION ALL SELECT elk_present, elevation_ft, slope_degrees, obs_id FROM obs WHERE dataset = 'gye'
UNION ALL SELECT elk_present, elevation_ft, NULL, obs_id FROM obs WHERE dataset = 'refuge'
""",
)
def combined_table(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs")
    return features.combine_tables(
        [
            o.filter("dataset = 'north'").select("obs_id", "elk_present", "elevation_ft"),
            o.filter("dataset = 'south'").select("slope_degrees", "obs_id", "elk_present"),
            o.filter("dataset = 'gye'").select("obs_id", "elevation_ft", "elk_present", "slope_degrees"),
            o.filter("dataset = 'refuge'").select("elevation_ft", "elk_present", "obs_id"),
        ]
    )


_CTX_NEAR = (
    "2*6371*asin(sqrt(least(1, pow(sin(radians(f.lat - o.latitude)/2),2) + cos(radians(o.latitude))*cos(radians(f.lat))*pow(sin(radians(f.lon - o.longitude)/2),2))))"
)


@query(
    "assembled_context",
    "J23 J1 J2 J3 J4 J5 J13 J24 F17",
    cte("obs", "raster_cells", "water_features", "road_lines", "hydro", "areas", "stations", "station_series", "scenes")
    + f"""
, o AS (SELECT obs_id, obs_id % 100 AS tile_id, latitude + CASE WHEN obs_id % 50 = 0 THEN 10 ELSE 0 END AS latitude, longitude, date FROM obs),
b AS (SELECT *, latitude BETWEEN 41 AND 45 AND longitude BETWEEN -111 AND -104 AS inside,
   CAST(floor((latitude - 45) / -0.1) AS INT) AS r, CAST(floor((longitude + 111) / 0.14) AS INT) AS c FROM o),
w AS (SELECT obs_id, min(round({_CTX_NEAR}, 6)) AS km FROM o, water_features f WHERE abs(f.lat - o.latitude) < 0.91 GROUP BY 1),
hy AS (SELECT obs_id, min(round({_CTX_NEAR}, 6)) AS trail_km, min(round({_CTX_NEAR}, 6)) FILTER (ftype = 999) AS bear_km FROM o, hydro f WHERE abs(f.lat - o.latitude) < 0.91 GROUP BY 1),
rp AS (SELECT obs_id, (lon1 - longitude) * cos(radians(latitude)) * k AS ax, (lat1 - latitude) * k AS ay, (lon2 - longitude) * cos(radians(latitude)) * k AS bx, (lat2 - latitude) * k AS by_
   FROM o, road_lines, (SELECT 6371000.0::DOUBLE * pi() / 180.0 AS k) WHERE abs(lat1 - latitude) < 0.95),
rt AS (SELECT *, greatest(0, least(1, -(ax*(bx-ax) + ay*(by_-ay)) / (pow(bx-ax,2) + pow(by_-ay,2)))) AS t FROM rp),
rd AS (SELECT obs_id, min(round(sqrt(pow(ax + t*(bx-ax), 2) + pow(ay + t*(by_-ay), 2)) / 1000, 6)) AS road_km FROM rt GROUP BY 1),
sc_ AS (SELECT o.obs_id, o.date, f.station_id, f.name, f.has_data, round({_CTX_NEAR}, 6) AS dist FROM o, stations f WHERE abs(f.lat - o.latitude) < 0.91),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY has_data DESC, dist, station_id) AS rn FROM sc_ WHERE dist <= 100) WHERE rn = 1),
sn AS (SELECT st.obs_id, any_value(st.name) AS name, arg_min(s.depth_in, (abs(s.date - st.date), s.date)) AS depth FROM st
   JOIN station_series s ON s.station_id = st.station_id AND abs(s.date - st.date) <= 7 GROUP BY 1),
p AS (SELECT obs_id, arg_min(pack_size / elk_count * 1000, area_id) AS wolves FROM o JOIN areas ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat GROUP BY 1),
s AS (SELECT o.obs_id, arg_min((ndvi, cloud_cover), (cloud_cover, scene_date, ndvi)) AS sc FROM o JOIN scenes USING (tile_id)
   WHERE cloud_cover < 50 AND scene_date >= date - 21 AND scene_date < date + 21 GROUP BY 1),
x AS (SELECT b.*, CASE WHEN inside THEN coalesce(value, 8500) END AS elevation, CASE WHEN inside THEN coalesce(value % 60, 15) END AS slope,
   CASE WHEN inside THEN greatest(0, least(100, coalesce(value % 130, 30))) END AS canopy, coalesce(value % 101, 35) AS security, month(date) AS m
   FROM b LEFT JOIN raster_cells v ON v.cell_row = b.r AND v.cell_col = b.c),
e AS (SELECT *, CASE WHEN m IN (12,1,2) THEN (coalesce(elevation, 8500) - 6000) / 100 WHEN m IN (3,4) THEN (coalesce(elevation, 8500) - 7000) / 150
   WHEN m IN (10,11) THEN (coalesce(elevation, 8500) - 9000) / 200 ELSE (coalesce(elevation, 8500) - 10000) / 100 END AS snow FROM x),
wx AS (SELECT station_id AS tile_id, date, temperature_f, swe_in, depth_in FROM station_series)
SELECT obs_id, elevation AS elevation_ft, slope AS slope_degrees, canopy AS canopy_cover_percent, security AS security_habitat_percent,
  round(CASE WHEN km <= 100 THEN km * 1000 / 1609.34 ELSE 10 END, 5) AS water_distance_miles,
  round(CASE WHEN road_km <= 100 THEN road_km * 1000 / 1609.34 ELSE 10 END, 5) AS road_distance_miles,
  round(CASE WHEN trail_km <= 100 THEN trail_km * 1000 / 1609.34 ELSE 10 END, 5) AS trail_distance_miles,
  round(CASE WHEN bear_km <= 100 THEN bear_km * 1000 / 1609.34 ELSE 10 END, 5) AS bear_activity_distance_miles,
  round(coalesce(wolves, 0.5), 6) AS wolves_per_1000_elk, 0.75::DOUBLE AS wolf_data_quality, 0.65::DOUBLE AS bear_data_quality,
  round(coalesce(depth, greatest(snow, 0)), 6) AS snow_depth_inches, CASE WHEN depth IS NULL THEN 'estimate' ELSE 'snotel' END AS snow_data_source, sn.name AS snow_station_name,
  coalesce(wx.temperature_f, 45)::DOUBLE AS temperature_f, round(coalesce(wx.swe_in, 0), 6)::DOUBLE AS precip_last_7_days_inches,
  round(coalesce(sc[1], CASE WHEN m IN (6,7,8) THEN 0.70 WHEN m IN (9,10) THEN 0.55 WHEN m IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END::DOUBLE), 6) AS ndvi,
  coalesce(sc[2], wx.depth_in, 20)::DOUBLE AS cloud_cover_percent, 0.9::DOUBLE AS pregnancy_rate
FROM e LEFT JOIN w USING (obs_id) LEFT JOIN hy USING (obs_id) LEFT JOIN rd USING (obs_id) LEFT JOIN sn USING (obs_id) LEFT JOIN p USING (obs_id) LEFT JOIN s USING (obs_id)
  LEFT JOIN wx ON wx.tile_id = e.tile_id AND wx.date = e.date
""",
)
def assembled_context(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.plans.context import assemble_context
    from terrasift.plans.layers import context_layers

    k = F.col("obs_id")
    o = view(spark, d, "obs").select(
        "obs_id",
        (k % 100).alias("tile_id"),
        (F.col("latitude") + F.when(k % 50 == 0, 10).otherwise(0)).alias("latitude"),
        "longitude",
        "date",
    )
    layers = context_layers(spark, d)
    out = assemble_context(o, layers).select(
        "obs_id", "elevation_ft", "slope_degrees", "canopy_cover_percent", "security_habitat_percent", "water_distance_miles",
        "road_distance_miles", "trail_distance_miles", "bear_activity_distance_miles", "wolves_per_1000_elk", "wolf_data_quality",
        "bear_data_quality", "snow_depth_inches", "snow_data_source", "snow_station_name", "temperature_f",
        "precip_last_7_days_inches", "ndvi", "cloud_cover_percent", "pregnancy_rate",
    )
    out = rounded(out, ["wolves_per_1000_elk", "snow_depth_inches", "precip_last_7_days_inches", "ndvi"])
    return rounded(out, [f"{k}_distance_miles" for k in ("water", "road", "trail", "bear_activity")], 5)
