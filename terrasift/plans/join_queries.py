"""Nearest, as-of, interval and cell lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import nearest as nn
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view

HAV = (
    "round(2*6371*asin(sqrt(least(1, pow(sin(radians({f}lat - {p}latitude)/2),2) + cos(radians({p}latitude))*cos(radians({f}lat))"
    "*pow(sin(radians({f}lon - {p}longitude)/2),2)))), 6)"
)
NEAR = HAV.format(f="f.", p="o.")


@query(
    "nearest_water",
    "J2 R1 F9",
    cte("obs", "water_features")
    + f"""
, n AS (SELECT obs_id, arg_min((dist, feature_id, water_type), (dist, feature_id)) AS b FROM
   (SELECT o.obs_id, f.feature_id, f.water_type, {NEAR} AS dist FROM obs o, water_features f WHERE abs(f.lat - o.latitude) < 0.91) GROUP BY 1)
SELECT obs_id, round(CASE WHEN b[1] <= 100 THEN b[1] * 1000 / 1609.34 ELSE 10 END, 5) AS water_distance_miles,
  CAST(CASE WHEN b IS NULL OR b[1] > 100 THEN 0.5 ELSE CASE b[3] WHEN 'spring' THEN 1.0 WHEN 'lake' THEN 1.0 WHEN 'pond' THEN 0.9
    WHEN 'stream' THEN 0.7 WHEN 'creek' THEN 0.7 WHEN 'ephemeral' THEN 0.4 ELSE 0.7 END END AS DOUBLE) AS water_reliability
FROM obs LEFT JOIN n USING (obs_id)
""",
)
def nearest_water(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = nn.with_water(o, view(spark, d, "water_features"))
    return rounded(out.select("obs_id", "water_distance_miles", "water_reliability"), ["water_distance_miles"], 5)


@query(
    "nearest_road",
    "J3 F12",
    cte("obs", "road_lines")
    + """
, k AS (SELECT 6371000.0::DOUBLE * pi() / 180.0 AS k),
p AS (SELECT obs_id, road_id, (lon1 - longitude) * cos(radians(latitude)) * k AS ax, (lat1 - latitude) * k AS ay,
   (lon2 - longitude) * cos(radians(latitude)) * k AS bx, (lat2 - latitude) * k AS by_ FROM obs, road_lines, k
   WHERE abs(lat1 - latitude) < 0.25 AND abs(lon1 - longitude) < 0.45),
t AS (SELECT *, greatest(0, least(1, -(ax*(bx-ax) + ay*(by_-ay)) / (pow(bx-ax,2) + pow(by_-ay,2)))) AS t FROM p),
m AS (SELECT obs_id, min(round(sqrt(pow(ax + t*(bx-ax), 2) + pow(ay + t*(by_-ay), 2)) / 1000, 6)) AS km FROM t GROUP BY 1)
SELECT obs_id, round(CASE WHEN km <= 20 THEN km * 1000 / 1609.34 ELSE 10 END, 5) AS road_distance_miles FROM obs LEFT JOIN m USING (obs_id)
""",
)
def nearest_road(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    lines = view(spark, d, "road_lines").select("road_id", "lat1", "lon1", "lat2", "lon2")
    out = nn.with_feature_distance(o, lines, "road_distance_miles", feature_id="road_id", cap_km=20.0)
    return rounded(out.select("obs_id", "road_distance_miles"), ["road_distance_miles"], 5)


_STATION = f"""
, c AS (SELECT o.obs_id, f.station_id, f.name, f.has_data, {NEAR} AS dist FROM obs o, stations f WHERE abs(f.lat - o.latitude) < 0.91),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY has_data DESC, dist, station_id) AS rn FROM c WHERE dist <= 100) WHERE rn = 1)
"""


@query(
    "nearest_station",
    "J4",
    cte("obs", "stations")
    + _STATION
    + "SELECT obs_id, station_id, name AS station_name, has_data, dist AS station_distance_km FROM obs LEFT JOIN st USING (obs_id)",
)
def nearest_station(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = nn.with_station(o, view(spark, d, "stations"))
    s = F.col("station")
    return out.select(
        "obs_id",
        s["station_id"].alias("station_id"),
        s["name"].alias("station_name"),
        s["has_data"].alias("has_data"),
        s["distance_km"].alias("station_distance_km"),
    )


@query(
    "separated_candidates",
    "J15",
    cte("obs")
    + f"""
, a AS (SELECT obs_id, latitude, longitude FROM obs WHERE elk_present = 0),
p AS (SELECT latitude AS lat, longitude AS lon FROM obs WHERE elk_present = 1),
n AS (SELECT DISTINCT o.obs_id FROM a o, p f WHERE abs(f.lat - o.latitude) < 0.019 AND abs(f.lon - o.longitude) < 0.03 AND {NEAR} * 1000 < 2000)
SELECT obs_id FROM a WHERE obs_id NOT IN (SELECT obs_id FROM n)
""",
)
def separated_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "elk_present")
    present = o.filter("elk_present = 1").select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    absent = o.filter("elk_present = 0").select("obs_id", "latitude", "longitude")
    return nn.beyond_distance(absent, present, 2000.0).select("obs_id")


# obs joined to a station by id, so the as-of logic is checked apart from the distance search
_OBS_STATION = "\n, r AS (SELECT obs_id, obs_id % 100 AS station_id, date, elevation_ft FROM obs)"


def _obs_station(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").select(
        "obs_id", (F.col("obs_id") % 100).alias("station_id"), "date", "elevation_ft"
    )


@query(
    "station_snow_asof",
    "J5 F17 F18",
    cte("obs", "station_series")
    + _OBS_STATION
    + """
, m AS (SELECT obs_id, arg_min((s.date, abs(s.date - r.date), depth_in, swe_in), (abs(s.date - r.date), s.date)) AS b
   FROM r JOIN station_series s ON s.station_id = r.station_id AND abs(s.date - r.date) <= 7 GROUP BY 1)
SELECT obs_id, b[1] AS matched_date, CAST(b[2] AS INT) AS days_off, b[3] AS depth_in, round(b[4], 6) AS swe_in,
  coalesce(b[3] > 0 AND b[4] / nullif(b[3], 0) > 0.35, false) AS crust FROM r LEFT JOIN m USING (obs_id)
""",
)
def station_snow_asof(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.functions.snow import crust_detected
    from terrasift.operators.asof import nearest_day

    out = nearest_day(_obs_station(spark, d), view(spark, d, "station_series"), ["station_id"], ["depth_in", "swe_in"])
    m = F.col("matched")
    return out.select(
        "obs_id",
        m["date"].alias("matched_date"),
        m["days_off"].alias("days_off"),
        m["depth_in"].alias("depth_in"),
        F.round(m["swe_in"], 6).alias("swe_in"),
        crust_detected(m["depth_in"], m["swe_in"]).alias("crust"),
    )


_TILES = "\n, r AS (SELECT obs_id, obs_id % 100 AS tile_id, date FROM obs)"


def _obs_tile(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").select("obs_id", (F.col("obs_id") % 100).alias("tile_id"), "date")


@query(
    "clearest_scene",
    "J6 J7",
    cte("obs", "scenes")
    + _TILES
    + """
, b AS (SELECT obs_id, arg_min((cloud_cover, scene_date, ndvi), (cloud_cover, scene_date, ndvi)) AS s, any_value(r.date) AS d
   FROM r JOIN scenes USING (tile_id) WHERE cloud_cover < 30 AND scene_date >= date - 21 AND scene_date < date + 21 GROUP BY 1)
SELECT obs_id, round(s[3], 6) AS ndvi, s[1] AS cloud_cover, s[2] AS scene_date, CAST(abs(d - s[2]) AS INT) AS age_days FROM r LEFT JOIN b USING (obs_id)
""",
)
def clearest_scene(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.scenes import clearest_scene as pick

    out = pick(_obs_tile(spark, d), view(spark, d, "scenes"))
    return out.select("obs_id", F.round("scene.ndvi", 6).alias("ndvi"), "scene.cloud_cover", "scene.scene_date", "scene.age_days")


_VEG = (
    _TILES
    + """
, q AS (SELECT tile_id, date FROM r UNION SELECT tile_id, CAST(date - 21 AS DATE) FROM r),
b AS (SELECT q.tile_id, q.date, arg_min((cloud_cover, scene_date, ndvi), (cloud_cover, scene_date, ndvi)) AS s
   FROM q JOIN scenes USING (tile_id) WHERE cloud_cover < 30 AND scene_date >= date - 21 AND scene_date < date + 21 GROUP BY 1, 2),
v AS (SELECT r.obs_id, c.s IS NOT NULL AS ndvi_found,
  coalesce(c.s[3], CASE WHEN month(r.date) IN (6,7,8) THEN 0.70 WHEN month(r.date) IN (9,10) THEN 0.55 WHEN month(r.date) IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END::DOUBLE) AS ndvi,
  c.s[1] AS scene_cloud, CAST(coalesce(abs(r.date - c.s[2]), 8) AS INT) AS ndvi_age_days,
  coalesce((c.s[3] - p.s[3]) / 21, CASE WHEN month(r.date) IN (4,5) THEN 0.01 WHEN month(r.date) IN (9,10) THEN -0.005 ELSE 0 END::DOUBLE) AS irg
  FROM r LEFT JOIN b c ON c.tile_id = r.tile_id AND c.date = r.date LEFT JOIN b p ON p.tile_id = r.tile_id AND p.date = r.date - 21)
"""
)


@query(
    "vegetation_features",
    "J8 J24 R3",
    cte("obs", "scenes") + _VEG + "SELECT obs_id, ndvi_found, round(ndvi, 6) AS ndvi, scene_cloud, ndvi_age_days, round(irg, 6) AS irg FROM v",
)
def vegetation_features(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.scenes import with_vegetation

    out = with_vegetation(_obs_tile(spark, d), view(spark, d, "scenes"))
    return rounded(out.select("obs_id", "ndvi_found", "ndvi", "scene_cloud", "ndvi_age_days", "irg"), ["ndvi", "irg"])


@query(
    "ndvi_success_rate",
    "J24",
    cte("obs", "scenes") + _VEG + "SELECT count(*) AS n, round(avg(CAST(ndvi_found AS INT)), 6) AS success_rate FROM v",
)
def ndvi_success_rate(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.scenes import ndvi_success, with_vegetation

    return rounded(ndvi_success(with_vegetation(_obs_tile(spark, d), view(spark, d, "scenes"))), ["success_rate"])


@query(
    "summer_ndvi",
    "A15 F20",
    cte("obs", "scenes")
    + _TILES
    + """
, day AS (SELECT tile_id, scene_date, arg_min(ndvi, (cloud_cover, ndvi)) AS ndvi FROM scenes
    WHERE cloud_cover < 50 AND month(scene_date) BETWEEN 6 AND 9 AND ndvi BETWEEN -1 AND 1 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY tile_id, year(scene_date) ORDER BY scene_date) AS rn FROM day),
s AS (SELECT tile_id, year(scene_date) AS y, sum(ndvi) AS v FROM k WHERE rn <= 8 GROUP BY 1, 2)
SELECT obs_id, round(coalesce(v, 60), 6) AS summer_integrated_ndvi FROM r LEFT JOIN s ON s.tile_id = r.tile_id
  AND s.y = CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END
""",
)
def summer_ndvi(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.scenes import with_summer_ndvi

    out = with_summer_ndvi(_obs_tile(spark, d), view(spark, d, "scenes"))
    return rounded(out.select("obs_id", "summer_integrated_ndvi"), ["summer_integrated_ndvi"])


_RUN = """
, w AS (SELECT *, CASE WHEN month(date) >= 11 THEN year(date) ELSE year(date) - 1 END AS winter,
   depth_in * CASE WHEN temperature_f > 20 THEN 0 WHEN temperature_f >= 0 THEN (20 - temperature_f) / 20 ELSE 2 END AS dw
   FROM station_series WHERE month(date) >= 11 OR month(date) <= 4)
"""


@query(
    "running_winter_severity",
    "W3 A14",
    cte("station_series")
    + _RUN
    + "SELECT station_id, date, round(sum(dw) OVER (PARTITION BY station_id, winter ORDER BY date), 4) AS wsi FROM w",
)
def running_winter_severity(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.winter import running_severity

    out = running_severity(view(spark, d, "station_series"), ["station_id"])
    return rounded(out.select("station_id", "date", "wsi"), ["wsi"], 4)


@query(
    "winter_index",
    "A14 H9",
    cte("obs", "station_series")
    + _OBS_STATION
    + _RUN
    + """
, u AS (SELECT *, CASE WHEN month(date) BETWEEN 5 AND 10 THEN make_date(year(date), 4, 30) ELSE date END AS upto FROM r),
x AS (SELECT u.*, CASE WHEN month(upto) >= 11 THEN year(upto) ELSE year(upto) - 1 END AS winter FROM u)
SELECT obs_id, round(coalesce(sum(dw), 0), 4) AS winter_severity_index
FROM x LEFT JOIN w ON w.station_id = x.station_id AND w.winter = x.winter AND w.date <= x.upto GROUP BY obs_id
""",
)
def winter_index(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.winter import severity_at

    out = severity_at(_obs_station(spark, d), view(spark, d, "station_series"), ["station_id"])
    return rounded(out.select("obs_id", "winter_severity_index"), ["winter_severity_index"], 4)


GRID = {"origin_lat": 45.0, "origin_lon": -111.0, "d_lat": -0.1, "d_lon": 0.14}
CLIMATE_GRID = {"origin_lat": 45.0, "origin_lon": -111.0, "d_lat": -0.4, "d_lon": 0.7}
_CELL = "CAST(floor((latitude - 45) / -0.1) AS INT) AS cell_row, CAST(floor((longitude + 111) / 0.14) AS INT) AS cell_col"
_CLIMATE_CELL = "CAST(floor((latitude - 45) / -0.4) AS INT) AS cell_row, CAST(floor((longitude + 111) / 0.7) AS INT) AS cell_col"


@query(
    "raster_sample",
    "J1 S7",
    cte("obs", "raster_cells")
    + f"""
, p AS (SELECT obs_id, {_CELL} FROM obs)
SELECT obs_id, coalesce(nullif(value, 4000), 8500) AS elevation FROM p LEFT JOIN raster_cells USING (cell_row, cell_col)
""",
)
def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.gridlookup import sample_raster

    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = sample_raster(o, view(spark, d, "raster_cells"), GRID, "elevation", default=8500.0, nodata=4000.0)
    return out.select("obs_id", "elevation")


@query(
    "raster_layers",
    "J1",
    cte("obs", "raster_cells")
    + f"""
, p AS (SELECT obs_id, {_CELL} FROM obs)
SELECT obs_id, coalesce(value, 8500) AS dem, coalesce(value % 60, 15) AS slope, coalesce(value % 100, 30) AS canopy
FROM p LEFT JOIN raster_cells USING (cell_row, cell_col)
""",
)
def raster_layers(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.gridlookup import sample_layers

    c = view(spark, d, "raster_cells")
    v = F.col("value")
    layers = c.select(
        "cell_row",
        "cell_col",
        F.inline(
            F.array(
                F.struct(F.lit("dem").alias("layer"), v.alias("value")),
                F.struct(F.lit("slope").alias("layer"), (v % 60).alias("value")),
                F.struct(F.lit("canopy").alias("layer"), (v % 100).alias("value")),
            )
        ),
    )
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude")
    out = sample_layers(o, layers, GRID, {"dem": 8500.0, "slope": 15.0, "canopy": 30.0})
    return out.select("obs_id", "dem", "slope", "canopy")


@query(
    "climate_sample",
    "J16",
    cte("obs", "climate_cells")
    + f"""
, p AS (SELECT obs_id, date, {_CLIMATE_CELL} FROM obs)
SELECT obs_id, round(CASE WHEN tmean >= -9000 THEN CASE WHEN source_format = 'bil' THEN tmean / 100 ELSE tmean END END, 6) AS tmean,
  round(CASE WHEN ppt >= -9000 THEN CASE WHEN source_format = 'bil' THEN ppt / 100 ELSE ppt END END, 6) AS ppt
FROM p LEFT JOIN climate_cells USING (cell_row, cell_col, date)
""",
)
def climate_sample(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.gridlookup import sample_climate

    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date")
    out = sample_climate(o, view(spark, d, "climate_cells"), CLIMATE_GRID, ["tmean", "ppt"])
    return rounded(out.select("obs_id", "tmean", "ppt"), ["tmean", "ppt"])


@query(
    "precipitation_week",
    "A16",
    cte("obs", "climate_cells")
    + f"""
, p AS (SELECT obs_id, date, {_CLIMATE_CELL} FROM obs), c AS (SELECT * FROM climate_cells WHERE ppt >= -9000)
SELECT obs_id, round(coalesce(sum(ppt), 0) / 25.4, 6) AS precip_inches FROM p LEFT JOIN c
  ON c.cell_row = p.cell_row AND c.cell_col = p.cell_col AND c.date BETWEEN p.date - 7 AND p.date GROUP BY obs_id
""",
)
def precipitation_week(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.functions.units import mm_to_inches
    from terrasift.operators.asof import window_sum
    from terrasift.operators.gridlookup import cell_of

    row, col = cell_of(F.col("latitude"), F.col("longitude"), **CLIMATE_GRID)
    o = view(spark, d, "obs").select("obs_id", "date", row.alias("cell_row"), col.alias("cell_col"))
    c = view(spark, d, "climate_cells").filter("ppt >= -9000")
    out = window_sum(o, c, ["cell_row", "cell_col"], "ppt", out="mm")
    return out.select("obs_id", F.round(mm_to_inches(F.coalesce("mm", F.lit(0.0))), 6).alias("precip_inches"))


def _cloud_sql(hours: str) -> str:
    return (
        cte("obs", "cloud_cube")
        + f"""
, g AS (SELECT CAST(round_even(grid_lat / 0.25, 0) AS INT) AS ny, CAST(round_even(grid_lon / 0.25, 0) AS INT) AS nx, date, avg(tcc) AS m
   FROM cloud_cube {hours} GROUP BY 1, 2, 3),
p AS (SELECT obs_id, date, CAST(round_even(latitude / 0.25, 0) AS INT) AS ny, CAST(round_even((longitude + 360) / 0.25, 0) AS INT) AS nx FROM obs)
SELECT obs_id, round(CASE WHEN m <= 1 THEN m * 100 ELSE m END, 6) AS cloud_cover_percent FROM p LEFT JOIN g USING (ny, nx, date)
"""
    )


def _cloud(spark: SparkSession, d: str, when) -> DataFrame:
    from terrasift.operators.gridlookup import cloud_cover

    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date")
    out = cloud_cover(o, view(spark, d, "cloud_cube"), when)
    return rounded(out.select("obs_id", "cloud_cover_percent"), ["cloud_cover_percent"])


@query("cloud_cover_daily", "J17 J25", _cloud_sql(""))
def cloud_cover_daily(spark: SparkSession, d: str) -> DataFrame:
    return _cloud(spark, d, "daily_mean")


@query("cloud_cover_night", "J17", _cloud_sql("WHERE hour IN (0, 6)"))
def cloud_cover_night(spark: SparkSession, d: str) -> DataFrame:
    return _cloud(spark, d, "night")


@query(
    "weather_source",
    "J22 F16",
    cte("obs", "station_series")
    + _OBS_STATION
    + """
, fc AS (SELECT station_id, date, temperature_f AS tm, temperature_f + 8 AS tx, CASE WHEN depth_in > 40 THEN NULL ELSE temperature_f - 8 END AS tn,
   swe_in / 50 AS pr, depth_in * 2 AS cl, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn FROM station_series WHERE date > DATE '2000-06-01'),
wk AS (SELECT station_id, sum(pr) AS wk FROM fc WHERE rn <= 7 GROUP BY 1)
SELECT obs_id, CASE WHEN r.date > DATE '2000-06-01' THEN 'forecast' ELSE 'historical' END AS weather_source,
  round(CASE WHEN r.date > DATE '2000-06-01' THEN coalesce(tm, 45) ELSE coalesce((h.depth_in - 20) * 9 / 5 + 32, 42) END, 6) AS temp,
  round(CASE WHEN r.date > DATE '2000-06-01' THEN coalesce(tx, 55) ELSE coalesce((h.depth_in - 15) * 9 / 5 + 32, 52) END, 6) AS temp_high,
  round(CASE WHEN r.date > DATE '2000-06-01' THEN coalesce(tn, 35) ELSE coalesce((h.depth_in - 25) * 9 / 5 + 32, 32) END, 6) AS temp_low,
  round(CASE WHEN r.date > DATE '2000-06-01' THEN coalesce(CASE WHEN tm IS NULL THEN NULL ELSE wk END, 0.3) ELSE coalesce(h.swe_in / 25.4, 0.5) END, 6) AS precip_7d,
  CAST(CASE WHEN r.date > DATE '2000-06-01' THEN coalesce(cl, 30) ELSE coalesce(h.depth_in, 40) END AS DOUBLE) AS cloud_cover,
  CAST(CASE WHEN r.date > DATE '2000-06-01' THEN 10 ELSE 12 END AS DOUBLE) AS wind_mph
FROM r LEFT JOIN fc ON fc.station_id = r.station_id AND fc.date = r.date LEFT JOIN wk ON wk.station_id = r.station_id
  LEFT JOIN station_series h ON h.station_id = r.station_id AND h.date = r.date
""",
)
def weather_source(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.gridlookup import with_weather

    s = view(spark, d, "station_series")
    depth, t = F.col("depth_in"), F.col("temperature_f")
    history = s.select(
        "station_id", "date", (depth - 20).alias("tmean_c"), (depth - 15).alias("tmax_c"), (depth - 25).alias("tmin_c"),
        F.col("swe_in").alias("ppt_7d_mm"), depth.alias("cloud_percent"),
    )
    as_of = F.lit("2000-06-01").cast("date")
    forecast = s.filter(F.col("date") > as_of).select(
        "station_id", "date", t.alias("temp_mean_f"), (t + 8).alias("temp_max_f"),
        F.when(depth <= 40, t - 8).alias("temp_min_f"), (F.col("swe_in") / 50).alias("precip_in"), (depth * 2).alias("cloud_percent"),
    )
    out = with_weather(_obs_station(spark, d), history, forecast, as_of, ["station_id"])
    cols = ["temp", "temp_high", "temp_low", "precip_7d", "cloud_cover", "wind_mph"]
    return rounded(out.select("obs_id", "weather_source", *cols), cols[:4])


# Result rows scattered around the requests: exact, within tolerance, or absent.
_RESULTS = """
, res AS (SELECT obs_id AS result_id, round(latitude + CASE obs_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.004 WHEN 2 THEN 0.02 ELSE -0.009 END, 4) AS latitude,
   round(longitude + CASE WHEN obs_id % 4 = 3 THEN 0.008 ELSE 0 END, 4) AS longitude, date, irg AS ndvi, CAST(obs_id % 3 AS INT) AS qa_flags FROM obs WHERE obs_id % 5 <> 0)
"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("obs_id") % 4
    dlat = F.when(k == 0, 0.0).when(k == 1, 0.004).when(k == 2, 0.02).otherwise(-0.009)
    return (
        view(spark, d, "obs")
        .filter("obs_id % 5 <> 0")
        .select(
            F.col("obs_id").alias("result_id"),
            F.round(F.col("latitude") + dlat, 4).alias("latitude"),
            F.round(F.col("longitude") + F.when(k == 3, 0.008).otherwise(0.0), 4).alias("longitude"),
            "date",
            F.col("irg").alias("ndvi"),
            (F.col("obs_id") % 3).cast("int").alias("qa_flags"),
        )
    )


@query(
    "result_match",
    "J9",
    cte("obs")
    + _RESULTS
    + """
, e AS (SELECT o.obs_id, arg_min((r.ndvi, r.qa_flags), r.result_id) AS b FROM obs o JOIN res r
   ON round(o.latitude, 4) = round(r.latitude, 4) AND round(o.longitude, 4) = round(r.longitude, 4) AND o.date = r.date GROUP BY 1),
l AS (SELECT o.obs_id, arg_min((r.ndvi, r.qa_flags), r.result_id) AS b FROM obs o JOIN res r
   ON o.date = r.date AND abs(r.latitude - o.latitude) <= 0.01 + 1e-12 AND abs(r.longitude - o.longitude) <= 0.01 + 1e-12
   WHERE o.obs_id NOT IN (SELECT obs_id FROM e) GROUP BY 1)
SELECT o.obs_id, coalesce(e.b, l.b)[1] AS ndvi, coalesce(e.b, l.b)[2] AS qa_flags,
  CASE WHEN e.b IS NOT NULL THEN 'exact' WHEN l.b IS NOT NULL THEN 'tolerance' END AS tier
FROM obs o LEFT JOIN e USING (obs_id) LEFT JOIN l USING (obs_id)
""",
)
def result_match(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import match_results

    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date")
    return match_results(o, _results(spark, d), "obs_id").select("obs_id", "ndvi", "qa_flags", "tier")


_RANGES = """
, req AS (SELECT obs_id, round(latitude, 1) AS lat2, round(longitude, 0) AS lon2, date AS start, CAST(date + CAST(obs_id % 10 AS INT) AS DATE) AS "end" FROM obs),
c AS (SELECT obs_id AS cache_id, round(latitude, 1) AS lat2, round(longitude, 0) AS lon2, CAST(date - CAST(obs_id % 60 AS INT) AS DATE) AS start,
   CAST(date + CAST(obs_id % 90 AS INT) AS DATE) AS "end" FROM obs WHERE obs_id % 3 = 0)
"""


@query(
    "containing_range",
    "J10",
    cte("obs")
    + _RANGES
    + """
, m AS (SELECT r.obs_id, arg_max((c.cache_id, c.start, c."end"), (c."end" - c.start, -c.cache_id)) AS b FROM req r JOIN c USING (lat2, lon2)
   WHERE c.start <= r.start AND c."end" >= r."end" GROUP BY 1)
SELECT obs_id, b[1] AS cache_id, b[2] AS cached_start, b[3] AS cached_end FROM req LEFT JOIN m USING (obs_id)
""",
)
def containing_range(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import containing_range as lookup_range

    k = F.col("obs_id")
    o = view(spark, d, "obs").select(
        "obs_id", "date", F.round("latitude", 1).alias("lat2"), F.round("longitude", 0).alias("lon2")
    )
    days = lambda m: (k % m).cast("int")
    req = o.select("obs_id", "lat2", "lon2", F.col("date").alias("start"), F.date_add("date", days(10)).alias("end"))
    cached = o.filter("obs_id % 3 = 0").select(
        F.col("obs_id").alias("cache_id"), "lat2", "lon2",
        F.date_sub("date", days(60)).alias("start"), F.date_add("date", days(90)).alias("end"),
    )
    out = lookup_range(req, cached, ["lat2", "lon2"], "obs_id")
    return out.select("obs_id", "cache_id", "cached_start", "cached_end")


@query(
    "cached_split",
    "J11",
    cte("obs")
    + """
, c AS (SELECT DISTINCT round(latitude, 2) AS la, round(longitude, 2) AS lo FROM obs WHERE obs_id % 7 = 0)
SELECT obs_id, EXISTS (SELECT 1 FROM c WHERE la = round(latitude, 2) AND lo = round(longitude, 2)) AS cached FROM obs
""",
)
def cached_split(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import split_cached

    o = view(spark, d, "obs").select("obs_id", F.round("latitude", 2).alias("la"), F.round("longitude", 2).alias("lo"))
    have, need = split_cached(o, o.filter("obs_id % 7 = 0"), ["la", "lo"])
    return have.select("obs_id", F.lit(True).alias("cached")).unionByName(need.select("obs_id", F.lit(False).alias("cached")))


_DONE = """
, done AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'tmean' WHEN 1 THEN 'ppt' ELSE 'tmax' END AS variable, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_suppkey % 5 = 0),
need AS (SELECT DISTINCT variable, CAST(date - k AS DATE) AS date FROM (SELECT DISTINCT date FROM obs), (SELECT unnest(range(8))::INT AS k), (SELECT unnest(['tmean','ppt','tmax']) AS variable))
"""


def _work(spark: SparkSession, d: str):
    from terrasift.operators.summaries import needed_dates
    from terrasift.sources.surrogates import table

    line = F.col("l_linenumber") % 3
    done = (
        table(spark, d, "lineitem")
        .filter("l_suppkey % 5 = 0")
        .select(
            F.when(line == 0, "tmean").when(line == 1, "ppt").otherwise("tmax").alias("variable"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
    )
    return needed_dates(view(spark, d, "obs")), ["tmean", "ppt", "tmax"], done


@query("missing_downloads", "J12 A18", cte("obs") + _DONE + "SELECT * FROM need EXCEPT SELECT * FROM done")
def missing_downloads(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import missing_work

    return missing_work(*_work(spark, d))


@query("available_downloads", "U5", cte("obs") + _DONE + "SELECT * FROM need INTERSECT SELECT * FROM done")
def available_downloads(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import available_work

    return available_work(*_work(spark, d))


@query(
    "steep_share_nearby",
    "J20",
    cte("raster_cells")
    + """
, x AS (SELECT min(cell_row) AS r0, max(cell_row) AS r1, min(cell_col) AS c0, max(cell_col) AS c1 FROM raster_cells),
n AS (SELECT a.cell_row, a.cell_col, count(*) FILTER (b.value > 7000 AND pow(b.cell_row - a.cell_row, 2) + pow(b.cell_col - a.cell_col, 2) <= 9) AS k
   FROM raster_cells a JOIN raster_cells b ON b.cell_row BETWEEN a.cell_row - 3 AND a.cell_row + 3 AND b.cell_col BETWEEN a.cell_col - 3 AND a.cell_col + 3 GROUP BY 1, 2)
SELECT cell_row, cell_col, round(k / ((least(cell_row + 3, r1) - greatest(cell_row - 3, r0) + 1) * (least(cell_col + 3, c1) - greatest(cell_col - 3, c0) + 1)) * 100, 6) AS share
FROM n, x
""",
)
def steep_share_nearby(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.gridlookup import focal_share

    return rounded(focal_share(view(spark, d, "raster_cells"), F.col("value") > 7000, 3), ["share"])


@query(
    "ndvi_updates",
    "J19 P5",
    cte("obs")
    + """
, o AS (SELECT obs_id, CASE WHEN obs_id % 3 = 0 THEN 0.5 ELSE ndvi END AS ndvi FROM obs),
u AS (SELECT obs_id, CASE WHEN obs_id % 7 = 0 THEN 1.5 ELSE 0.61 END AS new_value FROM obs WHERE obs_id % 2 = 0)
SELECT obs_id, coalesce(CASE WHEN coalesce(ndvi IN (0.3, 0.5, 0.55, 0.7), false) AND new_value BETWEEN -1 AND 1 THEN new_value::DOUBLE END, ndvi) AS ndvi
FROM o LEFT JOIN u USING (obs_id)
""",
)
def ndvi_updates(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.functions.vegetation import is_placeholder_ndvi
    from terrasift.operators.asof import update_flagged

    k = F.col("obs_id")
    o = view(spark, d, "obs").select("obs_id", F.when(k % 3 == 0, 0.5).otherwise(F.col("ndvi")).alias("ndvi"))
    u = o.filter(k % 2 == 0).select("obs_id", F.when(k % 7 == 0, 1.5).otherwise(0.61).alias("new_value"))
    return update_flagged(o, u, "obs_id", "ndvi", is_placeholder_ndvi(F.col("ndvi")), -1.0, 1.0)


@query(
    "station_date_series",
    "I5",
    cte("obs", "station_series")
    + _OBS_STATION
    + """
, q AS (SELECT DISTINCT station_id, CAST(date + k AS DATE) AS date FROM r, (SELECT unnest(range(5))::INT AS k)),
o AS (SELECT station_id, q.date, CAST(q.date + k AS DATE) AS day FROM q, (SELECT unnest(range(-7, 8))::INT AS k)),
m AS (SELECT o.station_id, o.date, arg_min((s.date, depth_in), (abs(s.date - o.date), s.date)) AS b FROM o JOIN station_series s
   ON s.station_id = o.station_id AND s.date = o.day GROUP BY 1, 2)
SELECT station_id, q.date, b[1] AS matched_date, b[2] AS depth_in FROM q LEFT JOIN m USING (station_id, date)
""",
)
def station_date_series(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.asof import expand_days, nearest_day

    r = _obs_station(spark, d).select("station_id", F.col("date").alias("start"), F.date_add("date", 4).alias("end"))
    q = expand_days(r, "start", "end").select("station_id", "date").distinct()
    out = nearest_day(q, view(spark, d, "station_series"), ["station_id"], ["depth_in"])
    return out.select("station_id", "date", F.col("matched.date").alias("matched_date"), F.col("matched.depth_in").alias("depth_in"))
