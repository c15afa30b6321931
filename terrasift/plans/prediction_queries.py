"""Polygon-and-dates predictions over the area table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import scores, snow, vegetation
from terrasift.operators.gridlookup import sample_layers
from terrasift.plans import predict
from terrasift.plans.context import day_context, place_context
from terrasift.plans.layers import context_layers
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.join_queries import GRID
from terrasift.plans.registry import QUERIES, query
from terrasift.plans.scoring_queries import OPTIONS
from terrasift.plans.scoring_sql import FACTOR_CTES, LONG_CTES
from terrasift.sources.surrogates import cte, view
from terrasift.plans.spatial_queries import _areas

AS_OF = "2026-10-05"
SPACING = 500.0
RADIUS = 0.01
_STEP = "(500.0::DOUBLE / 111139)"

_GRID_SQL = (
    cte("areas", "raster_cells")
    + f"""
, req AS (SELECT area_id AS request_id, min_lat, max_lat, min_lon, max_lon, CAST(DATE '2026-08-20' + CAST(area_id * 10 AS INT) AS DATE) AS start FROM areas),
g AS (SELECT request_id, start, i.i, j.j, min_lat + i.i * {_STEP} AS latitude, min_lon + j.j * {_STEP} AS longitude FROM req,
   (SELECT unnest(range(1000)) AS i) i, (SELECT unnest(range(1000)) AS j) j
   WHERE i.i > 0 AND j.j > 0 AND i.i < ceil((max_lat - min_lat) / {_STEP}) AND j.j < ceil((max_lon - min_lon) / {_STEP})),
pd AS (SELECT g.*, CAST(start + k AS DATE) AS date FROM g, (SELECT unnest(range(3))::INT AS k)),
c AS (SELECT pd.*, v.value FROM pd LEFT JOIN raster_cells v ON v.cell_row = CAST(floor((latitude - 45) / -0.1) AS INT) AND v.cell_col = CAST(floor((longitude + 111) / 0.14) AS INT)),
x AS (SELECT request_id, CAST(request_id * 1000000 + i * 1000 + j AS BIGINT) AS obs_id, date, latitude, longitude, DATE '{AS_OF}' AS as_of,
  coalesce(value, 8500) AS elevation_ft, coalesce(value % 60, 15) AS slope_degrees, coalesce(value % 100, 30) AS canopy_cover_percent,
  greatest(CASE WHEN month(date) IN (12,1,2) THEN (coalesce(value, 8500)-6000)/100 WHEN month(date) IN (3,4) THEN (coalesce(value, 8500)-7000)/150
    WHEN month(date) IN (10,11) THEN (coalesce(value, 8500)-9000)/200 ELSE (coalesce(value, 8500)-10000)/100 END, 0::DOUBLE) AS snow_depth_inches,
  false AS snow_crust_detected, 0.5::DOUBLE AS water_distance_miles, 0.8::DOUBLE AS water_reliability, 2.0::DOUBLE AS road_distance_miles,
  1.5::DOUBLE AS trail_distance_miles, 35.0::DOUBLE AS security_habitat_percent, 0::DOUBLE AS precip_last_7_days_inches, 20::DOUBLE AS cloud_cover_percent,
  CAST(CASE WHEN month(date) IN (6,7,8) THEN 0.70 WHEN month(date) IN (9,10) THEN 0.55 WHEN month(date) IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END AS DOUBLE) AS ndvi,
  8::DOUBLE AS ndvi_age_days, CAST(CASE WHEN month(date) IN (4,5) THEN 0.01 WHEN month(date) IN (9,10) THEN -0.005 ELSE 0 END AS DOUBLE) AS irg,
  60::DOUBLE AS summer_integrated_ndvi, 2::DOUBLE AS wolves_per_1000_elk, 5::DOUBLE AS bear_activity_distance_miles, 0::DOUBLE AS wsi FROM c),
"""
)
_SCORED = _GRID_SQL + FACTOR_CTES + ", " + LONG_CTES
_AREA = "sq AS (SELECT request_id, (max_lon - min_lon) * (max_lat - min_lat) * (111139.0::DOUBLE * 111139) / 4046.86 / 640 AS sq FROM req)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    a = _areas(spark, d)
    start = F.date_add(F.lit("2026-08-20").cast("date"), (F.col("area_id") * 10).cast("int"))
    return a.select(F.col("area_id").alias("request_id"), "ring", start.alias("start"), F.date_add(start, 2).alias("end"))


def grid_context(spark: SparkSession, d: str):
    """Terrain from the cell table, the rest from the layer-absent defaults."""

    def add(points: DataFrame) -> DataFrame:
        v = F.col("value")
        layers = view(spark, d, "raster_cells").select(
            "cell_row",
            "cell_col",
            F.inline(
                F.array(
                    F.struct(F.lit("elevation_ft").alias("layer"), v.alias("value")),
                    F.struct(F.lit("slope_degrees").alias("layer"), (v % 60).alias("value")),
                    F.struct(F.lit("canopy_cover_percent").alias("layer"), (v % 100).alias("value")),
                )
            ),
        )
        p = sample_layers(points, layers, GRID, {"elevation_ft": 8500.0, "slope_degrees": 15.0, "canopy_cover_percent": 30.0})
        m = F.month("date")
        return p.withColumns(
            {
                "snow_depth_inches": snow.estimated_depth_inches(F.col("elevation_ft"), m),
                "water_distance_miles": F.lit(0.5),
                "water_reliability": F.lit(0.8),
                "road_distance_miles": F.lit(2.0),
                "trail_distance_miles": F.lit(1.5),
                "security_habitat_percent": F.lit(35.0),
                "cloud_cover_percent": F.lit(20.0),
                "ndvi": vegetation.ndvi_month_default(m),
                "ndvi_age_days": F.lit(8.0),
                "irg": vegetation.irg_month_default(m),
                "summer_integrated_ndvi": F.lit(60.0),
                "wolves_per_1000_elk": F.lit(2.0),
                "bear_activity_distance_miles": F.lit(5.0),
            }
        )

    return add


def scored_grid(spark: SparkSession, d: str) -> DataFrame:
    return predict.predict(
        requests(spark, d), grid_context(spark, d), spacing_m=SPACING, as_of=F.lit(AS_OF).cast("date"), options=OPTIONS
    )


@query(
    "prediction_grid",
    "F15 Q1 J21",
    _GRID_SQL.rstrip().rstrip(",") + " SELECT request_id, date, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM x",
)
def prediction_grid(spark: SparkSession, d: str) -> DataFrame:
    g = predict.with_dates(predict.grid_points(requests(spark, d), SPACING))
    return rounded(g.select("request_id", "date", "latitude", "longitude"), ["latitude", "longitude"])


@query(
    "prediction_scores",
    "Q2 H12 H15",
    _SCORED
    + "SELECT obs_id // 1000000 AS request_id, date, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(total_score, 6) AS total_score, limiting_factor, best_factor FROM totals",
)
def prediction_scores(spark: SparkSession, d: str, scored=None) -> DataFrame:
    out = (scored or scored_grid)(spark, d).select(
        F.col("request_id").cast("bigint").alias("request_id"), "date", "latitude", "longitude", "total_score", "limiting_factor", "best_factor"
    )
    return rounded(out, ["latitude", "longitude", "total_score"])


@query(
    "prediction_overall",
    "Q3 A21 F14",
    _SCORED
    + ", "
    + _AREA
    + """
, m AS (SELECT obs_id // 1000000 AS request_id, avg(total_score) AS s FROM totals GROUP BY 1)
SELECT CAST(m.request_id AS INT) AS request_id, round(s, 6) AS score, CASE WHEN s >= 75 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS confidence_level,
  CAST(floor((2 + s / 100 * 8) * sq) AS BIGINT) AS estimated_population, round(2 + s / 100 * 8, 6) AS population_density,
  CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 65 THEN 'good' WHEN s >= 50 THEN 'fair' ELSE 'poor' END AS habitat_quality FROM m JOIN sq USING (request_id)
""",
)
def prediction_overall(spark: SparkSession, d: str, scored=None) -> DataFrame:
    return rounded(predict.overall((scored or scored_grid)(spark, d), requests(spark, d)), ["score", "population_density"])


@query(
    "prediction_factors",
    "Q6 A22 F33",
    _SCORED
    + """
, f AS (SELECT obs_id // 1000000 AS request_id, factor, avg(score) AS score FROM long GROUP BY 1, 2),
st AS (SELECT request_id, factor, arg_min(status, (-n, status)) AS status FROM
   (SELECT obs_id // 1000000 AS request_id, factor, status, count(*) AS n FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT CAST(request_id AS INT) AS request_id, factor, round(score, 6) AS score, 1.0::DOUBLE AS weight, round(score, 6) AS contribution, status,
  array_to_string(list_transform(string_split(factor, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' is ' ||
  CASE status WHEN 'excellent' THEN 'optimal' WHEN 'good' THEN 'favorable' WHEN 'fair' THEN 'acceptable' ELSE 'limiting' END AS note
FROM f JOIN st USING (request_id, factor)
""",
)
def prediction_factors(spark: SparkSession, d: str, scored=None) -> DataFrame:
    out = predict.factor_breakdown((scored or scored_grid)(spark, d), scores.RULE_FACTORS)
    return rounded(out, ["score", "contribution"])


@query(
    "prediction_days",
    "Q8 Q9 W1",
    _SCORED
    + ", "
    + _AREA
    + """
, dd AS (SELECT obs_id // 1000000 AS request_id, date, avg(total_score) AS s FROM totals GROUP BY 1, 2),
fm AS (SELECT obs_id // 1000000 AS request_id, date, factor, ordinal, avg(score) AS m FROM long GROUP BY 1, 2, 3, 4),
fb AS (SELECT request_id, date, replace(arg_min(factor, (-m, ordinal)), '_', ' ') AS best, replace(arg_min(factor, (m, ordinal)), '_', ' ') AS worst FROM fm GROUP BY 1, 2)
SELECT CAST(request_id AS INT) AS request_id, date, round(s, 6) AS score, CAST(floor((2 + s / 100 * 8) * sq) AS BIGINT) AS estimated_population,
  CASE WHEN s >= 80 THEN 'Excellent conditions - ' || best || ' is optimal' WHEN s >= 65 THEN 'Good conditions overall'
    WHEN s >= 50 THEN 'Fair conditions - ' || worst || ' is limiting' ELSE 'Poor conditions - ' || worst || ' is suboptimal' END AS reason,
  CASE WHEN date - DATE '2026-10-05' <= 3 THEN 'high' WHEN date - DATE '2026-10-05' <= 7 THEN 'medium' ELSE 'low' END AS confidence,
  row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, date) AS rank
FROM dd JOIN sq USING (request_id) JOIN fb USING (request_id, date)
""",
)
def prediction_days(spark: SparkSession, d: str, scored=None) -> DataFrame:
    s = (scored or scored_grid)(spark, d).withColumn("total_score", F.round("total_score", 9))
    out = predict.day_ranking(s, requests(spark, d), scores.RULE_FACTORS, F.lit(AS_OF).cast("date"))
    return rounded(out, ["score"])


@query(
    "prediction_hotspots",
    "Q4 Q5 T2 R4",
    _SCORED.replace("WITH areas", "WITH RECURSIVE areas", 1)
    + """
, pt AS (SELECT t.obs_id // 1000000 AS request_id, t.latitude AS la, t.longitude AS lo, t.date AS d, round(t.total_score, 9) AS s, limiting_factor, best_factor,
    printf('%.0f', elevation_ft) || 'ft elevation' || CASE WHEN security_s > 7 THEN ', secure terrain' ELSE '' END || CASE WHEN vegetation_s > 7 THEN ', good forage' ELSE '' END AS description
   FROM totals t JOIN scored USING (obs_id, date)),
loc AS (SELECT request_id, la, lo, max(s) AS s, arg_max(d, (s, DATE '2100-01-01' - d)) AS d FROM pt GROUP BY 1, 2, 3),
walk AS (SELECT DISTINCT request_id, 0 AS k, CAST([] AS STRUCT(la DOUBLE, lo DOUBLE, d DATE)[]) AS seeds FROM loc
  UNION ALL SELECT w.request_id, any_value(w.k) + 1, list_append(any_value(w.seeds), arg_max({'la': l.la, 'lo': l.lo, 'd': l.d}, (l.s, DATE '2100-01-01' - l.d, -l.lo, -l.la)))
  FROM walk w JOIN loc l ON l.request_id = w.request_id
  WHERE w.k < 10 AND NOT coalesce(list_bool_or(list_transform(w.seeds, lambda t: sqrt(pow(t.la - l.la, 2) + pow(t.lo - l.lo, 2)) <= 0.01)), false) GROUP BY w.request_id),
fin AS (SELECT request_id, arg_max(seeds, k) AS seeds FROM walk GROUP BY 1),
sd AS (SELECT request_id, unnest(range(1, len(seeds) + 1)) AS rank, unnest(seeds) AS p FROM fin),
cl AS (SELECT sd.request_id, sd.rank, any_value(sd.p) AS p, count(*) AS n, avg(pt.s) AS m FROM sd JOIN pt ON pt.request_id = sd.request_id
   AND sqrt(pow(sd.p.la - pt.la, 2) + pow(sd.p.lo - pt.lo, 2)) <= 0.01 GROUP BY 1, 2),
el AS (SELECT *, (2 + m / 100 * 8) * (n * 0.25 / 640) AS e FROM cl)
SELECT CAST(el.request_id AS INT) AS request_id, CAST(rank AS INT) AS rank, 'hotspot_' || rank AS id, round(p.la, 6) AS latitude, round(p.lo, 6) AS longitude,
  CAST(n * 0.25 AS DOUBLE) AS area_acres, round(m, 6) AS score, greatest(1, CAST(floor(e * 0.8) AS BIGINT)) AS elk_min,
  greatest(1, CAST(floor(e * 0.8) AS BIGINT), CAST(floor(e * 1.2) AS BIGINT)) AS elk_max, greatest(1, CAST(floor(e) AS BIGINT)) AS elk_mean,
  pt.description, pt.limiting_factor, pt.best_factor
FROM el JOIN pt ON pt.request_id = el.request_id AND pt.la = p.la AND pt.lo = p.lo AND pt.d = p.d
""",
)
def prediction_hotspots(spark: SparkSession, d: str, scored=None) -> DataFrame:
    s = (scored or scored_grid)(spark, d).withColumn("total_score", F.round("total_score", 9))
    return rounded(predict.hotspots(s, radius=RADIUS), ["score", "latitude", "longitude"])


@query(
    "migration_status",
    "Q7",
    cte("obs")
    + """
, k AS (SELECT DISTINCT date, month(date) AS m, year(date) AS y FROM obs),
n AS (SELECT *, CASE WHEN m IN (6,7,8) THEN make_date(y, 10, 15) - date WHEN m IN (9,10) THEN greatest(0, make_date(y, 11, 1) - date)
   WHEN m = 12 THEN make_date(y, 4, 1) - date WHEN m IN (1,2,3) THEN make_date(y + 1, 4, 1) - date ELSE 0 END AS dd FROM k)
SELECT date, CASE WHEN m IN (6,7,8) THEN 'summer_range' WHEN m IN (9,10) THEN 'pre_migration' WHEN m = 11 THEN 'active_migration'
    WHEN m IN (12,1,2,3) THEN 'winter_range' ELSE 'spring_migration' END AS current_phase,
  CASE WHEN m IN (9,10) THEN '2026-11-01' END AS expected_migration_date, CASE WHEN dd > 0 THEN CAST(dd AS INT) END AS days_until_migration,
  'medium' AS confidence, CASE WHEN m = 11 THEN 'decreasing' WHEN m IN (4,5) THEN 'increasing' ELSE 'stable' END AS trend FROM n
""",
)
def migration_status(spark: SparkSession, d: str) -> DataFrame:
    days = view(spark, d, "obs").select("date").distinct()
    return days.select("date", predict.migration_status(F.col("date")).alias("s")).select("date", "s.*")


# the same reports with every layer looked up, on a wider grid; dated layers are moved into the years asked for
WIDE = 2000.0
LATER = 10227
_HAV = "round(2*6371*asin(sqrt(least(1, pow(sin(radians(f.lat - o.latitude)/2),2) + cos(radians(o.latitude))*cos(radians(f.lat))*pow(sin(radians(f.lon - o.longitude)/2),2)))), 6)"
_CLEAR = """arg_min((ndvi, cloud_cover, scene_date), (cloud_cover, scene_date, ndvi, scene_id)) AS sc FROM keys k JOIN sc_ s ON s.tile_id = k.tile_id
   AND cloud_cover < 50 AND ndvi IS NOT NULL AND s.scene_date >= k.date - 14 AND s.scene_date < k.date + 14 GROUP BY 1, 2"""
_LAYERED_SQL = (
    cte("areas", "raster_cells", "water_features", "hydro", "road_lines", "stations", "station_series", "scenes")
    + _GRID_SQL[_GRID_SQL.index("\n, req AS") : _GRID_SQL.index("\nc AS (")].replace(_STEP, f"({WIDE}::DOUBLE / 111139)")
    + f"""
o AS (SELECT request_id * 1000000 + i * 1000 + j AS pid, latitude, longitude FROM g),
ss AS (SELECT station_id, CAST(date + {LATER} AS DATE) AS date, depth_in, swe_in FROM station_series),
sc_ AS (SELECT * REPLACE (CAST(scene_date + {LATER} AS DATE) AS scene_date) FROM scenes),
w AS (SELECT pid, arg_min((km, water_type), (km, feature_id)) AS b FROM (SELECT pid, feature_id, water_type, {_HAV} AS km FROM o, water_features f WHERE f.lat BETWEEN o.latitude - 0.91 AND o.latitude + 0.91) GROUP BY 1),
hy AS (SELECT pid, min(km) AS trail_km, min(km) FILTER (ftype = 999) AS bear_km FROM (SELECT pid, ftype, {_HAV} AS km FROM o, hydro f WHERE f.lat BETWEEN o.latitude - 0.91 AND o.latitude + 0.91) GROUP BY 1),
rp AS (SELECT pid, (lon1 - longitude) * cos(radians(latitude)) * k AS ax, (lat1 - latitude) * k AS ay, (lon2 - longitude) * cos(radians(latitude)) * k AS bx, (lat2 - latitude) * k AS by_
   FROM o, road_lines, (SELECT 6371000.0::DOUBLE * pi() / 180.0 AS k) WHERE lat1 BETWEEN latitude - 0.95 AND latitude + 0.95),
rt AS (SELECT *, greatest(0, least(1, -(ax*(bx-ax) + ay*(by_-ay)) / (pow(bx-ax,2) + pow(by_-ay,2)))) AS t FROM rp),
rd AS (SELECT pid, min(round(sqrt(pow(ax + t*(bx-ax), 2) + pow(ay + t*(by_-ay), 2)) / 1000, 6)) AS road_km FROM rt GROUP BY 1),
near_st AS (SELECT pid, station_id FROM (SELECT pid, station_id, row_number() OVER (PARTITION BY pid ORDER BY has_data DESC, km, station_id) AS rn
   FROM (SELECT pid, station_id, has_data, {_HAV} AS km FROM o, stations f) WHERE km <= 100) WHERE rn = 1),
wo AS (SELECT pid, arg_min(pack_size / elk_count * 1000, area_id) AS wolves FROM o JOIN areas ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat GROUP BY 1),
spot AS (SELECT pd.*, request_id * 1000000 + i * 1000 + j AS pid, CAST(floor(latitude * 10) * 31 + floor(longitude * 10) AS BIGINT) % 100 AS tile_id, month(date) AS mo FROM pd),
sn AS (SELECT pid, p.date, arg_min((depth_in, swe_in), (abs(s.date - p.date), s.date)) AS b FROM spot p JOIN near_st USING (pid) JOIN ss s ON s.station_id = near_st.station_id AND s.date BETWEEN p.date - 7 AND p.date + 7 GROUP BY 1, 2),
keys AS (SELECT DISTINCT tile_id, CAST(date - b AS DATE) AS date FROM spot, (SELECT unnest([0, 21])::INT AS b)),
clr AS (SELECT k.tile_id, k.date, {_CLEAR}),
sday AS (SELECT tile_id, scene_date, arg_min(ndvi, (cloud_cover, ndvi)) AS ndvi FROM sc_ WHERE cloud_cover < 50 AND month(scene_date) BETWEEN 6 AND 9 AND ndvi BETWEEN -1 AND 1 GROUP BY 1, 2),
sk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, year(scene_date) ORDER BY scene_date) AS rn FROM sday),
su AS (SELECT tile_id, year(scene_date) AS y, sum(ndvi) AS summer FROM sk WHERE rn <= 8 GROUP BY 1, 2),
c AS (SELECT spot.*, v.value, CASE WHEN mo IN (12,1,2) THEN (coalesce(value, 8500)-6000)/100 WHEN mo IN (3,4) THEN (coalesce(value, 8500)-7000)/150
    WHEN mo IN (10,11) THEN (coalesce(value, 8500)-9000)/200 ELSE (coalesce(value, 8500)-10000)/100 END AS snow
   FROM spot LEFT JOIN raster_cells v ON v.cell_row = CAST(floor((latitude - 45) / -0.1) AS INT) AND v.cell_col = CAST(floor((longitude + 111) / 0.14) AS INT)),
x AS (SELECT c.request_id, CAST(c.pid AS BIGINT) AS obs_id, c.date, c.latitude, c.longitude, DATE '{AS_OF}' AS as_of,
  coalesce(value, 8500) AS elevation_ft, coalesce(value % 60, 15) AS slope_degrees, greatest(0, least(100, coalesce(value % 130, 30))) AS canopy_cover_percent,
  coalesce(sn.b[1], greatest(snow, 0))::DOUBLE AS snow_depth_inches, coalesce(sn.b[1] > 0 AND sn.b[2] / nullif(sn.b[1], 0) > 0.35, false) AS snow_crust_detected,
  CASE WHEN w.b[1] <= 100 THEN w.b[1] * 1000 / 1609.34 ELSE 10 END::DOUBLE AS water_distance_miles,
  CASE WHEN w.b IS NULL OR w.b[1] > 100 THEN 0.5 ELSE CASE w.b[2] WHEN 'spring' THEN 1.0 WHEN 'lake' THEN 1.0 WHEN 'pond' THEN 0.9 WHEN 'stream' THEN 0.7 WHEN 'creek' THEN 0.7 WHEN 'ephemeral' THEN 0.4 ELSE 0.7 END END::DOUBLE AS water_reliability,
  CASE WHEN road_km <= 100 THEN road_km * 1000 / 1609.34 ELSE 10 END::DOUBLE AS road_distance_miles, CASE WHEN trail_km <= 100 THEN trail_km * 1000 / 1609.34 ELSE 10 END::DOUBLE AS trail_distance_miles,
  coalesce(value % 101, 35)::DOUBLE AS security_habitat_percent, coalesce(wx.swe_in, 0)::DOUBLE AS precip_last_7_days_inches,
  coalesce(clr.sc[2], wx.depth_in, 20)::DOUBLE AS cloud_cover_percent,
  coalesce(clr.sc[1], CASE WHEN mo IN (6,7,8) THEN 0.70 WHEN mo IN (9,10) THEN 0.55 WHEN mo IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END)::DOUBLE AS ndvi,
  coalesce(abs(clr.sc[3] - c.date), 8)::DOUBLE AS ndvi_age_days,
  coalesce((clr.sc[1] - cp.sc[1]) / 21, CASE WHEN mo IN (4,5) THEN 0.01 WHEN mo IN (9,10) THEN -0.005 ELSE 0 END)::DOUBLE AS irg,
  coalesce(summer, 60)::DOUBLE AS summer_integrated_ndvi, coalesce(wolves, 0.5)::DOUBLE AS wolves_per_1000_elk,
  CASE WHEN bear_km <= 100 THEN bear_km * 1000 / 1609.34 ELSE 10 END::DOUBLE AS bear_activity_distance_miles, 0::DOUBLE AS wsi
  FROM c LEFT JOIN w USING (pid) LEFT JOIN hy USING (pid) LEFT JOIN rd USING (pid) LEFT JOIN wo USING (pid) LEFT JOIN sn ON sn.pid = c.pid AND sn.date = c.date
  LEFT JOIN clr ON clr.tile_id = c.tile_id AND clr.date = c.date LEFT JOIN clr cp ON cp.tile_id = c.tile_id AND cp.date = c.date - 21
  LEFT JOIN su ON su.tile_id = c.tile_id AND su.y = CASE WHEN mo >= 9 THEN year(c.date) ELSE year(c.date) - 1 END
  LEFT JOIN ss wx ON wx.station_id = c.tile_id AND wx.date = c.date),
"""
    + FACTOR_CTES
    + ", "
    + LONG_CTES
)
_NEEDED = [
    "elevation_ft", "slope_degrees", "canopy_cover_percent", "snow_depth_inches", "snow_crust_detected", "water_distance_miles", "water_reliability",
    "road_distance_miles", "trail_distance_miles", "security_habitat_percent", "precip_last_7_days_inches", "cloud_cover_percent", "ndvi",
    "ndvi_age_days", "irg", "summer_integrated_ndvi", "wolves_per_1000_elk", "bear_activity_distance_miles",
]


def scored_with_layers(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a grid whose context looks every layer up; what a place has is looked up once for all its days."""
    layers = context_layers(spark, d, LATER)
    tile = ((F.floor(F.col("latitude") * 10) * 31 + F.floor(F.col("longitude") * 10)) % 100).cast("int")

    def context(points: DataFrame) -> DataFrame:
        return day_context(points.withColumn("tile_id", tile), layers).select("request_id", "i", "j", "latitude", "longitude", "date", *_NEEDED)

    return predict.predict(
        requests(spark, d), context, spacing_m=WIDE, as_of=F.lit(AS_OF).cast("date"), options=OPTIONS, place=lambda p: place_context(p, layers)
    )


def _with_layers(base: Callable, name: str, ids: str) -> None:
    sql = QUERIES[name].sql.replace(_SCORED, _LAYERED_SQL)
    if name == "prediction_hotspots":
        sql = QUERIES[name].sql.replace(_SCORED.replace("WITH areas", "WITH RECURSIVE areas", 1), _LAYERED_SQL.replace("WITH areas", "WITH RECURSIVE areas", 1))

    def build(spark: SparkSession, d: str) -> DataFrame:
        return base(spark, d, scored_with_layers)

    build.__doc__ = f"``{name}`` with every layer looked up."
    query(f"{name}_layers", ids, sql)(build)


for _base, _ids in ((prediction_scores, "Q2"), (prediction_overall, "Q3 A21"), (prediction_factors, "Q6 A22"), (prediction_days, "Q8 Q9"), (prediction_hotspots, "Q4 Q5 T2")):
    _with_layers(_base, _base.__name__, _ids)
