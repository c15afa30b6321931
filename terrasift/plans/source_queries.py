"""Ingestion operators on text, JSON and geometry derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.geo import line_length_km, wgs84_to_utm
from terrasift.operators import spatial
from terrasift.operators.features import STUDY_AREA
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources import feeds, presence, vector
from terrasift.sources.surrogates import cte, table, view

SERIES_ROWS = 250_000  # rows of the daily series dealt to one task, about


@query(
    "gps_fixes",
    "S1 P7",
    cte("fixes")
    + """
SELECT fix_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM fixes WHERE fix_id % 13 NOT IN (0, 1, 2)
""",
)
def gps_fixes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("fix_id") % 13
    raw = view(spark, d, "fixes").select(
        "fix_id",
        F.when(k == 0, "bad").when(k == 1, "95.5").otherwise(F.col("latitude").cast("string")).alias("Lat"),
        F.when(k == 2, None).otherwise(F.col("longitude").cast("string")).alias("Long"),
    )
    return rounded(presence.normalise_fixes(raw), ["latitude", "longitude"])


@query(
    "gps_fixes_utm",
    "S1 F10",
    cte("fixes") + "SELECT fix_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM fixes",
)
def gps_fixes_utm(spark: SparkSession, d: str) -> DataFrame:
    e, n = wgs84_to_utm(F.col("latitude"), F.col("longitude"), 12)
    raw = view(spark, d, "fixes").select("fix_id", e.alias("Easting"), n.alias("Northing"))
    out = presence.normalise_fixes(raw).select("fix_id", "latitude", "longitude")
    return rounded(out, ["latitude", "longitude"])


_VERTICES = """
, vx AS (SELECT route_id, k AS point_index, lon0 + k * dlon AS lon, lat0 + k * dlat * CASE WHEN k % 2 = 1 THEN 1 ELSE 0.5 END AS lat, n_points
   FROM route_ends, (SELECT unnest(range(4))::INT AS k) WHERE k < n_points)
"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "route_ends")
    vertex = lambda k: F.struct(
        (F.col("lon0") + k * F.col("dlon")).alias("lon"),
        (F.col("lat0") + k * F.col("dlat") * F.when(k % 2 == 1, 1.0).otherwise(0.5)).alias("lat"),
    )
    line = F.transform(F.sequence(F.lit(0), F.col("n_points") - 1), vertex)
    return r.select("route_id", F.array(line).alias("parts"))


@query(
    "route_points",
    "S2",
    cte("route_ends") + _VERTICES + "SELECT route_id, point_index, round(lat, 6) AS latitude, round(lon, 6) AS longitude FROM vx",
)
def route_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(presence.route_points(_routes(spark, d)), ["latitude", "longitude"])


@query(
    "route_resample",
    "S3",
    cte("route_ends")
    + _VERTICES
    + """
, sg AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, sqrt(pow(lead(lon) OVER w - lon, 2) + pow(lead(lat) OVER w - lat, 2)) AS len FROM vx
   WINDOW w AS (PARTITION BY route_id ORDER BY point_index)),
cu AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY point_index) - len AS c0, sum(len) OVER (PARTITION BY route_id) AS total FROM sg WHERE len IS NOT NULL),
s AS (SELECT cu.*, i AS sample_index, total * i / 9.0::DOUBLE AS pos FROM cu, (SELECT unnest(range(10))::INT AS i)),
p AS (SELECT *, row_number() OVER (PARTITION BY route_id, sample_index ORDER BY point_index DESC) AS rn FROM s WHERE c0 <= pos)
SELECT route_id, sample_index, round(pos, 6) AS distance_along_route, round(lat + (lat2 - lat) * (pos - c0) / len, 6) AS latitude,
  round(lon + (lon2 - lon) * (pos - c0) / len, 6) AS longitude FROM p WHERE rn = 1
""",
)
def route_resample(spark: SparkSession, d: str) -> DataFrame:
    out = presence.resample_routes(_routes(spark, d), 10).drop("part_index")
    return rounded(out, ["distance_along_route", "latitude", "longitude"])


@query(
    "route_attributes",
    "J18",
    cte("route_ends") + _VERTICES + "SELECT v.route_id, v.point_index, p.p_type AS herd FROM vx v JOIN part p ON p.p_partkey = v.route_id",
)
def route_attributes(spark: SparkSession, d: str) -> DataFrame:
    points = presence.route_points(_routes(spark, d)).select("route_id", "point_index")
    attributes = table(spark, d, "part").select(F.col("p_partkey").alias("route_id"), F.col("p_type").alias("herd"))
    return points.join(attributes, "route_id")


@query(
    "dataset_assembly",
    "S4 I2",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, 'north' AS dataset FROM orders
""",
)
def dataset_assembly(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, "not a date").when(k == 3, "").alias("firstdate"),
        F.when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "yyyy/MM/dd")).alias("lastdate"),
    )
    return presence.assemble_dataset(raw, "north").select("o_orderkey", "date", "dataset")


@query(
    "geojson_vertices",
    "S5 S6",
    cte("areas")
    + """
, v AS (SELECT area_id, min_lon, min_lat, max_lon, max_lat, CASE area_id % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry_type FROM areas)
SELECT area_id, geometry_type, CASE geometry_type WHEN 'Point' THEN 1 WHEN 'LineString' THEN 2 WHEN 'Polygon' THEN 4 ELSE 8 END AS n_vertices,
  round(min_lon, 4) AS first_lon, round(CASE geometry_type WHEN 'Point' THEN min_lat WHEN 'LineString' THEN max_lat WHEN 'Polygon' THEN min_lat ELSE min_lat END, 4) AS last_lat FROM v
""",
)
def geojson_vertices(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "areas")
    x0, y0, x1, y1 = (F.round(c, 4).cast("string") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    p = lambda x, y: F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    ring = F.concat(F.lit("[["), p(x0, y0), F.lit(","), p(x1, y0), F.lit(","), p(x1, y1), F.lit(","), p(x0, y0), F.lit("]]"))
    kind = F.element_at(
        F.array(*[F.lit(t) for t in ("Point", "LineString", "Polygon", "MultiPolygon")]), (F.col("area_id") % 4 + 1).cast("int")
    )
    text = (
        F.when(kind == "Point", p(x0, y0))
        .when(kind == "LineString", F.concat(F.lit("["), p(x0, y0), F.lit(","), p(x1, y1), F.lit("]")))
        .when(kind == "Polygon", ring)
        .otherwise(F.concat(F.lit("["), ring, F.lit(","), ring, F.lit("]")))
    )
    out = a.select("area_id", kind.alias("geometry_type"), text.alias("coordinates"))
    v = out.withColumn("v", vector.flat_vertices(F.col("geometry_type"), F.col("coordinates")))
    return v.select(
        "area_id",
        "geometry_type",
        F.size("v").alias("n_vertices"),
        F.element_at("v", 1)["lon"].alias("first_lon"),
        F.element_at("v", -1)["lat"].alias("last_lat"),
    )


@query(
    "station_series_json",
    "S8 U6",
    cte("station_series")
    + "SELECT 'S' || station_id AS station, date, CASE WHEN day(date) % 3 <> 1 THEN swe_in END AS swe_in, CASE WHEN day(date) % 3 <> 0 THEN depth_in END AS depth_in FROM station_series",
)
def station_series_json(spark: SparkSession, d: str) -> DataFrame:
    """One document per station and month, both elements with gaps on different days."""
    s = view(spark, d, "station_series")
    day = F.dayofmonth("date") % 3
    value = lambda keep, v: F.collect_list(
        F.when(keep, F.struct(F.col("date").cast("string").alias("date"), F.col(v).alias("value")))
    )
    # tasks follow the table's size, so that a task's memory doesn't
    rows = table(spark, d, "lineitem").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SERIES_ROWS))
    monthly = s.withColumn("m", F.trunc("date", "month")).repartition(parts, "station_id", "m")
    docs = monthly.groupBy("station_id", "m").agg(
        value(day != 1, "swe_in").alias("swe"), value(day != 0, "depth_in").alias("depth")
    )
    element = lambda code, v: F.struct(
        F.struct(F.lit(code).alias("elementCode")).alias("stationElement"), F.col(v).alias("values")
    )
    doc = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("S"), F.col("station_id").cast("string")).alias("stationTriplet"),
                F.array(element("WTEQ", "swe"), element("SNWD", "depth")).alias("data"),
            )
        )
    )
    return feeds.station_series(docs.select(doc.alias("json")), parts=parts).select("station", "date", "swe_in", "depth_in")


@query(
    "station_list_json",
    "S9",
    cte("stations")
    + "SELECT CAST(station_id AS VARCHAR) AS station_id, CASE WHEN station_id % 3 = 0 THEN station_id || ':WY:SNTL' ELSE 'T' || station_id END AS triplet, name, round(lat, 4) AS lat, round(lon, 4) AS lon, 'WY' AS state FROM stations WHERE station_id % 5 <> 0",
)
def station_list_json(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "stations")
    k = F.col("station_id")
    doc = F.to_json(
        F.array(
            F.struct(
                k.cast("string").alias("stationId"),
                F.col("name"),
                F.when(k % 5 != 0, F.round("lat", 4)).alias("latitude"),
                F.round("lon", 4).alias("longitude"),
                F.when(k % 3 != 0, F.concat(F.lit("T"), k.cast("string"))).alias("stationTriplet"),
            )
        )
    )
    return feeds.station_list(s.select(doc.alias("json"))).select("station_id", "triplet", "name", "lat", "lon", "state")


@query(
    "forecast_json",
    "S10",
    cte("station_series")
    + """
, n AS (SELECT *, row_number() OVER (PARTITION BY station_id, date_trunc('month', date) ORDER BY date) AS rn FROM station_series)
SELECT station_id, date, depth_in AS temp_max_f, CASE WHEN rn <= 3 THEN swe_in END AS temp_min_f FROM n
""",
)
def forecast_json(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "station_series")
    docs = s.groupBy("station_id", F.trunc("date", "month").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("date", "depth_in", "swe_in"))).alias("a")
    )
    doc = F.to_json(
        F.struct(
            F.struct(
                F.transform("a", lambda x: x["date"].cast("string")).alias("time"),
                F.transform("a", lambda x: x["depth_in"]).alias("temperature_2m_max"),
                F.slice(F.transform("a", lambda x: x["swe_in"]), 1, 3).alias("temperature_2m_min"),
            ).alias("daily")
        )
    )
    out = feeds.daily_forecast(docs.select("station_id", doc.alias("json")), keep=["station_id"])
    return out.select("station_id", "date", "temp_max_f", "temp_min_f")


@query(
    "ndvi_product_rows",
    "S11",
    cte("obs")
    + """
, r AS (SELECT obs_id, latitude, longitude, date, CASE obs_id % 6 WHEN 0 THEN -3000 WHEN 1 THEN 20000 WHEN 2 THEN 0.5 ELSE CAST(obs_id % 9000 AS DOUBLE) END AS raw FROM obs)
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, date, round(CASE WHEN raw > 1 THEN raw / 10000 ELSE raw END, 6) AS ndvi, CAST(obs_id % 4 AS INT) AS qa_flags
FROM r WHERE raw <> -3000 AND CASE WHEN raw > 1 THEN raw / 10000 ELSE raw END BETWEEN -1 AND 1
""",
)
def ndvi_product_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("obs_id") % 6
    raw = F.when(k == 0, -3000.0).when(k == 1, 20000.0).when(k == 2, 0.5).otherwise((F.col("obs_id") % 9000).cast("double"))
    product = view(spark, d, "obs").select(
        F.col("date").cast("string").alias("Date"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        (F.col("obs_id") % 4).alias("MOD13Q1_061__250m_16_days_VI_Quality"),
        raw.alias("MOD13Q1_061__250m_16_days_NDVI"),
    )
    return rounded(feeds.ndvi_results(product), ["latitude", "longitude", "ndvi"])


_HYDRO = """
, c AS (SELECT *, CASE ftype WHEN 460 THEN 'stream' WHEN 558 THEN 'canal' WHEN 336 THEN 'stream' WHEN 334 THEN 'stream' WHEN 390 THEN 'lake' WHEN 436 THEN 'reservoir' WHEN 388 THEN 'spring' END AS water_type FROM hydro),
k AS (SELECT feature_id, water_type, CAST(CASE water_type WHEN 'stream' THEN 0.7 WHEN 'canal' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS reliability, coalesce(gnis_name, gnis_name_alt) AS name, lat, lon FROM c WHERE water_type IS NOT NULL)
"""


def _water_layers(spark: SparkSession, d: str) -> list[DataFrame]:
    h = view(spark, d, "hydro")
    return [vector.classify_flowlines(h), vector.classify_waterbodies(h), vector.classify_springs(h)]


@query(
    "hydrography",
    "S13 S16",
    cte("hydro") + _HYDRO + "SELECT feature_id, water_type, reliability, name FROM k WHERE lat BETWEEN 41 AND 45 AND lon BETWEEN -111 AND -104",
)
def hydrography(spark: SparkSession, d: str) -> DataFrame:
    return vector.combine_water(_water_layers(spark, d), ["feature_id", "water_type", "reliability", "name"])


@query(
    "water_tiers",
    "A20",
    cte("hydro")
    + _HYDRO
    + "SELECT water_type, CASE WHEN reliability >= 0.9 THEN 'high' WHEN reliability >= 0.6 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM k GROUP BY 1, 2",
)
def water_tiers(spark: SparkSession, d: str) -> DataFrame:
    w = vector.combine_water(_water_layers(spark, d), ["water_type", "reliability"], bounds=None)
    return w.groupBy("water_type", spatial.reliability_tier(F.col("reliability")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_LEN = "2*6371*asin(sqrt(pow(sin(radians(lat2-lat1)/2),2) + cos(radians(lat1))*cos(radians(lat2))*pow(sin(radians(lon2-lon1)/2),2)))"
_ROADS = f"""
, r AS (SELECT road_id, fullname, CASE mtfcc WHEN 'S1100' THEN 'primary' WHEN 'S1200' THEN 'primary' WHEN 'S1400' THEN 'secondary' WHEN 'S1500' THEN 'tertiary' ELSE 'unclassified' END AS road_type,
  lon1, lat1, lon2, lat2, {_LEN} AS km FROM road_lines WHERE mtfcc <> 'S1830')
"""


def _road_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    return view(spark, d, "road_lines").select("road_id", "mtfcc", "fullname", F.array(v(1), v(2)).alias("vertices"))


@query("road_classes", "S14", cte("road_lines") + _ROADS + "SELECT road_id, fullname, road_type, round(km, 6) AS km FROM r WHERE lat1 BETWEEN 41 AND 45 AND lon1 BETWEEN -111 AND -104")
def road_classes(spark: SparkSession, d: str) -> DataFrame:
    r = vector.classify_roads(_road_vertices(spark, d), bounds=STUDY_AREA)
    return r.select("road_id", "fullname", "road_type", F.round(line_length_km(F.col("vertices")), 6).alias("km"))


@query(
    "road_profile",
    "S14 A20 F9",
    cte("road_lines")
    + _ROADS
    + "SELECT road_type, count(*) AS n, round(sum(km), 4) AS length_km, round(min(least(lon1, lon2)), 6) AS min_lon, round(min(least(lat1, lat2)), 6) AS min_lat, round(max(greatest(lon1, lon2)), 6) AS max_lon, round(max(greatest(lat1, lat2)), 6) AS max_lat FROM r GROUP BY ROLLUP (road_type)",
)
def road_profile(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.layer_profile(vector.classify_roads(_road_vertices(spark, d)), "road_type")
    return rounded(rounded(out, ["length_km"], 4), ["min_lon", "min_lat", "max_lon", "max_lat"])


@query(
    "trail_length",
    "S15",
    cte("road_lines")
    + f"SELECT count(*) AS n, round(sum({_LEN}), 4) AS length_km FROM road_lines WHERE (lat1 BETWEEN 41 AND 45 AND lon1 BETWEEN -111 AND -104) OR (lat2 BETWEEN 41 AND 45 AND lon2 BETWEEN -111 AND -104)",
)
def trail_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.total_length(vector.clip_lines(_road_vertices(spark, d))), ["length_km"], 4)


@query(
    "trail_ways_json",
    "S17",
    """
SELECT p_partkey AS osm_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'path' END AS highway, '' AS route, CAST(2 + p_partkey % 2 AS INT) AS n_vertices FROM part WHERE p_partkey % 4 <> 0
""",
)
def trail_ways_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = F.when(k % 4 == 0, 1).otherwise(2 + k % 2).cast("int")
    point = lambda i: F.struct((F.lit(43.0) + i / 100).alias("lat"), (F.lit(-107.0) + i / 100).alias("lon"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("name"), F.col("p_name"))).otherwise(
        F.create_map(F.lit("name"), F.col("p_name"), F.lit("highway"), F.lit("path"))
    )
    element = F.struct(
        F.lit("way").alias("type"), k.alias("id"), tags.alias("tags"), F.transform(F.sequence(F.lit(1), n), point).alias("geometry")
    )
    node = F.struct(
        F.lit("node").alias("type"), k.alias("id"), tags.alias("tags"), F.transform(F.sequence(F.lit(1), n), point).alias("geometry")
    )
    docs = table(spark, d, "part").select(F.to_json(F.struct(F.array(element, node).alias("elements"))).alias("json"))
    return vector.trail_ways(docs).select("osm_id", "name", "highway", "route", F.size("vertices").alias("n_vertices"))


def _off(q: int, a: int, b: int) -> str:
    """Distance of vertex ``q`` from the segment between vertices ``a`` and ``b``."""
    dx, dy, ex, ey = (f"(p[{i}].{c} - p[{a}].{c})" for i, c in ((b, "x"), (b, "y"), (q, "x"), (q, "y")))
    t = f"greatest(0, least(1, ({ex} * {dx} + {ey} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({ex} - {t} * {dx}, 2) + pow({ey} - {t} * {dy}, 2))"


# routes have two to four vertices, so the recursion can be written out
@query(
    "simplified_lines",
    "F13",
    cte("route_ends")
    + _VERTICES
    + f"""
, ln AS (SELECT route_id, list({{'x': lon, 'y': lat}} ORDER BY point_index) AS p FROM vx GROUP BY 1)
SELECT route_id, CAST(CASE len(p) WHEN 2 THEN 2 WHEN 3 THEN CASE WHEN {_off(2, 1, 3)} > 0.002 THEN 3 ELSE 2 END
  ELSE CASE WHEN greatest({_off(2, 1, 4)}, {_off(3, 1, 4)}) <= 0.002 THEN 2
    WHEN {_off(2, 1, 4)} >= {_off(3, 1, 4)} THEN CASE WHEN {_off(3, 2, 4)} > 0.002 THEN 4 ELSE 3 END
    ELSE CASE WHEN {_off(2, 1, 3)} > 0.002 THEN 4 ELSE 3 END END END AS INT) AS n_vertices FROM ln
""",
)
def simplified_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _routes(spark, d).select("route_id", F.col("parts")[0].alias("vertices"))
    out = vector.simplify_lines(lines, "route_id", 0.002)
    return out.select("route_id", F.size("vertices").alias("n_vertices"))
