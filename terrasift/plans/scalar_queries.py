"""Row-wise feature expressions over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import geo, lunar, rng, snow, temporal, units, vegetation
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view


def r6(c):
    return F.round(c, 6)


@query(
    "calendar_features",
    "F1 F2 F3 F20 F22",
    cte("obs")
    + """
SELECT obs_id,
  CASE WHEN month(date) IN (12,1,2) THEN 'wi' WHEN month(date) IN (3,4,5) THEN 'sp'
       WHEN month(date) IN (6,7,8) THEN 'su' ELSE 'fa' END AS season_code,
  CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'spring'
       WHEN month(date) IN (6,7,8) THEN 'summer' ELSE 'fall' END AS season,
  day(last_day(date)) AS days_in_month,
  year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year,
  round(sin(2*pi()*dayofyear(date)/365.25), 6) AS doy_sin,
  round(cos(2*pi()*dayofyear(date)/365.25), 6) AS doy_cos,
  CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END AS summer_year,
  CASE WHEN month(date) >= 9 THEN dayofyear(date) - 243 END AS days_since_rut_start
FROM obs
""",
)
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    date = F.col("date")
    month = F.month(date)
    doy = F.dayofyear(date)
    s, c = temporal.day_of_year_cyclic(doy)
    return view(spark, d, "obs").select(
        "obs_id",
        temporal.season_code(month).alias("season_code"),
        temporal.season_name(month).alias("season"),
        temporal.days_in_month(F.year(date), month).alias("days_in_month"),
        F.year(date).alias("year"),
        month.alias("month"),
        doy.alias("day_of_year"),
        r6(s).alias("doy_sin"),
        r6(c).alias("doy_cos"),
        temporal.summer_year(date).alias("summer_year"),
        temporal.days_since_rut_start(month, doy).alias("days_since_rut_start"),
    )


@query(
    "cyclic_date_rebuild",
    "F4 F5 F6",
    cte("obs")
    + """
, a AS (
  SELECT obs_id, year(date) AS y, month(date) AS m, dayofyear(date) AS doy, obs_id % 3 AS kind,
    -- every fifth row claims the following month, so the month rule must win
    CASE WHEN obs_id % 5 = 0 THEN month(date) % 12 + 1 ELSE month(date) END AS claimed
  FROM obs),
b AS (
  SELECT *, make_date(y, 1, 1) + CAST(doy - 1 AS INT) AS direct,
    make_date(y, 1, 1) + CAST(greatest(1, least(366, round((atan2(sin(2*pi()*doy/365.25), cos(2*pi()*doy/365.25))
      + CASE WHEN sin(2*pi()*doy/365.25) < 0 THEN 2*pi() ELSE 0 END) * 365.25 / (2*pi())))) - 1 AS INT) AS cand,
    make_date(y, claimed, CAST(floor(day(last_day(make_date(y, claimed, 1))) / 2) AS BIGINT)) AS mid
  FROM a)
SELECT obs_id,
  CASE WHEN month(cand) = claimed THEN cand ELSE mid END AS from_cyclic,
  CASE WHEN month(cand) = claimed THEN cand ELSE make_date(y, claimed, 15) END AS from_cyclic_day15,
  CASE kind WHEN 0 THEN direct WHEN 1 THEN (CASE WHEN month(cand) = claimed THEN cand ELSE mid END) ELSE mid END AS rebuilt,
  round(sin(2*pi()*(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], m) + 15)/365.25), 6) AS month_sin,
  round(cos(2*pi()*(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], m) + 15)/365.25), 6) AS month_cos
FROM b
""",
)
def cyclic_date_rebuild(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(
        "obs_id",
        F.year("date").alias("y"),
        F.month("date").alias("m"),
        F.dayofyear("date").alias("doy"),
        (F.col("obs_id") % 3).alias("kind"),
        F.when(F.col("obs_id") % 5 == 0, F.month("date") % 12 + 1).otherwise(F.month("date")).cast("int").alias("claimed"),
    )
    s, c = temporal.day_of_year_cyclic(F.col("doy"))
    o = o.withColumns({"s": s, "c": c})
    y, claimed = F.col("y"), F.col("claimed")
    ms, mc = temporal.encode_month_day(F.col("m"))
    return o.select(
        "obs_id",
        temporal.date_from_cyclic(y, claimed, F.col("s"), F.col("c")).alias("from_cyclic"),
        temporal.date_from_cyclic(y, claimed, F.col("s"), F.col("c"), 15).alias("from_cyclic_day15"),
        temporal.rebuild_date(
            y,
            claimed,
            F.when(F.col("kind") == 0, F.col("doy")),
            F.when(F.col("kind") == 1, F.col("s")),
            F.when(F.col("kind") == 1, F.col("c")),
        ).alias("rebuilt"),
        r6(ms).alias("month_sin"),
        r6(mc).alias("month_cos"),
    )


@query(
    "date_shifts",
    "F7 F8",
    cte("obs")
    + """
SELECT obs_id, CAST(date + INTERVAL 6 MONTH AS DATE) AS plus_six_months,
  CAST(date_trunc('quarter', date) AS DATE) AS quarter_first,
  last_day(CAST(date_trunc('quarter', date + CAST(obs_id % 200 AS INT)) + INTERVAL 2 MONTH AS DATE)) AS quarter_last
FROM obs
""",
)
def date_shifts(spark: SparkSession, d: str) -> DataFrame:
    end = F.date_add("date", (F.col("obs_id") % 200).cast("int"))
    first, last = temporal.quarter_range(F.col("date"), end)
    return view(spark, d, "obs").select(
        "obs_id",
        temporal.shift_months(F.col("date"), 6).alias("plus_six_months"),
        first.alias("quarter_first"),
        last.alias("quarter_last"),
    )


@query(
    "rut_features",
    "F21 F22 F23",
    cte("obs")
    + """
, a AS (SELECT *, month(date) AS m, day(date) AS dd, dayofyear(date) AS doy FROM obs),
b AS (SELECT *, CASE WHEN m=9 AND dd<15 THEN 'pre_rut' WHEN m=9 THEN 'peak_rut' WHEN m=10 AND dd<10 THEN 'peak_rut'
       WHEN m=10 THEN 'post_rut' END AS rut_phase,
       CASE WHEN m>=9 THEN doy-243 END AS since FROM a),
c AS (SELECT *, CASE rut_phase WHEN 'pre_rut' THEN 1 WHEN 'peak_rut' THEN 2 WHEN 'post_rut' THEN 3 ELSE 0 END AS code FROM b)
SELECT obs_id, coalesce(rut_phase, 'none') AS rut_phase, since AS days_since_rut_start,
  CAST(since * temperature_f AS DOUBLE) AS rut_days_x_temperature,
  CAST(since * elevation_ft AS DOUBLE) AS rut_days_x_elevation,
  round(since * water_distance_miles, 6) AS rut_days_x_water_distance,
  CAST(code * elevation_ft AS DOUBLE) AS rut_phase_x_elevation, code * m AS rut_phase_x_month
FROM c
""",
)
def rut_features(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.features import with_rut_features, with_rut_interactions

    out = with_rut_interactions(with_rut_features(view(spark, d, "obs")))
    return out.select(
        "obs_id",
        "rut_phase",
        "days_since_rut_start",
        "rut_days_x_temperature",
        "rut_days_x_elevation",
        r6(F.col("rut_days_x_water_distance")).alias("rut_days_x_water_distance"),
        "rut_phase_x_elevation",
        "rut_phase_x_month",
    )


@query(
    "unit_conversions",
    "F16",
    cte("obs")
    + """
SELECT obs_id, round(temperature_f * 9 / 5 + 32, 6) AS c_to_f, round(precip_last_7_days_inches / 25.4, 6) AS mm_to_in,
  round(elevation_ft / 1609.34, 6) AS m_to_mi, round(elevation_ft * 3.28084, 4) AS m_to_ft,
  round(CASE WHEN elevation_ft - 4000 < 500 THEN elevation_ft - 4000 ELSE (elevation_ft - 4000) * 3.28084 END, 4) AS guessed_ft
FROM obs
""",
)
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").select(
        "obs_id",
        r6(units.celsius_to_fahrenheit(F.col("temperature_f"))).alias("c_to_f"),
        r6(units.mm_to_inches(F.col("precip_last_7_days_inches"))).alias("mm_to_in"),
        r6(units.metres_to_miles(F.col("elevation_ft"))).alias("m_to_mi"),
        F.round(units.metres_to_feet(F.col("elevation_ft")), 4).alias("m_to_ft"),
        F.round(units.elevation_to_feet(F.col("elevation_ft") - 4000, "guess"), 4).alias("guessed_ft"),
    )


@query(
    "snow_from_elevation",
    "F17 F18",
    cte("obs")
    + """
, a AS (SELECT *, greatest(CASE WHEN month(date) IN (12,1,2) THEN (elevation_ft-6000)/100
   WHEN month(date) IN (3,4) THEN (elevation_ft-7000)/150 WHEN month(date) IN (10,11) THEN (elevation_ft-9000)/200
   ELSE (elevation_ft-10000)/100 END, CAST(0 AS DOUBLE)) AS est,
   CASE WHEN obs_id % 4 = 0 THEN NULL ELSE snow_depth_inches END AS measured FROM obs),
b AS (SELECT *, coalesce(measured, snow_water_equiv_inches / 0.25) AS depth FROM a)
SELECT obs_id, round(est, 6) AS estimated_depth, round(est * 0.25, 6) AS estimated_swe,
  round(depth, 6) AS depth, coalesce(depth > 0 AND snow_water_equiv_inches / nullif(depth, 0) > 0.35, false) AS crust
FROM b
""",
)
def snow_from_elevation(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs")
    est = snow.estimated_depth_inches(F.col("elevation_ft"), F.month("date"))
    measured = F.when(F.col("obs_id") % 4 != 0, F.col("snow_depth_inches"))
    swe = F.col("snow_water_equiv_inches")
    depth = snow.depth_or_from_swe(measured, swe)
    return o.select(
        "obs_id",
        r6(est).alias("estimated_depth"),
        r6(snow.estimated_swe_inches(est)).alias("estimated_swe"),
        r6(depth).alias("depth"),
        snow.crust_detected(depth, swe).alias("crust"),
    )


@query(
    "vegetation_defaults",
    "F19 P5 P14 J7",
    cte("obs")
    + """
, a AS (SELECT *, CASE obs_id % 7 WHEN 0 THEN 0.3 WHEN 1 THEN 0.55 ELSE ndvi END AS v,
   CASE WHEN obs_id % 9 = 0 THEN 60.005 ELSE summer_integrated_ndvi END AS s,
   CASE WHEN obs_id % 13 = 0 THEN NULL ELSE land_cover_code END AS code FROM obs)
SELECT obs_id,
  CAST(CASE WHEN month(date) IN (6,7,8) THEN 0.70 WHEN month(date) IN (9,10) THEN 0.55
       WHEN month(date) IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END AS DOUBLE) AS ndvi_default,
  coalesce(v IN (0.3, 0.5, 0.55, 0.7), false) AS ndvi_placeholder,
  coalesce(abs(s - 60) < 0.01, false) AS summer_placeholder,
  CASE WHEN code IS NULL THEN 'outside_bounds' WHEN code=41 THEN 'deciduous_forest' WHEN code=42 THEN 'evergreen_forest'
    WHEN code=43 THEN 'mixed_forest' WHEN code=52 THEN 'shrub' WHEN code=71 THEN 'grassland' WHEN code=81 THEN 'pasture'
    WHEN code=90 THEN 'wetland' WHEN code=95 THEN 'emergent_wetland' ELSE 'unknown' END AS land_cover_type,
  CASE code WHEN 41 THEN 'Deciduous Forest' WHEN 42 THEN 'Evergreen Forest' WHEN 43 THEN 'Mixed Forest'
    WHEN 52 THEN 'Shrub/Scrub' WHEN 71 THEN 'Grassland/Herbaceous' WHEN 81 THEN 'Pasture/Hay' WHEN 90 THEN 'Woody Wetlands'
    WHEN 95 THEN 'Emergent Herbaceous Wetlands' WHEN 11 THEN 'Open Water' ELSE 'Unknown' END AS nlcd_class,
  CASE WHEN date < DATE '2013-02-11' THEN 'landsat5' ELSE 'landsat8' END AS sensor
FROM a
""",
)
def vegetation_defaults(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.scenes import sensor_for_date

    k = F.col("obs_id")
    v = F.when(k % 7 == 0, 0.3).when(k % 7 == 1, 0.55).otherwise(F.col("ndvi"))
    s = F.when(k % 9 == 0, 60.005).otherwise(F.col("summer_integrated_ndvi"))
    code = F.when(k % 13 != 0, F.col("land_cover_code"))
    return view(spark, d, "obs").select(
        "obs_id",
        vegetation.ndvi_month_default(F.month("date")).alias("ndvi_default"),
        vegetation.is_placeholder_ndvi(v).alias("ndvi_placeholder"),
        vegetation.is_placeholder_summer_ndvi(s).alias("summer_placeholder"),
        vegetation.land_cover_type(code).alias("land_cover_type"),
        vegetation.nlcd_class(code).alias("nlcd_class"),
        sensor_for_date(F.col("date")).alias("sensor"),
    )


@query(
    "moon_night_features",
    "F27 F29 F30 F31",
    cte("obs")
    + """
, k AS (SELECT DISTINCT date, cloud_cover_percent FROM obs),
h AS (SELECT k.*, hh.h, CASE WHEN hh.h >= 12 THEN date ELSE CAST(date + INTERVAL 1 DAY AS DATE) END AS day
      FROM k, (SELECT unnest([20,21,22,23,0,1,2,3,4,5]) AS h) hh),
p AS (SELECT *, (1 - cos((((datediff('day', DATE '2024-01-11', day) % 29.53059::DOUBLE) + 29.53059::DOUBLE) % 29.53059::DOUBLE)
        / 29.53059 * 2 * pi())) / 2 AS phase FROM h),
a AS (SELECT *, 45 * phase - 10 AS alt FROM p),
s AS (SELECT *, sin(radians(least(alt, 90))) AS sa, greatest(alt, 0) AS up FROM a),
e AS (SELECT *, CASE WHEN alt <= 0 THEN 0 ELSE least(greatest(phase * sa
        * exp(-0.1 * least(1 / (sa + 0.50572 * pow(up + 6.07995, -1.6364)), 10)), 0), 1) END AS eff FROM s),
n AS (SELECT date, cloud_cover_percent, avg(alt) AS alt_mean, avg(eff) AS eff_mean,
        count(*) FILTER (alt > 0) AS visible, max(alt) FILTER (h = 0) AS alt_mid, max(eff) FILTER (h = 0) AS eff_mid,
        avg(eff * exp(-2.5 * cloud_cover_percent / 100)) AS cloud_mean,
        max(phase) FILTER (h = 20) AS phase0, max(eff) FILTER (h = 20) * exp(-2.5 * cloud_cover_percent / 100) AS cloud_now
      FROM e GROUP BY date, cloud_cover_percent)
SELECT obs_id, round(phase0, 6) AS moon_phase, round(alt_mid, 6) AS moon_altitude_midnight, round(alt_mean, 6) AS moon_altitude_mean,
  visible AS moon_visible_hours, round(eff_mid, 6) AS effective_illumination_midnight, round(eff_mean, 6) AS effective_illumination_mean,
  round(cloud_now, 6) AS cloud_adjusted_illumination, round(cloud_mean, 6) AS cloud_adjusted_illumination_mean
FROM obs JOIN n USING (date, cloud_cover_percent)
""",
)
def moon_night_features(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date", "cloud_cover_percent")
    out = lunar.with_night_features(
        o, F.col("latitude"), F.col("longitude"), F.col("date"), F.col("cloud_cover_percent"), ephemeris=False
    ).drop("latitude", "longitude", "date", "cloud_cover_percent")
    return out.select(
        "obs_id", "moon_visible_hours", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("obs_id", "moon_visible_hours")]
    )


_SQL_MOON_POSITION = """
, t AS (SELECT obs_id, latitude, longitude, date, datediff('day', DATE '2000-01-01', date) - 0.5::DOUBLE AS d FROM obs),
q AS (SELECT *, radians((134.963 + 13.064993*d) % 360) AS an, radians((93.272 + 13.229350*d) % 360) AS nd,
   radians((297.850 + 12.190749*d) % 360) AS el, radians((357.529 + 0.985600*d) % 360) AS sn,
   (218.316 + 13.176396*d) % 360 AS ml, radians(23.4397::DOUBLE) AS tilt FROM t),
l AS (SELECT *, radians(ml + 6.289*sin(an) + 1.274*sin(2*el-an) + 0.658*sin(2*el) + 0.214*sin(2*an) - 0.186*sin(sn)) AS lo,
   radians(5.128*sin(nd) + 0.281*sin(an+nd) + 0.278*sin(an-nd)) AS la FROM q),
g AS (SELECT *, atan2(sin(lo)*cos(tilt) - tan(la)*sin(tilt), cos(lo)) AS ra,
   asin(sin(la)*cos(tilt) + cos(la)*sin(tilt)*sin(lo)) AS de FROM l),
h AS (SELECT *, radians((((280.46062 + 360.98564737*d + longitude) % 360) + 360) % 360) - ra AS ha, radians(latitude) AS phi FROM g),
r AS (SELECT *, asin(sin(phi)*sin(de) + cos(phi)*cos(de)*cos(ha)) AS alt,
   atan2(sin(ha), cos(ha)*sin(phi) - tan(de)*cos(phi)) AS az FROM h)
"""


@query(
    "moon_position",
    "F28 J25",
    cte("obs")
    + _SQL_MOON_POSITION.replace("(134.963 + 13.064993*d) % 360", "(((134.963 + 13.064993*d) % 360) + 360) % 360")
    .replace("(93.272 + 13.229350*d) % 360", "(((93.272 + 13.229350*d) % 360) + 360) % 360")
    .replace("(297.850 + 12.190749*d) % 360", "(((297.850 + 12.190749*d) % 360) + 360) % 360")
    .replace("(357.529 + 0.985600*d) % 360", "(((357.529 + 0.985600*d) % 360) + 360) % 360")
    + """
SELECT obs_id, round(degrees(alt - radians(0.9507::DOUBLE)*cos(alt)), 4) AS moon_altitude,
  round((degrees(az) + 180) % 360, 3) AS moon_azimuth FROM r
""",
)
def moon_position(spark: SparkSession, d: str) -> DataFrame:
    alt, az = lunar.moon_position(F.col("latitude"), F.col("longitude"), F.col("date"), F.lit(0.0))
    return view(spark, d, "obs").select(
        "obs_id", F.round(alt, 4).alias("moon_altitude"), F.round(az, 3).alias("moon_azimuth")
    )


@query(
    "hash_keys_and_draws",
    "F32 W7 R2",
    cte("obs")
    + """
SELECT obs_id,
  sha256(printf('%.4f', latitude) || '|' || printf('%.4f', longitude) || '|' || CAST(date AS VARCHAR)) AS cell_key,
  round(CAST(('0x' || substr(md5('42|shuffle|' || obs_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE, 9) AS draw
FROM obs
""",
)
def hash_keys_and_draws(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.keys import request_key

    return view(spark, d, "obs").select(
        "obs_id",
        request_key(F.col("latitude"), F.col("longitude"), F.col("date")).alias("cell_key"),
        F.round(rng.hash_uniform(42, "shuffle", F.col("obs_id")), 9).alias("draw"),
    )


@query(
    "name_formatting",
    "F33",
    """
SELECT p_partkey,
  regexp_replace(regexp_replace(p_brand, '^combined_', ''), '_(presence_absence|test)$', '') AS dataset_name,
  p_name || ', ' || p_type AS description FROM part
""",
)
def name_formatting(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators.keys import dataset_from_file
    from terrasift.sources.surrogates import table

    return table(spark, d, "part").select(
        "p_partkey",
        dataset_from_file(F.col("p_brand")).alias("dataset_name"),
        F.concat_ws(", ", "p_name", "p_type").alias("description"),
    )


@query(
    "utm_round_trip",
    "F10",
    cte("obs")
    + """
, c AS (SELECT 6378137.0::DOUBLE AS a, (1/298.257223563::DOUBLE)/(2 - 1/298.257223563::DOUBLE) AS n),
p AS (SELECT obs_id, latitude, longitude, radians(latitude) AS phi, radians(longitude + 111) AS lam, n,
   a/(1+n)*(1 + n*n/4 + n*n*n*n/64) AS rr, 2*sqrt(n)/(1+n) AS e FROM obs, c),
q AS (SELECT *, sinh(atanh(sin(phi)) - e*atanh(e*sin(phi))) AS t FROM p),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS et,
   n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM q)
SELECT obs_id,
  round(500000 + 0.9996*rr*(et + a1*cos(2*xi)*sinh(2*et) + a2*cos(4*xi)*sinh(4*et) + a3*cos(6*xi)*sinh(6*et)), 3) AS easting,
  round(0.9996*rr*(xi + a1*sin(2*xi)*cosh(2*et) + a2*sin(4*xi)*cosh(4*et) + a3*sin(6*xi)*cosh(6*et)), 3) AS northing,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM x
""",
)
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e, n = geo.wgs84_to_utm(F.col("latitude"), F.col("longitude"), 12)
    out = view(spark, d, "obs").select("obs_id", e.alias("e"), n.alias("n"))
    lat, lon = geo.utm_to_wgs84(F.col("e"), F.col("n"), 12)
    return out.select(
        "obs_id",
        F.round("e", 3).alias("easting"),
        F.round("n", 3).alias("northing"),
        r6(lat).alias("latitude"),
        r6(lon).alias("longitude"),
    )
