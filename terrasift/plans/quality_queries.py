"""Quality and readiness reports over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import quality
from terrasift.plans.aggregate_queries import NUMERIC, rounded, union_all
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view

_MARKS = {
    "elevation_ft": "elevation_ft = 8500", "water_distance_miles": "water_distance_miles = 0.5", "canopy_cover_percent": "canopy_cover_percent = 30",
    "land_cover_code": "land_cover_code = 0", "temperature_f": "abs(temperature_f - 45) < 0.1", "precip_last_7_days_inches": "abs(precip_last_7_days_inches) < 0.01",
    "ndvi": "abs(ndvi - 0.3) < 0.01 OR abs(ndvi - 0.5) < 0.01", "ndvi_age_days": "ndvi_age_days = 8", "irg": "abs(irg) < 0.01",
    "summer_integrated_ndvi": "summer_integrated_ndvi = 0",
}


@query(
    "placeholder_report",
    "D1",
    cte("obs")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({t}) AS n_placeholder, round(count(*) FILTER ({t}) / count(*) * 100, 6) AS pct FROM obs"
        for c, t in _MARKS.items()
    ),
)
def placeholder_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.placeholder_report(view(spark, d, "obs")), ["pct"])


@query(
    "missing_expectation",
    "D2",
    cte("obs")
    + """
SELECT 'snow_station_name' AS feature, count(*) FILTER (snow_station_name IS NULL AND snow_data_source = 'station') AS unexpected,
  count(*) FILTER (snow_station_name IS NULL AND snow_data_source <> 'station') AS expected FROM obs
UNION ALL SELECT 'ndvi', count(*) FILTER (ndvi IS NULL), 0 FROM obs
""",
)
def missing_expectation(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_expectation(view(spark, d, "obs"), ["snow_station_name", "ndvi"], real="station")


@query(
    "range_violations",
    "D3",
    cte("obs")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above FROM obs"
        for c, (lo, hi) in quality.EXPECTED_RANGES.items()
        if not c.startswith(("moon", "effective", "cloud_adj"))
    ),
)
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.range_violations(view(spark, d, "obs"))


@query(
    "iqr_outliers",
    "D4",
    cte("obs")
    + ", x AS (SELECT *, CASE WHEN obs_id % 97 = 0 THEN temperature_f * 10 ELSE temperature_f END AS t FROM obs), q AS ("
    + union_all(
        "SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x", ["t", "ndvi", "snow_depth_inches"]
    )
    + """),
f AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q), v AS ("""
    + union_all("SELECT '{c}' AS feature, {c} AS v FROM x", ["t", "ndvi", "snow_depth_inches"])
    + """)
SELECT f.feature, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper, count(*) FILTER (v < lower OR v > upper) AS n_outliers,
  count(*) FILTER (v < lower OR v > upper) > count(*) * 0.01 AS above_1_pct FROM f JOIN v USING (feature) GROUP BY f.feature
""",
)
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn(
        "t", F.when(F.col("obs_id") % 97 == 0, F.col("temperature_f") * 10).otherwise(F.col("temperature_f"))
    )
    return rounded(quality.iqr_outliers(o, ["t", "ndvi", "snow_depth_inches"]), ["lower", "upper"])


@query(
    "z_outliers",
    "D5 W8",
    cte("obs")
    + """
, x AS (SELECT obs_id, CASE WHEN obs_id % 97 = 0 THEN temperature_f * 10 ELSE temperature_f END AS t, pow(snow_depth_inches / 10, 4) AS s FROM obs),
m AS (SELECT avg(t) AS mt, stddev_pop(t) AS st, avg(s) AS ms, stddev_pop(s) AS ss FROM x)
SELECT obs_id, 't' AS feature, round(t, 6) AS value, round((t - mt) / st, 6) AS z FROM x, m WHERE abs((t - mt) / st) > 3
UNION ALL SELECT obs_id, 's', round(s, 6), round((s - ms) / ss, 6) FROM x, m WHERE abs((s - ms) / ss) > 3
""",
)
def z_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(
        "obs_id",
        F.when(F.col("obs_id") % 97 == 0, F.col("temperature_f") * 10).otherwise(F.col("temperature_f")).alias("t"),
        F.pow(F.col("snow_depth_inches") / 10, F.lit(4)).alias("s"),
    )
    return rounded(quality.z_outliers(o, "obs_id", ["t", "s"]), ["value", "z"])


@query(
    "absence_date_checks",
    "D6",
    cte("obs")
    + """
, a AS (SELECT CASE WHEN obs_id % 9 = 0 THEN NULL ELSE date END AS date FROM obs WHERE elk_present = 0)
SELECT count(*) AS n, round(count(date) / count(*) * 100, 6) AS dated_pct, round(count(*) FILTER (month(date) = 1) / count(*) * 100, 6) AS january_pct,
  round(count(*) FILTER (year(date) = 2024) / count(*) * 100, 6) AS year_2024_pct, count(*) FILTER (month(date) = 1) / count(*) > 0.3 AS january_alarm,
  count(*) FILTER (year(date) = 2024) / count(*) > 0.4 AS year_2024_alarm FROM a
""",
)
def absence_date_checks(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("date", F.when(F.col("obs_id") % 9 != 0, F.col("date")))
    return rounded(quality.absence_dates(o), ["dated_pct", "january_pct", "year_2024_pct"])


@query(
    "class_month_gap",
    "D6",
    cte("obs")
    + """
, m AS (SELECT month(date) AS month, count(*) FILTER (elk_present = 1) AS p, count(*) FILTER (elk_present = 0) AS a FROM obs GROUP BY 1),
s AS (SELECT *, p / sum(p) OVER () * 100 AS ps, a / sum(a) OVER () * 100 AS as_ FROM m)
SELECT round(max(abs(ps - as_)), 6) AS max_gap, CASE WHEN max(abs(ps - as_)) > 20 THEN 'poor' WHEN max(abs(ps - as_)) > 10 THEN 'weak' ELSE 'good' END AS status
FROM s WHERE p > 0 AND a > 0
""",
)
def class_month_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.month_gap(view(spark, d, "obs")), ["max_gap"])


def _pct(condition: str, of: str) -> str:
    return f"count(*) FILTER ({of} AND ({condition})) / nullif(count(*) FILTER ({of}), 0) * 100"


_SUMMER, _WINTER = "month(date) IN (6,7,8)", "month(date) IN (12,1,2)"
_EST = "snow_data_source = 'estimate'"
_FOREST = "land_cover_code IN (41,42,43)"
_VALID = "land_cover_code IN (11,12,21,22,23,24,31,41,42,43,51,52,71,72,73,74,81,82,90,95)"
# (severity, rule, measure, failure test on m)
_RULES = [
    ("info", "trail_closer_than_road_pct", _pct("trail_distance_miles < road_distance_miles", "true"), "false"),
    ("info", "road_trail_correlation", "corr(road_distance_miles, trail_distance_miles)", "false"),
    ("info", "mean_trail_where_road_under_1", "avg(trail_distance_miles) FILTER (road_distance_miles < 1)", "false"),
    ("warning", "default_road_distance_pct", _pct("road_distance_miles = 2", "true"), "m > 10"),
    ("warning", "default_trail_distance_pct", _pct("trail_distance_miles = 1.5", "true"), "m > 10"),
    ("warning", "ndvi_placeholder_pct", _pct("abs(ndvi - 0.3) < 0.01 OR abs(ndvi - 0.5) < 0.01", "ndvi IS NOT NULL"), "m > 10"),
    ("error", "ndvi_out_of_range", "count(*) FILTER (ndvi < -1 OR ndvi > 1)", "m > 0"),
    ("warning", "ndvi_summer_minus_winter", f"avg(ndvi) FILTER ({_SUMMER}) - avg(ndvi) FILTER ({_WINTER})", "m < 0.1"),
    ("warning", "ndvi_age_placeholder_pct", _pct("ndvi_age_days = 8", "true"), "m > 50"),
    ("info", "ndvi_older_than_90_days", "count(*) FILTER (ndvi_age_days > 90)", "m > 0"),
    ("warning", "irg_zero_pct", _pct("irg = 0", "true"), "m > 80"),
    ("warning", "irg_spring_mean", "avg(irg) FILTER (month(date) IN (4,5))", "m <= 0"),
    ("warning", "irg_fall_mean", "avg(irg) FILTER (month(date) IN (9,10))", "m >= 0"),
    ("warning", "summer_ndvi_maximum", "max(summer_integrated_ndvi)", "m < 0.5 OR m > 10"),
    ("warning", "temperature_placeholder_pct", _pct("abs(temperature_f - 45) < 0.1", "true"), "m > 10"),
    ("warning", "temperature_summer_minus_winter", f"avg(temperature_f) FILTER ({_SUMMER}) - avg(temperature_f) FILTER ({_WINTER})", "m < 20"),
    ("warning", "temperature_span", "max(temperature_f) - min(temperature_f)", "m < 10"),
    ("warning", "elevation_temperature_correlation", "corr(elevation_ft, temperature_f)", "m > -0.2"),
    ("warning", "elevation_temperature_positive", "corr(elevation_ft, temperature_f)", "m > 0.3"),
    ("warning", "zero_precipitation_pct", _pct("precip_last_7_days_inches = 0", "true"), "m > 70"),
    ("info", "precipitation_above_5_inches", "count(*) FILTER (precip_last_7_days_inches > 5)", "false"),
    ("warning", "cloud_placeholder_pct", _pct("cloud_cover_percent IN (20, 30, 40)", "true"), "m > 50"),
    ("error", "cloud_out_of_range", "count(*) FILTER (cloud_cover_percent < 0 OR cloud_cover_percent > 100)", "m > 0"),
    ("warning", "snow_estimated_pct", _pct(_EST, "true"), "m > 50"),
    ("warning", "deep_snow_at_low_elevation", f"count(*) FILTER ({_EST} AND elevation_ft < 3000 AND snow_depth_inches > 5)", "m > 0"),
    ("warning", "constant_snow_estimate", f"min(snow_depth_inches) FILTER ({_EST})", "false"),
    ("warning", "snow_estimate_elevation_correlation", f"corr(elevation_ft, snow_depth_inches) FILTER ({_EST})", "m < 0.5"),
    ("warning", "mean_snow_estimate_above_8000", f"avg(snow_depth_inches) FILTER ({_EST} AND elevation_ft > 8000)", "m < 10"),
    ("info", "snow_estimate_below_6000", f"count(*) FILTER ({_EST} AND elevation_ft < 6000 AND snow_depth_inches > 0.1)", "m > 0"),
    ("warning", "station_beyond_50_km", f"count(*) FILTER (NOT {_EST} AND snow_station_distance_km > 50)", "m > 0"),
    ("error", "negative_snow", "count(*) FILTER (snow_depth_inches < 0 OR snow_water_equiv_inches < 0)", "m > 0"),
    ("warning", "water_equivalent_above_depth", "count(*) FILTER (snow_water_equiv_inches > snow_depth_inches)", "m > 0"),
    ("error", "outside_study_area_pct", _pct("NOT (latitude BETWEEN 40.995 AND 45.006 AND longitude BETWEEN -111.055 AND -104.053)", "true"), "m > 0"),
    ("error", "invalid_land_cover", f"count(*) FILTER (NOT {_VALID})", "m > 0"),
    ("warning", "forest_without_canopy_pct", _pct("canopy_cover_percent < 10", _FOREST), "m > 10"),
    ("warning", "canopy_without_forest_pct", _pct("canopy_cover_percent > 50", f"NOT {_FOREST} AND land_cover_code <> 52"), "m > 10"),
    ("warning", "forest_minus_other_ndvi", f"avg(ndvi) FILTER ({_FOREST}) - avg(ndvi) FILTER (NOT {_FOREST})", "m < 0"),
    ("error", "aspect_degrees_out_of_range", "count(*) FILTER (aspect_degrees < 0 OR aspect_degrees >= 360)", "m > 0"),
    ("error", "water_reliability_out_of_range", "count(*) FILTER (water_reliability < 0 OR water_reliability > 1)", "m > 0"),
    ("error", "security_habitat_percent_out_of_range", "count(*) FILTER (security_habitat_percent < 0 OR security_habitat_percent > 100)", "m > 0"),
]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT '{sev}' AS severity, '{name}' AS rule, CAST({m} AS DOUBLE) AS m, '{i}' AS i FROM obs" for i, (sev, name, m, _) in enumerate(_RULES)
)
_FAILED = "CASE i " + " ".join(f"WHEN '{i}' THEN {t}" for i, (_, _, _, t) in enumerate(_RULES)) + " END"


@query(
    "rule_report",
    "D7 D8 D9 D10 D11 D12 D13 D15 E19",
    cte("obs") + f", r AS ({_RULE_SQL}) SELECT severity, rule, round(m, 6) AS measure, coalesce({_FAILED}, false) AS failed FROM r",
)
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.rule_report(view(spark, d, "obs")), ["measure"])


@query(
    "issue_list",
    "D15 D20 E19",
    cte("obs") + f", r AS ({_RULE_SQL}) SELECT severity, rule, round(m, 6) AS measure FROM r WHERE {_FAILED}",
)
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.issues(quality.rule_report(view(spark, d, "obs"))), ["measure"])


@query(
    "completeness",
    "D14 A3",
    cte("obs")
    + union_all(
        "SELECT '{c}' AS feature, round(count({c}) / count(*) * 100, 6) AS pct, CASE WHEN count({c}) / count(*) >= 0.9 THEN 'complete' WHEN count({c}) / count(*) >= 0.5 THEN 'partial' ELSE 'sparse' END AS status FROM obs",
        ["ndvi", "snow_station_name", "elevation_ft"],
    )
    + " UNION ALL SELECT 'moon_phase', NULL, 'absent'",
)
def completeness(spark: SparkSession, d: str) -> DataFrame:
    out = quality.completeness(view(spark, d, "obs"), ["ndvi", "snow_station_name", "elevation_ft", "moon_phase"])
    return rounded(out, ["pct"])


_READY = """
count(*) AS samples, greatest(0, count(*) FILTER (ndvi IS NULL) / count(*) * 100, count(*) FILTER (elevation_ft IS NULL) / count(*) * 100) AS miss,
  greatest(count(*) FILTER (elevation_ft = 8500), count(*) FILTER (slope_degrees = 15), count(*) FILTER (aspect_degrees = 180), count(*) FILTER (canopy_cover_percent = 30),
    count(*) FILTER (water_distance_miles = 0.5), count(*) FILTER (land_cover_code = 0)) / count(*) * 100 AS marks FROM obs GROUP BY dataset"""


@query(
    "readiness_by_dataset",
    "D16",
    cte("obs")
    + f"""
, g AS (SELECT dataset, {_READY}),
s AS (SELECT *, CAST(CASE WHEN samples < 1000 THEN 0.3 WHEN samples < 10000 THEN 0.6 WHEN samples < 100000 THEN 0.9 ELSE 1 END AS DOUBLE) AS volume, 10 / 11 AS richness,
   least(greatest(0, 1 - miss / 100), 1 - marks / 200) AS quality FROM g),
p AS (SELECT *, (volume * 0.25 + richness * 0.25 + quality * 0.35 + 0.15) * 100 AS pct FROM s)
SELECT dataset, samples, volume, round(richness, 6) AS richness, round(quality, 6) AS quality, 1.0::DOUBLE AS dates, round(pct, 6) AS readiness_pct,
  CASE WHEN pct >= 80 THEN 'ready' WHEN pct >= 60 THEN 'mostly_ready' ELSE 'not_ready' END AS status FROM p
""",
)
def readiness_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = quality.readiness(view(spark, d, "obs"), ["ndvi", "elevation_ft"], ["dataset"])
    return rounded(out, ["richness", "quality", "readiness_pct"])


_Q = ["ndvi", "temperature_f", "snow_depth_inches"]


@query(
    "quality_score",
    "D17",
    cte("obs")
    + ", f AS (SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo{i}, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi{i}"
        for i, c in enumerate(_Q)
    )
    + " FROM obs), s AS (SELECT (count(ndvi) + count(temperature_f) + count(snow_depth_inches)) / (count(*) * 3) * 40 AS completeness, (1 - ("
    + " + ".join(f"count(*) FILTER ({c} < lo{i} OR {c} > hi{i})" for i, c in enumerate(_Q))
    + """) / (count(*) * 3)) * 30 AS validity, (1 - (count(*) FILTER (latitude NOT BETWEEN -90 AND 90) + count(*) FILTER (longitude NOT BETWEEN -180 AND 180)) / (count(*) * 2)) * 15 AS geographic,
  count(ndvi) / count(*) * CASE WHEN count(*) FILTER (ndvi < -1 OR ndvi > 1) = 0 THEN 1 ELSE 0.5 END * 15 AS vegetation FROM obs, f),
t AS (SELECT *, completeness + validity + geographic + vegetation AS score FROM s)
SELECT round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(geographic, 6) AS geographic, round(vegetation, 6) AS vegetation, round(score, 6) AS score,
  CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 80 THEN 'GOOD' WHEN score >= 70 THEN 'ACCEPTABLE' WHEN score >= 60 THEN 'NEEDS IMPROVEMENT' ELSE 'POOR' END AS rating FROM t
""",
)
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality_score(view(spark, d, "obs"), _Q, _Q)
    return rounded(out, ["completeness", "validity", "geographic", "vegetation", "score"])


@query(
    "suspicious_values",
    "D18",
    cte("obs")
    + """
, x AS (SELECT *, CASE WHEN obs_id % 50 = 0 THEN 130 ELSE temperature_f END AS t, 7.0::DOUBLE AS k FROM obs)
SELECT 'temperature_f' AS feature, count(*) FILTER (t < -60 OR t > 120) AS n_impossible, stddev_samp(t) < 1e-10 AS constant FROM x
UNION ALL SELECT 'elevation_ft', count(*) FILTER (elevation_ft < 0 OR elevation_ft > 15000), stddev_samp(elevation_ft) < 1e-10 FROM x
UNION ALL SELECT 'k', 0, stddev_samp(k) < 1e-10 FROM x
""",
)
def suspicious_values(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumns(
        {"temperature_f": F.when(F.col("obs_id") % 50 == 0, 130.0).otherwise(F.col("temperature_f")), "k": F.lit(7.0)}
    )
    return quality.suspicious_values(o, ["temperature_f", "elevation_ft", "k"])


@query(
    "monthly_missing",
    "D19",
    cte("obs")
    + """
SELECT month(date) AS month, count(*) AS n, round(count(*) FILTER (ndvi IS NULL) / count(*) * 100, 6) AS missing_pct, round(count(ndvi) / count(*) * 100, 6) AS success_pct,
  count(*) < 1200 AS sparse FROM obs GROUP BY 1
""",
)
def monthly_missing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.monthly_missing(view(spark, d, "obs"), "ndvi", sparse=1200), ["missing_pct", "success_pct"])


@query("yearly_counts", "D19 A5", cte("obs") + "SELECT year(date) AS year, count(*) AS n FROM obs GROUP BY 1")
def yearly_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.yearly_counts(view(spark, d, "obs"))


_OUT = " + ".join(
    f"count(*) FILTER ({c} < {lo} OR {c} > {hi})"
    for c, (lo, hi) in quality.EXPECTED_RANGES.items()
    if not c.startswith(("moon", "effective", "cloud_adj"))
)


@query(
    "context_check",
    "D21 A1 A3 A8",
    cte("obs")
    + f"""
SELECT count(*) AS rows, count(*) FILTER (elk_present = 1) AS positive, count(*) FILTER (elk_present = 0) AS negative, count(DISTINCT year(date)) AS years,
  min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, {' + '.join(f'(count(*) - count({c}))' for c in NUMERIC)} AS missing_cells,
  {_OUT} AS range_failures FROM obs
""",
)
def context_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.context_check(view(spark, d, "obs"), columns=NUMERIC)
