"""Descriptive aggregations and windows over observations and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import features, sampling, series, summaries
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, table, view

NUMERIC = [
    "elevation_ft", "slope_degrees", "aspect_degrees", "canopy_cover_percent", "water_distance_miles",
    "road_distance_miles", "trail_distance_miles", "security_habitat_percent", "snow_depth_inches",
    "temperature_f", "precip_last_7_days_inches", "cloud_cover_percent", "ndvi", "irg", "summer_integrated_ndvi",
]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=n) for n in names)


@query(
    "class_distribution",
    "A1",
    cte("obs")
    + """
SELECT dataset, count(*) AS total, count(*) FILTER (elk_present = 1) AS positive, count(*) FILTER (elk_present = 0) AS negative,
  round(count(*) FILTER (elk_present = 1) / count(*) * 100, 6) AS positive_pct,
  round(count(*) FILTER (elk_present = 0) / count(*) * 100, 6) AS negative_pct,
  CASE WHEN count(*) FILTER (elk_present = 1) > 0
    THEN round(count(*) FILTER (elk_present = 0) / count(*) FILTER (elk_present = 1), 6) ELSE 'infinity'::DOUBLE END AS imbalance_ratio
FROM obs GROUP BY dataset
""",
)
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return summaries.class_distribution(view(spark, d, "obs"), by=["dataset"])


@query(
    "class_subtotals",
    "A1 A2",
    cte("obs")
    + """
SELECT dataset, month(date) AS month, count(*) AS total, count(*) FILTER (elk_present = 1) AS positive
FROM obs GROUP BY ROLLUP (dataset, month(date))
""",
)
def class_subtotals(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("month", F.month("date"))
    return summaries.class_subtotals(o, ["dataset", "month"])


@query(
    "month_class_table",
    "A2",
    cte("obs")
    + """
SELECT month(date) AS month, count(*) FILTER (elk_present = 0) AS absent, count(*) FILTER (elk_present = 1) AS present,
  count(*) AS total, round(count(*) FILTER (elk_present = 1) / count(*) * 100, 1) AS present_pct
FROM obs GROUP BY 1
""",
)
def month_class_table(spark: SparkSession, d: str) -> DataFrame:
    return summaries.month_class_table(view(spark, d, "obs"))


@query(
    "missing_values",
    "A3",
    cte("obs")
    + union_all(
        "SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*) * 100, 6) AS pct_missing FROM obs",
        NUMERIC,
    ),
)
def missing_values(spark: SparkSession, d: str) -> DataFrame:
    return summaries.missing_report(view(spark, d, "obs"), NUMERIC)


@query(
    "numeric_summary",
    "A4",
    cte("obs")
    + union_all(
        "SELECT '{c}' AS feature, count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean,"
        " round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median, count(DISTINCT {c}) AS nunique FROM obs",
        NUMERIC,
    ),
)
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.numeric_summary(view(spark, d, "obs"), NUMERIC), ["mean", "std", "median"])


@query(
    "category_counts",
    "A4 A5 W6",
    cte("obs")
    + """
, l AS (SELECT 'dataset' AS "column", dataset AS value FROM obs UNION ALL SELECT 'land_cover_code', CAST(land_cover_code AS VARCHAR) FROM obs
  UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR) FROM obs UNION ALL SELECT 'month', CAST(month(date) AS VARCHAR) FROM obs
  UNION ALL SELECT 'snow_station_name', snow_station_name FROM obs),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY "column") * 100, 6) AS pct,
   CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS INT) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10
""",
)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumns({"year": F.year("date"), "month": F.month("date")})
    return summaries.value_counts(o, ["dataset", "land_cover_code", "year", "month", "snow_station_name"], top=10)


@query(
    "share_of_total",
    "W6",
    cte("obs") + "SELECT dataset, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct FROM obs GROUP BY dataset",
)
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return summaries.share_by(view(spark, d, "obs"), "dataset")


@query(
    "monthly_ndvi",
    "A6 E20",
    cte("obs")
    + """
SELECT month(date) AS month, round(avg(ndvi), 6) AS mean, round(stddev_samp(ndvi), 6) AS std, min(ndvi) AS min, max(ndvi) AS max, count(ndvi) AS count
FROM obs GROUP BY 1
""",
)
def monthly_ndvi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.monthly_stats(view(spark, d, "obs"), "ndvi"), ["mean", "std"])


@query(
    "season_contrast",
    "A6 E20",
    cte("obs")
    + union_all(
        "SELECT '{c}' AS feature, round(avg({c}) FILTER (month(date) IN (6,7,8)), 6) AS summer, round(avg({c}) FILTER (month(date) IN (12,1,2)), 6) AS winter,"
        " round(avg({c}) FILTER (month(date) IN (6,7,8)) - avg({c}) FILTER (month(date) IN (12,1,2)), 6) AS difference FROM obs",
        ["ndvi", "temperature_f", "elevation_ft"],
    ),
)
def season_contrast(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.season_contrast(view(spark, d, "obs"), ["ndvi", "temperature_f", "elevation_ft"])
    return rounded(out, ["summer", "winter", "difference"])


@query(
    "fixes_per_animal",
    "A7",
    cte("fixes")
    + """
, s AS (SELECT animal_id, count(*) AS n FROM fixes GROUP BY 1)
SELECT count(*) AS groups, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median FROM s
""",
)
def fixes_per_animal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.per_group_counts(view(spark, d, "fixes"), "animal_id"), ["mean", "median"])


@query(
    "duplicate_rows",
    "A8",
    """
WITH g AS (SELECT l_partkey, l_suppkey, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g
""",
)
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return summaries.duplicate_rows(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity", "l_discount"])


@query(
    "infinite_values",
    "A8",
    cte("obs")
    + """
, x AS (SELECT CASE WHEN obs_id % 100 = 3 THEN 'infinity'::DOUBLE ELSE ndvi END AS ndvi, irg FROM obs)
SELECT 'ndvi' AS feature, count(*) FILTER (isinf(ndvi)) AS n_infinite FROM x UNION ALL SELECT 'irg', count(*) FILTER (isinf(irg)) FROM x
""",
)
def infinite_values(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn(
        "ndvi", F.when(F.col("obs_id") % 100 == 3, float("inf")).otherwise(F.col("ndvi"))
    )
    return summaries.infinite_values(o, ["ndvi", "irg"])


@query("distinct_locations", "A9", cte("obs") + "SELECT count(DISTINCT (latitude, longitude)) AS locations FROM obs")
def distinct_locations(spark: SparkSession, d: str) -> DataFrame:
    return summaries.distinct_locations(view(spark, d, "obs"))


_BAND = (
    "CASE WHEN v <= 1 THEN '<1mi' WHEN v <= 5 THEN '1-5mi' WHEN v <= 10 THEN '5-10mi' WHEN v <= 20 THEN '10-20mi'"
    " WHEN v <= 50 THEN '20-50mi' WHEN v <= 100 THEN '50-100mi' ELSE '100+mi' END"
)


@query(
    "distance_bands",
    "A10",
    cte("obs")
    + f"""
, l AS (SELECT 'road' AS "column", road_distance_miles AS v FROM obs UNION ALL SELECT 'trail', trail_distance_miles * 40 FROM obs),
c AS (SELECT "column", {_BAND} AS value, count(*) AS n FROM l WHERE v >= 0 GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY "column") * 100, 6) AS pct FROM c
""",
)
def distance_bands(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(
        F.col("road_distance_miles").alias("road"), (F.col("trail_distance_miles") * 40).alias("trail")
    )
    return summaries.distance_bands(o, ["road", "trail"])


@query(
    "grid_presence_rate",
    "A11 A12",
    cte("obs")
    + """
, b AS (SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1 FROM obs),
g AS (SELECT least(CAST(floor((longitude - x0) / (x1 - x0) * 10) AS BIGINT), 9) AS x_bin,
   least(CAST(floor((latitude - y0) / (y1 - y0) * 10) AS BIGINT), 9) AS y_bin, elk_present FROM obs, b),
a AS (SELECT x_bin, y_bin, round(avg(elk_present), 6) AS mean, count(*) AS count, avg(elk_present) AS m FROM g GROUP BY 1, 2)
SELECT x_bin, y_bin, mean, count, CASE WHEN m > 0.6 THEN 'high' WHEN m < 0.4 THEN 'low' ELSE 'middle' END AS level FROM a
""",
)
def grid_presence_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.grid_means(view(spark, d, "obs"), "longitude", "latitude", "elk_present"), ["mean"])


@query(
    "hex_density",
    "A12",
    cte("obs")
    + """
, a AS (SELECT elk_present, (longitude * sqrt(3) / 3 - latitude / 3) / 0.1 AS q, (latitude * 2 / 3) / 0.1 AS r FROM obs),
b AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r,
  count(*) AS count, round(avg(elk_present), 6) AS mean FROM c GROUP BY 1, 2 HAVING count(*) >= 3
""",
)
def hex_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        summaries.hex_surface(view(spark, d, "obs"), "longitude", "latitude", "elk_present", 0.1, 3), ["mean"]
    )


@query(
    "response_curve",
    "A13",
    cte("obs")
    + """
, e AS (SELECT list_distinct(quantile_cont(ndvi, [0,0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95,1])) AS edges FROM obs),
x AS (SELECT elk_present, ndvi, CAST(len(list_filter(list_sort(edges)[2:len(edges)-1], lambda b: b < ndvi)) AS INT) AS bin FROM obs, e WHERE ndvi IS NOT NULL)
SELECT bin, round(avg(elk_present), 6) AS mean_target, round(avg(ndvi), 6) AS mean_feature, count(*) AS n FROM x GROUP BY bin
""",
)
def response_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        summaries.quantile_bins(view(spark, d, "obs"), "ndvi", "elk_present"), ["mean_target", "mean_feature"]
    )


@query(
    "dataset_date_span",
    "A17",
    cte("obs")
    + """
SELECT dataset, CAST(min(date) - 30 AS DATE) AS first_date, CAST(max(date) + 30 AS DATE) AS last_date, max(year(date)) - min(year(date)) + 1 AS years
FROM obs GROUP BY dataset
""",
)
def dataset_date_span(spark: SparkSession, d: str) -> DataFrame:
    return summaries.date_span(view(spark, d, "obs"), by=["dataset"])


@query(
    "needed_dates",
    "A18",
    cte("obs") + "SELECT DISTINCT CAST(date - k AS DATE) AS date FROM (SELECT DISTINCT date FROM obs), (SELECT unnest(range(8))::INT AS k)",
)
def needed_dates(spark: SparkSession, d: str) -> DataFrame:
    return summaries.needed_dates(view(spark, d, "obs"))


_MONTHLY = (
    cte("obs")
    + ", monthly AS ("
    + union_all(
        "SELECT '{c}' AS feature, year(date) AS year, month(date) AS month, avg({c}) AS mean FROM obs GROUP BY 2, 3",
        ["ndvi", "temperature_f"],
    )
    + ")"
)


@query(
    "rolling_monthly_mean",
    "W2",
    _MONTHLY
    + """
SELECT feature, year, month, round(mean, 6) AS mean,
  round(CASE WHEN count(mean) OVER w = 3 THEN avg(mean) OVER w END, 6) AS rolling
FROM monthly WINDOW w AS (PARTITION BY feature ORDER BY year, month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
""",
)
def rolling_monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    out = series.rolling_mean(series.monthly_means(view(spark, d, "obs"), ["ndvi", "temperature_f"]))
    return rounded(out, ["mean", "rolling"])


_ACF = (
    _MONTHLY
    + """
, s AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY year, month) AS t, mean - avg(mean) OVER (PARTITION BY feature) AS dev FROM monthly),
v AS (SELECT feature, sum(dev * dev) AS var FROM s GROUP BY 1)
SELECT a.feature, CAST(a.t - b.t AS INT) AS lag, round(sum(a.dev * b.dev) / max(var), 6) AS acf
FROM s a JOIN s b ON a.feature = b.feature AND a.t - b.t BETWEEN 0 AND 40 JOIN v ON v.feature = a.feature GROUP BY 1, 2
"""
)


@query("autocorrelation", "W4", _ACF)
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    m = series.monthly_means(view(spark, d, "obs"), ["ndvi", "temperature_f"])
    return rounded(series.autocorrelation(m), ["acf"])


@query(
    "partial_autocorrelation",
    "W4",
    _ACF.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT a.feature", "\n, acf AS (SELECT a.feature", 1).replace("round(sum(a.dev * b.dev) / max(var), 6)", "sum(a.dev * b.dev) / max(var)").rstrip()
    + """),
r AS (SELECT feature, list(acf ORDER BY lag) AS r FROM acf GROUP BY 1),
pac AS (SELECT feature, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1::DOUBLE AS last FROM r
  UNION ALL SELECT feature, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - nl * phi[k + 1 - j]), nl), nl FROM (
    SELECT feature, r, k, phi, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0))
      / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS nl FROM pac WHERE k + 1 < len(r)))
SELECT feature, CAST(k AS INT) AS lag, round(last, 6) AS pacf FROM pac
""",
)
def partial_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    m = series.monthly_means(view(spark, d, "obs"), ["ndvi", "temperature_f"])
    return rounded(series.partial_autocorrelation(series.autocorrelation(m)), ["pacf"])


def _scaled(axis: str) -> str:
    return (
        _MONTHLY
        + f"""
, p AS (SELECT feature, month, avg(mean) AS mean FROM monthly GROUP BY 1, 2)
SELECT feature, month, round(mean, 6) AS mean,
  round((mean - min(mean) OVER w) / nullif(max(mean) OVER w - min(mean) OVER w, 0), 6) AS scaled FROM p WINDOW w AS (PARTITION BY {axis})
"""
    )


@query("scaled_month_profile", "W5", _scaled("feature"))
def scaled_month_profile(spark: SparkSession, d: str) -> DataFrame:
    m = series.monthly_means(view(spark, d, "obs"), ["ndvi", "temperature_f"])
    return rounded(series.scaled_profile(m), ["mean", "scaled"])


@query("scaled_feature_profile", "W5", _scaled("month"))
def scaled_feature_profile(spark: SparkSession, d: str) -> DataFrame:
    m = series.monthly_means(view(spark, d, "obs"), ["ndvi", "temperature_f"])
    return rounded(series.scaled_profile(m, "month"), ["mean", "scaled"])


_HASH = "md5('42|{stream}|' || obs_id)"


@query(
    "seeded_sample",
    "T4 T3",
    cte("obs")
    + ", h AS (SELECT obs_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY "
    + _HASH.format(stream="sample")
    + ") AS rn FROM obs) SELECT obs_id, dataset FROM h WHERE rn <= 200",
)
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_rows(view(spark, d, "obs"), 200, ["obs_id"], group=["dataset"]).select("obs_id", "dataset")


@query(
    "sample_with_replacement",
    "T4 G9",
    cte("obs")
    + ", h AS (SELECT obs_id, date, row_number() OVER (ORDER BY md5('42|draw|' || obs_id)) AS rank, count(*) OVER () AS size FROM obs),"
    " d AS (SELECT range AS draw_id, CAST(('0x' || substr(md5('42|draw_pick|' || range), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(500))"
    " SELECT draw_id, obs_id, date FROM d JOIN h ON h.rank = CAST(floor(u * size) AS BIGINT) + 1",
)
def sample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_with_replacement(view(spark, d, "obs"), 500, ["obs_id"]).select("draw_id", "obs_id", "date")


@query(
    "stratified_split",
    "T5 M9",
    cte("obs")
    + ", h AS (SELECT obs_id, elk_present, row_number() OVER (PARTITION BY elk_present ORDER BY "
    + _HASH.format(stream="split")
    + ") AS rn, count(*) OVER (PARTITION BY elk_present) AS n FROM obs)"
    " SELECT obs_id, elk_present, rn <= floor(n * 0.8 + 1e-9) AS is_train FROM h",
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(view(spark, d, "obs"), "elk_present", ["obs_id"]).select(
        "obs_id", "elk_present", "is_train"
    )


@query(
    "date_batches",
    "T6",
    cte("obs")
    + """
, r AS (SELECT obs_id, date, (row_number() OVER (ORDER BY date, md5(CAST(obs_id AS VARCHAR)), obs_id) - 1) // 100 AS batch_id FROM obs)
SELECT batch_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM r GROUP BY batch_id
""",
)
def date_batches(spark: SparkSession, d: str) -> DataFrame:
    numbered = sampling.numbered_batches(view(spark, d, "obs").select("obs_id", "date"), "date", "obs_id", 100)
    return numbered.groupBy("batch_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n")
    )


@query("head_rows", "T3", cte("obs") + "SELECT obs_id, date FROM obs ORDER BY obs_id LIMIT 50")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head_rows(view(spark, d, "obs").select("obs_id", "date"), "obs_id", 50)


@query(
    "seeded_shuffle",
    "W7 G12",
    cte("obs") + "SELECT obs_id, dataset FROM obs",
)
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffle_order(view(spark, d, "obs").select("obs_id", "dataset"), ["obs_id"])


@query(
    "region_filters",
    "P1 P7 P8 M1 M12",
    cte("obs")
    + """
, r AS (SELECT *, CASE WHEN longitude < -109 THEN CASE WHEN latitude >= 43.5 THEN 'northwest' ELSE 'southwest' END
    ELSE CASE WHEN latitude >= 44 THEN 'northeast' ELSE 'southeast' END END AS region FROM obs)
SELECT region, count(*) AS n, count(*) FILTER (latitude BETWEEN 41 AND 45 AND longitude BETWEEN -111 AND -104) AS n_inside,
  count(*) FILTER (region <> 'southeast' OR year(date) BETWEEN 1997 AND 1999) AS n_kept FROM r GROUP BY region
""",
)
def region_filters(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.operators import regions

    o = regions.with_region(view(spark, d, "obs"))
    kept = regions.region_year_rule(F.col("region"), F.year("date"), (1997, 1999))
    inside = features.inside_box(F.col("latitude"), F.col("longitude"))
    return o.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"),
        summaries.count_if(inside).alias("n_inside"),
        summaries.count_if(kept).alias("n_kept"),
    )
