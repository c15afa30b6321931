"""Statistics and classifier diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import regions, stats
from terrasift.plans.aggregate_queries import NUMERIC, rounded, union_all
from terrasift.plans.registry import query
from terrasift.plans.scoring_queries import _X, AS_OF, OPTIONS, scoring_input
from terrasift.plans.scoring_sql import FACTOR_CTES
from terrasift.sources.surrogates import cte, view

SIX = NUMERIC[:6]

_GROUPS = union_all(
    "SELECT '{c}' AS feature, count({c}) FILTER (elk_present = 1) AS n1, avg({c}) FILTER (elk_present = 1) AS mean1,"
    " stddev_samp({c}) FILTER (elk_present = 1) AS std1, count({c}) FILTER (elk_present = 0) AS n2,"
    " avg({c}) FILTER (elk_present = 0) AS mean2, stddev_samp({c}) FILTER (elk_present = 0) AS std2 FROM obs",
    NUMERIC,
)


@query(
    "effect_sizes_pooled",
    "E1 E3 T1",
    cte("obs")
    + f", g AS ({_GROUPS})"
    + """
, e AS (SELECT feature, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(std1, 6) AS std1, round(std2, 6) AS std2,
  round(mean1 - mean2, 6) AS diff, round((mean1 - mean2) / abs(mean2) * 100, 4) AS diff_pct,
  round((mean1 - mean2) / sqrt(((n1-1)*std1*std1 + (n2-1)*std2*std2) / (n1+n2-2)), 6) AS cohens_d FROM g)
SELECT * FROM e ORDER BY abs(cohens_d) DESC LIMIT 10
""",
)
def effect_sizes_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = stats.top_effects(stats.presence_effects(view(spark, d, "obs"), NUMERIC), 10)
    return rounded(rounded(out, ["mean1", "mean2", "std1", "std2", "diff", "cohens_d"]), ["diff_pct"], 4)


@query(
    "effect_sizes_simple",
    "E2",
    cte("obs")
    + f", g AS ({_GROUPS}) SELECT feature, round((mean1 - mean2) / sqrt((std1*std1 + std2*std2) / 2), 6) AS cohens_d FROM g",
)
def effect_sizes_simple(spark: SparkSession, d: str) -> DataFrame:
    out = stats.presence_effects(view(spark, d, "obs"), NUMERIC, pooled=False)
    return rounded(out.select("feature", "cohens_d"), ["cohens_d"])


@query(
    "region_effects",
    "E3 P8",
    cte("obs")
    + ", r AS (SELECT *, latitude < 44 AND longitude >= -109 AS se FROM obs), g AS ("
    + union_all(
        "SELECT '{c}' AS feature, count({c}) FILTER (se) AS n1, avg({c}) FILTER (se) AS mean1, stddev_samp({c}) FILTER (se) AS std1,"
        " count({c}) FILTER (NOT se) AS n2, avg({c}) FILTER (NOT se) AS mean2, stddev_samp({c}) FILTER (NOT se) AS std2 FROM r",
        SIX,
    )
    + """)
SELECT feature, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
  round((mean1 - mean2) / sqrt(((n1-1)*std1*std1 + (n2-1)*std2*std2) / (n1+n2-2)), 6) AS cohens_d FROM g
""",
)
def region_effects(spark: SparkSession, d: str) -> DataFrame:
    o = regions.with_region(view(spark, d, "obs"))
    se = F.col("region") == "southeast"
    out = stats.effect_sizes(o, SIX, se, ~se)
    return rounded(out.select("feature", "n1", "n2", "mean1", "mean2", "cohens_d"), ["mean1", "mean2", "cohens_d"])


@query(
    "t_statistics",
    "E4",
    cte("obs")
    + f", g AS ({_GROUPS})"
    + """
SELECT feature, round((mean1 - mean2) / sqrt(((n1-1)*std1*std1 + (n2-1)*std2*std2) / (n1+n2-2) * (1/n1 + 1/n2)), 5) AS t,
  CAST(n1 + n2 - 2 AS DOUBLE) AS dof FROM g
""",
)
def t_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = stats.presence_effects(view(spark, d, "obs"), NUMERIC)
    return rounded(stats.t_statistics(g).select("feature", "t", "dof"), ["t"], 5)


@query(
    "t_test_p_values",
    "E4",
    cte("obs")
    + f", g AS ({_GROUPS})"
    # two-sided p as a ratio of integrals of cos^(dof - 1) over u / sqrt(dof), by Simpson's rule
    + """
, t AS (SELECT feature, (mean1 - mean2) / sqrt(((n1-1)*std1*std1 + (n2-1)*std2*std2) / (n1+n2-2) * (1/n1 + 1/n2)) AS t, (n1 + n2 - 2)::DOUBLE AS dof FROM g),
b AS (SELECT *, sqrt(dof) * atan(abs(t) / sqrt(dof)) AS a, least(sqrt(dof) * pi() / 2, 45) AS z FROM t),
i AS (SELECT feature, any_value(t) AS t,
    sum(w * pow(greatest(cos((a + (z - a) * k / 4000) / sqrt(dof)), 0), dof - 1)) * any_value(z - a) AS tail,
    sum(w * pow(greatest(cos(z * k / 4000 / sqrt(dof)), 0), dof - 1)) * any_value(z) AS whole
  FROM b, (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(4001)) AS k)) GROUP BY 1)
SELECT feature, round(t, 6) AS t, round(tail / whole, 6) AS p_value, tail / whole < 0.01 AS significant FROM i
""",
)
def t_test_p_values(spark: SparkSession, d: str) -> DataFrame:
    g = stats.presence_effects(view(spark, d, "obs"), NUMERIC)
    out = stats.with_p_values(stats.t_statistics(g)).select("feature", "t", "p_value", "significant")
    return rounded(out, ["t", "p_value"])


def _pairs_sql(cols: list[str], by: str = "") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {lead}'{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM o{group}"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


@query("correlation_matrix", "E5", cte("obs") + ", o AS (SELECT * FROM obs) " + _pairs_sql(NUMERIC[:8]))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation_long(view(spark, d, "obs"), NUMERIC[:8]), ["r"])


_SEASON = (
    "CASE WHEN month(date) IN (12,1,2) THEN 'wi' WHEN month(date) IN (3,4,5) THEN 'sp'"
    " WHEN month(date) IN (6,7,8) THEN 'su' ELSE 'fa' END"
)


@query(
    "seasonal_correlations",
    "E5",
    cte("obs") + f", o AS (SELECT *, {_SEASON} AS season FROM obs) " + _pairs_sql(NUMERIC[:5], "season"),
)
def seasonal_correlations(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.functions.temporal import season_code

    o = view(spark, d, "obs").withColumn("season", season_code(F.month("date")))
    return rounded(stats.correlation_long(o, NUMERIC[:5], ["season"]), ["r"])


@query(
    "correlated_pairs",
    "T7",
    cte("obs")
    + ", o AS (SELECT *, snow_depth_inches * 0.25 + slope_degrees / 100 AS swe FROM obs), p AS ("
    + _pairs_sql(["snow_depth_inches", "swe", "ndvi", "irg"])
    + ") SELECT * FROM p WHERE abs(r) > 0.8",
)
def correlated_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("swe", F.col("snow_depth_inches") * 0.25 + F.col("slope_degrees") / 100)
    corr = stats.correlation_long(o, ["snow_depth_inches", "swe", "ndvi", "irg"])
    return rounded(stats.correlated_pairs(corr), ["r"])


@query(
    "target_correlation",
    "E6",
    cte("obs") + union_all("SELECT '{c}' AS feature, round(corr({c}, elk_present), 6) AS r FROM obs", NUMERIC),
)
def target_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.target_correlation(view(spark, d, "obs"), NUMERIC), ["r"])


@query(
    "variance_inflation",
    "E7",
    cte("obs")
    # two predictors have a closed form: 1 / (1 - cos^2 of the angle between the columns)
    + """
, s AS (SELECT sum(slope_degrees * slope_degrees) AS aa, sum(snow_depth_inches * snow_depth_inches) AS bb, sum(slope_degrees * snow_depth_inches) AS ab FROM obs)
SELECT 'slope_degrees' AS feature, round(1 / (1 - ab * ab / (aa * bb)), 6) AS vif FROM s
UNION ALL SELECT 'snow_depth_inches', round(1 / (1 - ab * ab / (aa * bb)), 6) FROM s
""",
)
def variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.variance_inflation(view(spark, d, "obs"), ["slope_degrees", "snow_depth_inches"]), ["vif"])


_NAMES = "[" + ", ".join(f"'{c}'" for c in NUMERIC) + "]"


@query(
    "variance_inflation_many",
    "E7",
    cte("obs").replace("WITH ", "WITH RECURSIVE ", 1)
    # the scaled Gram matrix is inverted in place, one pivot a step
    + f"""
, o AS (SELECT obs_id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in NUMERIC)}] AS v FROM obs WHERE {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)}),
ij AS (SELECT i, j FROM (SELECT unnest(range(1, {len(NUMERIC) + 1})) AS i), (SELECT unnest(range(1, {len(NUMERIC) + 1})) AS j)),
gram AS (SELECT i, j, sum(v[i] * v[j]) AS g FROM o, ij GROUP BY 1, 2),
unit AS (SELECT g.i, g.j, g.g / sqrt(a.g * b.g) AS m FROM gram g JOIN gram a ON a.i = g.i AND a.j = g.i JOIN gram b ON b.i = g.j AND b.j = g.j),
mat AS (SELECT 0 AS k, list(m ORDER BY i, j) AS m FROM unit
  UNION ALL SELECT k + 1, list_transform(range(0, {len(NUMERIC)} * {len(NUMERIC)}), lambda x: CASE
      WHEN x // {len(NUMERIC)} = k AND x % {len(NUMERIC)} = k THEN 1 / m[k * {len(NUMERIC)} + k + 1]
      WHEN x // {len(NUMERIC)} = k THEN m[x + 1] / m[k * {len(NUMERIC)} + k + 1]
      WHEN x % {len(NUMERIC)} = k THEN -m[x + 1] / m[k * {len(NUMERIC)} + k + 1]
      ELSE m[x + 1] - m[x // {len(NUMERIC)} * {len(NUMERIC)} + k + 1] * m[k * {len(NUMERIC)} + x % {len(NUMERIC)} + 1] / m[k * {len(NUMERIC)} + k + 1] END)
  FROM mat WHERE k < {len(NUMERIC)})
SELECT {_NAMES}[i] AS feature, round(m[(i - 1) * {len(NUMERIC)} + i], 4) AS vif FROM mat, (SELECT unnest(range(1, {len(NUMERIC) + 1})) AS i) WHERE k = {len(NUMERIC)}
""",
)
def variance_inflation_many(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.variance_inflation(view(spark, d, "obs"), NUMERIC), ["vif"], 4)


@query(
    "moments",
    "E8 E9",
    cte("obs")
    + union_all(
        "SELECT '{c}' AS feature, count({c}) AS n, round(var_samp({c}), 5) AS variance, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM obs",
        NUMERIC,
    ),
)
def moments(spark: SparkSession, d: str) -> DataFrame:
    m = stats.moments(view(spark, d, "obs"), NUMERIC).drop("jarque_bera")
    return rounded(rounded(m, ["skewness", "kurtosis"]), ["variance"], 5)


@query(
    "feature_summary",
    "E9 E12",
    cte("obs")
    + f", g AS ({_GROUPS}), m AS ("
    + union_all(
        "SELECT '{c}' AS feature, count({c}) AS n, kurtosis_pop({c}) AS g2, skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS g1 FROM obs",
        NUMERIC,
    )
    + """)
SELECT feature, n, round(n / 6 * (g1*g1 + g2*g2/4), 3) AS jarque_bera, n / 6 * (g1*g1 + g2*g2/4) < 5.991464547107979 AS normal,
  round((mean1 - mean2) / sqrt((std1*std1 + std2*std2) / 2), 6) AS cohens_d
FROM m JOIN g USING (feature)
""",
)
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.feature_summary(view(spark, d, "obs"), NUMERIC)
    return rounded(rounded(out, ["cohens_d"]), ["jarque_bera"], 3).select("feature", "n", "jarque_bera", "normal", "cohens_d")


@query(
    "top_variance",
    "E10",
    cte("obs")
    + ", v AS ("
    + union_all("SELECT '{c}' AS feature, var_samp({c}) AS variance FROM obs", NUMERIC)
    + ") SELECT feature, round(variance, 4) AS variance FROM v ORDER BY v.variance DESC, feature LIMIT 5",
)
def top_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.top_variance(view(spark, d, "obs"), NUMERIC, 5), ["variance"], 4)


@query(
    "kernel_density",
    "E11",
    cte("obs")
    + """
, s AS (SELECT min(ndvi) AS lo, max(ndvi) AS hi, stddev_samp(ndvi) * pow(count(ndvi), -0.2) AS h, count(ndvi) AS n FROM obs),
c AS (SELECT least(CAST(floor((ndvi - lo) / (hi - lo) * 800) AS INT), 799) AS cell, count(*) AS k, avg(ndvi) AS pos FROM obs, s WHERE ndvi IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INT) AS i FROM range(100))
SELECT i, round(any_value(lo + i * ((hi - lo) / 99)), 6) AS x,
  round(sum(k * exp(-pow((lo + i * ((hi - lo) / 99) - pos) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density
FROM g, c, s GROUP BY i
""",
)
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.kernel_density(view(spark, d, "obs"), "ndvi"), ["x", "density"])


_SCORE_CTE = cte("obs") + _X + FACTOR_CTES


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.functions import scores

    names = ["elevation", "snow_conditions", "security_habitat"]
    return scores.with_scores(
        scoring_input(spark, d), names, as_of=F.lit(AS_OF).cast("date"), options=OPTIONS
    )


@query(
    "score_source_check",
    "E13",
    _SCORE_CTE
    + """
SELECT 'snow_conditions_score' AS score, 'snow_depth_inches' AS source, round(corr(snow_s, snow_depth_inches), 6) AS r,
  round(regr_slope(snow_s, snow_depth_inches), 6) AS slope, round(regr_intercept(snow_s, snow_depth_inches), 6) AS intercept,
  abs(corr(snow_s, snow_depth_inches)) > 0.5 AS passed FROM scored
UNION ALL SELECT 'security_habitat_score', 'security_habitat_percent', round(corr(security_s, security_habitat_percent), 6),
  round(regr_slope(security_s, security_habitat_percent), 6), round(regr_intercept(security_s, security_habitat_percent), 6),
  abs(corr(security_s, security_habitat_percent)) > 0.5 FROM scored
""",
)
def score_source_check(spark: SparkSession, d: str) -> DataFrame:
    out = stats.linear_check(
        _scored(spark, d),
        [("snow_conditions_score", "snow_depth_inches"), ("security_habitat_score", "security_habitat_percent")],
    )
    return rounded(out, ["r", "slope", "intercept"])


_AUC = """
 {n} AS (SELECT '{label}' AS score, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
   / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
  FROM (SELECT elk_present AS y, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS rk FROM scored) z)"""


@query(
    "score_auc",
    "E14",
    _SCORE_CTE
    + ","
    + _AUC.format(n="a1", label="elevation_score", v="round(elevation_s, 12)")
    + ","
    + _AUC.format(n="a2", label="snow_conditions_score", v="round(snow_s, 12)")
    + ","
    + _AUC.format(n="a3", label="security_habitat_score", v="round(security_s, 12)")
    + " SELECT score, round(auc, 6) AS auc, CASE WHEN score = 'elevation_score' THEN 'REVIEW' WHEN auc > 0.55 THEN 'KEEP' ELSE 'DROP' END AS verdict"
    " FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)",
)
def score_auc(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select(
        "elk_present", *[F.round(f"{n}_score", 12).alias(f"{n}_score") for n in ("elevation", "snow_conditions", "security_habitat")]
    )
    t = stats.auc_table(s, ["elevation_score", "snow_conditions_score", "security_habitat_score"])
    verdict = stats.keep_verdict(F.col("auc"), F.col("score") != "elevation_score")
    return rounded(t.withColumn("verdict", verdict), ["auc"])


@query(
    "median_classifier",
    "E15",
    cte("obs")
    + """
, m AS (SELECT quantile_cont(ndvi, 0.5) AS md FROM obs),
c AS (SELECT count(*) FILTER (ndvi >= md AND elk_present = 1) AS tp, count(*) FILTER (ndvi >= md AND elk_present <> 1) AS fp,
  count(*) FILTER (ndvi < md AND elk_present = 1) AS fn, count(*) FILTER (ndvi < md AND elk_present <> 1) AS tn FROM obs, m)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c
""",
)
def median_classifier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.median_classifier(view(spark, d, "obs"), "ndvi"), ["precision", "recall", "f1", "accuracy"])


@query(
    "class_imbalance",
    "E16",
    cte("obs")
    + """
, x AS (SELECT CASE WHEN obs_id % 7 = 0 THEN 1 ELSE 0 END AS y FROM obs), g AS (SELECT count(*) AS n FROM x GROUP BY y)
SELECT round(max(n) / min(n), 6) AS ratio, CASE WHEN max(n) / min(n) > 4 THEN 'severe' WHEN max(n) / min(n) > 2 THEN 'moderate' ELSE 'mild' END AS severity FROM g
""",
)
def class_imbalance(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(F.when(F.col("obs_id") % 7 == 0, 1).otherwise(0).alias("y"))
    return rounded(stats.imbalance_severity(o, "y"), ["ratio"])


@query(
    "presence_rate_by_month",
    "E17",
    cte("obs")
    + """
, r AS (SELECT month(date) AS period, avg(elk_present) AS rate, count(*) AS n FROM obs GROUP BY 1)
SELECT period, round(rate, 6) AS rate, n, row_number() OVER (ORDER BY rate DESC, period) = 1 AS is_peak,
  row_number() OVER (ORDER BY rate, period) = 1 AS is_low FROM r
""",
)
def presence_rate_by_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.presence_by_period(view(spark, d, "obs"), F.month("date")), ["rate"])


@query(
    "baseline_accuracy",
    "E18",
    cte("obs")
    + """
, m AS (SELECT quantile_cont(ndvi, 0.5) FILTER (elk_present = 1) AS m1, quantile_cont(ndvi, 0.5) FILTER (elk_present = 0) AS m0 FROM obs),
x AS (SELECT elk_present = 1 AS y, CAST(('0x' || substr(md5('42|baseline|' || obs_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.5 AS rnd,
  coalesce(CASE WHEN m1 >= m0 THEN ndvi > (m1 + m0) / 2 ELSE NOT (ndvi > (m1 + m0) / 2) END, false) AS one FROM obs, m)
SELECT 'random' AS baseline, round(count(*) FILTER (rnd = y) / count(*), 6) AS accuracy FROM x
UNION ALL SELECT 'majority', round(greatest(count(*) FILTER (y), count(*) FILTER (NOT y)) / count(*), 6) FROM x
UNION ALL SELECT 'single_feature', round(count(*) FILTER (one = y) / count(*), 6) FROM x
""",
)
def baseline_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.baselines(view(spark, d, "obs"), "ndvi", F.col("obs_id")), ["accuracy"])
