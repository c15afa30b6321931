"""Habitat factor scores and their aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import rng, scores, vegetation
from terrasift.plans.registry import query
from terrasift.plans.scoring_sql import FACTOR_CTES, FACTOR_NAMES, LONG_CTES, RUT_STATUS, SHORT
from terrasift.sources.surrogates import cte, view

AS_OF = "2001-06-01"
OPTIONS = {"seasons_every_year": True}

# Null NDVI takes its month default, as the assembled context does; every observation
# gets a synthetic winter index here, the real series is joined in winter_index.
_X = """
, x AS (SELECT * REPLACE (coalesce(ndvi, CASE WHEN month(date) IN (6,7,8) THEN 0.70 WHEN month(date) IN (9,10) THEN 0.55
   WHEN month(date) IN (11,12,1,2,3) THEN 0.30 ELSE 0.50 END::DOUBLE) AS ndvi), DATE '2001-06-01' AS as_of,
   CAST(obs_id * 97 % 9000 AS DOUBLE) AS wsi FROM obs),
"""


def scoring_input(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").withColumns(
        {
            "ndvi": F.coalesce("ndvi", vegetation.ndvi_month_default(F.month("date"))),
            "winter_severity_index": (F.col("obs_id") * 97 % 9000).cast("double"),
        }
    )


def with_all_factors(df: DataFrame, method: str = "additive", **kw) -> DataFrame:
    return scores.score_habitat(
        df, method=method, as_of=F.lit(AS_OF).cast("date"), options=OPTIONS, **kw
    )


@query(
    "factor_scores",
    "H1 H2 H3 H4 H5 H6 H7 H8 H9 H10",
    cte("obs")
    + _X
    + FACTOR_CTES
    + "SELECT obs_id, "
    + ", ".join(f"round(CAST({s}_s AS DOUBLE), 6) AS {n}_score" for s, n in zip(SHORT, FACTOR_NAMES))
    + " FROM scored",
)
def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    out = scores.with_scores(
        scoring_input(spark, d), as_of=F.lit(AS_OF).cast("date"), options=OPTIONS
    )
    return out.select("obs_id", *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in FACTOR_NAMES])


@query(
    "factor_status",
    "H1 H2 H3 H4 H5 H6 H7 H8 H9 H10 F26",
    cte("obs")
    + _X
    + FACTOR_CTES
    + "SELECT obs_id, "
    + ", ".join(f"{RUT_STATUS if s == 'rut' else s + '_st'} AS {n}_status" for s, n in zip(SHORT, FACTOR_NAMES))
    + ", snow_c AS snow_conditions_confidence, water_c AS water_distance_confidence,"
    " round(vegetation_c, 6) AS vegetation_quality_confidence, nutrition_c AS nutritional_condition_confidence,"
    " winter_c AS winter_severity_confidence, rut_c AS rut_behavior_confidence FROM scored",
)
def factor_status(spark: SparkSession, d: str) -> DataFrame:
    out = scores.with_scores(
        scoring_input(spark, d), as_of=F.lit(AS_OF).cast("date"), options=OPTIONS, fields=("status", "confidence")
    )
    varying = [
        "snow_conditions", "water_distance", "vegetation_quality",
        "nutritional_condition", "winter_severity", "rut_behavior",
    ]
    return out.select(
        "obs_id",
        *[f"{n}_status" for n in FACTOR_NAMES],
        *[F.round(f"{n}_confidence", 6).alias(f"{n}_confidence") for n in varying],
    )


@query(
    "habitat_additive",
    "H12 H14 H15",
    cte("obs")
    + _X
    + FACTOR_CTES
    + ", "
    + LONG_CTES
    + """
SELECT obs_id, round(total_score, 6) AS total_score, round(overall_confidence, 6) AS overall_confidence, limiting_factor, best_factor,
  CASE WHEN total_score >= 80 THEN 'excellent' WHEN total_score >= 65 THEN 'good' WHEN total_score >= 50 THEN 'fair' ELSE 'poor' END AS habitat_quality,
  round(elevation_s / nullif(total_score, 0) * 100, 6) AS elevation_contribution_pct
FROM totals JOIN scored USING (obs_id)
""",
)
def habitat_additive(spark: SparkSession, d: str) -> DataFrame:
    return with_all_factors(scoring_input(spark, d)).select(
        "obs_id",
        F.round("total_score", 6).alias("total_score"),
        F.round("overall_confidence", 6).alias("overall_confidence"),
        "limiting_factor",
        "best_factor",
        "habitat_quality",
        F.round(
            F.col("elevation_score") / F.nullif(F.col("total_score"), F.lit(0.0)) * 100, 6
        ).alias("elevation_contribution_pct"),
    )


@query(
    "habitat_multiplicative",
    "H13",
    cte("obs")
    + _X
    + FACTOR_CTES
    + ", "
    + LONG_CTES
    + """
SELECT obs_id, round(product_score, 6) AS total_score,
  CASE WHEN product_score >= 80 THEN 'excellent' WHEN product_score >= 65 THEN 'good' WHEN product_score >= 50 THEN 'fair' ELSE 'poor' END AS habitat_quality
FROM totals
""",
)
def habitat_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return with_all_factors(scoring_input(spark, d), "multiplicative").select(
        "obs_id", F.round("total_score", 6).alias("total_score"), "habitat_quality"
    )


@query(
    "habitat_ranking",
    "H1 H3 H5 H6 H12 H15 W1",
    cte("obs")
    + _X
    + FACTOR_CTES
    + """
, t AS (SELECT month(date) AS month, dataset, 100*(elevation_s + water_s + hunting_s + security_s)/40 AS total FROM scored),
g AS (SELECT month, dataset, count(*) AS n, round(avg(total), 6) AS mean_score,
  count(*) FILTER (total >= 80) AS n_excellent, count(*) FILTER (total >= 65 AND total < 80) AS n_good,
  count(*) FILTER (total >= 50 AND total < 65) AS n_fair, count(*) FILTER (total < 50) AS n_poor FROM t GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY mean_score DESC, month, dataset) AS rank FROM g
""",
)
def habitat_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: score every observation, then rank month-by-dataset groups.

    The final window runs over at most 12 months times the number of datasets.
    """
    from pyspark.sql import Window

    names = ["elevation", "water_distance", "hunting_pressure", "security_habitat"]
    flat = scores.with_scores(view(spark, d, "obs"), names, as_of=F.lit(AS_OF).cast("date"), options=OPTIONS)
    total = sum((F.col(f"{n}_score") for n in names[1:]), F.col(f"{names[0]}_score")) / 40 * 100
    t = flat.select(F.month("date").alias("month"), "dataset", total.alias("total"))
    klass = scores.habitat_class(F.col("total"))
    g = t.groupBy("month", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("total"), 6).alias("mean_score"),
        *[F.count(F.when(klass == k, 1)).alias(f"n_{k}") for k in ("excellent", "good", "fair", "poor")],
    )
    return g.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), "month", "dataset"))
    )


@query(
    "model_factor",
    "H11 F25",
    cte("obs")
    + """
, a AS (SELECT obs_id, CAST(('0x' || substr(md5('7|p|' || obs_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS p,
  CAST(obs_id % 5 AS DOUBLE) / 10 AS miss, security_habitat_percent AS pct FROM obs),
b AS (SELECT *, miss > 0.3 AS bad, abs(p - 0.5) * 2 * CASE WHEN miss > 0 THEN 1 - miss ELSE 1 END AS c FROM a)
SELECT obs_id, round(CASE WHEN bad THEN 5 ELSE p * 10 END, 6) AS score, round(CASE WHEN bad THEN 0.1 ELSE c END, 6) AS confidence,
  CASE WHEN bad OR c < 0.2 THEN 'fair' WHEN p >= 0.7 THEN 'excellent' WHEN p >= 0.5 THEN 'good' WHEN p >= 0.3 THEN 'fair'
       WHEN p >= 0.15 THEN 'poor' ELSE 'critical' END AS status,
  round(CASE WHEN pct <= 20 THEN 0 WHEN pct >= 80 THEN 1 ELSE (pct - 20) / 60 END * 10, 6) AS normalized,
  round((1 - CASE WHEN pct <= 20 THEN 0 WHEN pct >= 80 THEN 1 ELSE (pct - 20) / 60 END) * 10, 6) AS normalized_inverse
FROM b
""",
)
def model_factor(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumns(
        {
            "ml_probability": rng.hash_uniform(7, "p", F.col("obs_id")),
            "ml_missing_share": (F.col("obs_id") % 5).cast("double") / 10,
        }
    )
    o = scores.with_scores(o, ["ml_prediction"], fields=scores.FIELDS)
    pct = F.col("security_habitat_percent")
    return o.select(
        "obs_id",
        F.round("ml_prediction_score", 6).alias("score"),
        F.round("ml_prediction_confidence", 6).alias("confidence"),
        F.col("ml_prediction_status").alias("status"),
        F.round(scores.normalize_score(pct, 20, 80), 6).alias("normalized"),
        F.round(scores.normalize_score(pct, 20, 80, inverse=True), 6).alias("normalized_inverse"),
    )
