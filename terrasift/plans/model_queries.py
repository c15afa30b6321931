"""Classifier training, validation and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions.rng import hash_uniform
from terrasift.operators import models, sampling
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view

FEATURES = ["elevation_ft", "slope_degrees", "canopy_cover_percent", "water_distance_miles", "ndvi", "snow_depth_inches"]
GRID_SQL = "(SELECT unnest([4, 6, 8])::INT AS depth), (SELECT unnest([200, 300, 500])::INT AS rounds), (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS rate), (SELECT unnest([5, 10, 20])::DOUBLE AS least)"
REGION_SQL = "CASE WHEN longitude < -109 THEN CASE WHEN latitude >= 43.5 THEN 'northwest' ELSE 'southwest' END WHEN latitude >= 44 THEN 'northeast' ELSE 'southeast' END"

_P = "CAST(('0x' || substr(md5('7|p|' || obs_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_SCORED = f", s AS (SELECT obs_id, elk_present AS y, ({_P}) * 0.7 + elk_present * 0.2 AS p, year(date) AS year FROM obs)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "obs").select(
        "obs_id",
        "elk_present",
        (hash_uniform(7, "p", F.col("obs_id")) * 0.7 + F.col("elk_present") * 0.2).alias("p_present"),
        F.year("date").alias("year"),
    )


@query(
    "class_weight",
    "M2",
    cte("obs") + "SELECT round(count(*) FILTER (elk_present = 0) / count(*) FILTER (elk_present = 1), 6) AS class_weight FROM obs",
)
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.class_weight(view(spark, d, "obs")), ["class_weight"])


@query(
    "f1_threshold",
    "M3",
    cte("obs")
    + _SCORED
    + """
, t AS (SELECT i, (i / 100.0::DOUBLE) AS t FROM (SELECT unnest(range(10, 90)) AS i)),
c AS (SELECT t, 2 * count(*) FILTER (p >= t AND y = 1) / (count(*) FILTER (p >= t) + count(*) FILTER (y = 1)) AS f1 FROM s, t GROUP BY t)
SELECT t AS threshold, round(f1, 6) AS f1 FROM c ORDER BY c.f1 DESC, t LIMIT 1
""",
)
def f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.best_f1_threshold(_scored(spark, d), "p_present"), ["f1"])


@query(
    "temporal_split",
    "M4",
    cte("obs")
    + """
, s AS (SELECT year(date) AS year, elk_present, CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) BETWEEN 1999 AND 2000 THEN 'test' END AS split FROM obs)
SELECT split, year, count(*) AS n, count(*) FILTER (elk_present = 1) AS positive FROM s WHERE split IS NOT NULL GROUP BY 1, 2
""",
)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("year", F.year("date"))
    return models.split_counts(models.temporal_split(o, 1998, (1999, 2000)))


@query(
    "last_years_split",
    "M9",
    cte("obs")
    + """
, y AS (SELECT DISTINCT year(date) AS year FROM obs), r AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS k FROM y)
SELECT CASE WHEN k <= 2 THEN 'test' ELSE 'train' END AS split, r.year, count(*) AS n, count(*) FILTER (elk_present = 1) AS positive FROM obs JOIN r ON r.year = year(date) GROUP BY 1, 2
""",
)
def last_years_split(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("year", F.year("date"))
    return models.split_counts(models.last_years_split(o))


@query(
    "category_codes",
    "M8",
    cte("obs")
    + """
, x AS (SELECT obs_id, coalesce(CASE WHEN obs_id % 7 = 0 THEN NULL WHEN obs_id % 11 = 0 THEN 'zz_new' ELSE dataset END, 'unknown') AS v FROM obs),
l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM x WHERE v <> 'zz_new'))
SELECT obs_id, CAST(coalesce(code, 0) AS DOUBLE) AS dataset_code FROM x LEFT JOIN l USING (v)
""",
)
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("obs_id")
    o = view(spark, d, "obs").select(
        "obs_id", F.when(k % 7 == 0, None).when(k % 11 == 0, "zz_new").otherwise(F.col("dataset")).alias("dataset")
    )
    seen = o.filter(F.col("dataset").isNull() | (F.col("dataset") != "zz_new"))
    return models.CategoryCodes(["dataset"]).fit(seen).transform(o).select("obs_id", "dataset_code")


@query(
    "classifier_metrics",
    "M10 E14",
    cte("obs")
    + _SCORED
    + """
, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s),
a AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
   FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM s))
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(auc, 6) AS auc FROM c, a
""",
)
def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.evaluate(_scored(spark, d)), ["precision", "recall", "f1", "accuracy", "auc"])


@query(
    "train_test_gap",
    "M10",
    cte("obs")
    + _SCORED
    + """
, c AS (SELECT CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS split, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
   count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s GROUP BY 1),
m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c)
SELECT split, tp, fp, fn, tn, round(acc, 6) AS accuracy, round(max(acc) FILTER (split = 'train') OVER () - max(acc) FILTER (split = 'test') OVER (), 6) AS accuracy_gap FROM m
""",
)
def train_test_gap(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("split", F.when(F.col("year") <= 1999, "train").otherwise("test"))
    out = models.train_test_report(s).select("split", "tp", "fp", "fn", "tn", "accuracy", "accuracy_gap")
    return rounded(out, ["accuracy", "accuracy_gap"])


@query(
    "stratified_folds",
    "M11 T5",
    cte("obs")
    + """
, h AS (SELECT obs_id, elk_present, CAST((row_number() OVER (PARTITION BY elk_present ORDER BY md5('42|fold|' || obs_id)) - 1) % 5 AS INT) AS fold FROM obs)
SELECT fold, elk_present, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS key_sum FROM h GROUP BY 1, 2
""",
)
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    f = sampling.with_folds(view(spark, d, "obs"), "elk_present", ["obs_id"])
    return f.groupBy("fold", "elk_present").agg(F.count(F.lit(1)).alias("n"), F.sum("obs_id").alias("key_sum"))


@query(
    "scoring_inputs",
    "Q11 F6 H11",
    cte("obs")
    + """
, x AS (SELECT obs_id, month(date) AS m, CASE WHEN obs_id % 3 = 0 THEN 0.25 END AS s, ndvi FROM obs)
SELECT obs_id, round(coalesce(s, sin(2*pi()*(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], m) + 15)/365.25)), 6) AS day_of_year_sin,
  round(cos(2*pi()*(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], m) + 15)/365.25), 6) AS day_of_year_cos,
  round((CASE WHEN ndvi IS NULL THEN 1 ELSE 0 END + 1) / 4, 6) AS ml_missing_share FROM x
""",
)
def scoring_inputs(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select(
        "obs_id", F.month("date").alias("month"), F.when(F.col("obs_id") % 3 == 0, 0.25).alias("day_of_year_sin"), "ndvi"
    )
    filled = models.with_missing_share(models.fill_cyclic(o), ["day_of_year_sin", "day_of_year_cos", "ndvi", "temperature_f"])
    return rounded(
        filled.select("obs_id", "day_of_year_sin", "day_of_year_cos", "ml_missing_share"),
        ["day_of_year_sin", "day_of_year_cos", "ml_missing_share"],
    )


def _tested(*names: str):
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    proper = F.lit(True)
    for m in names:
        proper = proper & F.col(m).between(0, 1)
    return [(tp + fp + fn + tn).alias("tested"), (tp + fn).alias("positive"), proper.alias("proper")]


@query("region_validation", "M5")
def region_validation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.region_validation(view(spark, d, "obs"), FEATURES, ["obs_id"]), models.METRICS)


@query(
    "region_validation_rows",
    "M5",
    cte("obs")
    + f"SELECT {REGION_SQL} AS region, count(*) AS n, count(*) AS tested, count(*) FILTER (elk_present = 1) AS positive, true AS proper, true AS tuned FROM obs GROUP BY 1",
)
def region_validation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds chosen on a fifth of the training rows: every row of a region is tested once."""
    out = models.region_validation(view(spark, d, "obs"), FEATURES, ["obs_id"], threshold=None)
    return out.select("region", "n", *_tested(*models.METRICS), F.col("threshold").between(0.1, 0.89).alias("tuned"))


@query("feature_importance", "M6")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    model = models.final_model(view(spark, d, "obs"), FEATURES, ["obs_id"])
    return rounded(models.gain_importance(model, spark), ["importance"])


@query("fold_validation", "M11")
def fold_validation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.fold_validation(view(spark, d, "obs"), FEATURES, ["obs_id"], folds=5), models.METRICS)


@query(
    "fold_validation_rows",
    "M11",
    cte("obs")
    + """
, h AS (SELECT elk_present, CAST((row_number() OVER (PARTITION BY elk_present ORDER BY md5('42|fold|' || obs_id)) - 1) % 5 AS INT) AS fold FROM obs)
SELECT fold, count(*) AS tested, count(*) FILTER (elk_present = 1) AS positive, true AS proper FROM h GROUP BY 1
""",
)
def fold_validation_rows(spark: SparkSession, d: str) -> DataFrame:
    out = models.fold_validation(view(spark, d, "obs"), FEATURES, ["obs_id"], folds=5)
    return out.select("fold", *_tested(*models.METRICS))


@query("grid_search", "M7")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """All 81 points of the documented grid by weighted F1 of the held-out regions."""
    out = models.grid_search(view(spark, d, "obs"), FEATURES, ["obs_id"])
    return rounded(out, ["weighted_f1", "mean_f1", "mean_accuracy", "mean_auc", "weighted_accuracy"])


@query(
    "grid_search_points",
    "M7",
    cte("obs")
    + f"""
, s AS (SELECT least(count(*), 4000)::BIGINT AS n FROM obs)
SELECT depth, rounds, rate, least, n, true AS proper, true AS in_order FROM s, {GRID_SQL}
""",
)
def grid_search_points(spark: SparkSession, d: str) -> DataFrame:
    """Every point once, tested on all sampled rows, places by falling weighted F1 with ties in grid order."""
    out = models.grid_search(view(spark, d, "obs"), FEATURES, ["obs_id"])
    by_place = Window.orderBy("place")
    key = F.struct(-F.col("weighted_f1"), *[F.col(c) for c in models.SEARCH_GRID])
    in_order = F.coalesce(F.lag(key).over(by_place) <= key, F.lit(True))
    proper = F.col("weighted_f1").between(0, 1) & F.col("mean_auc").between(0, 1) & F.col("mean_accuracy").between(0, 1)
    return out.select(*models.SEARCH_GRID, "n", proper.alias("proper"), in_order.alias("in_order"))


def _refuge(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted on three datasets scores the rows of the fourth."""
    o = view(spark, d, "obs")
    model = models.final_model(o.filter("dataset <> 'refuge'"), FEATURES, ["obs_id"])
    return models.classify(o.filter("dataset = 'refuge'"), model)


@query("batch_classification", "Q10 M6")
def batch_classification(spark: SparkSession, d: str) -> DataFrame:
    out = _refuge(spark, d).select("obs_id", "predicted", "p_absent", "p_present", "confidence")
    return rounded(out, ["p_absent", "p_present", "confidence"])


@query(
    "classified_rows",
    "Q10",
    cte("obs") + "SELECT obs_id, true AS proper, true AS decided, true AS confident FROM obs WHERE dataset = 'refuge'",
)
def classified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row has two probabilities that add up to one, and the label and confidence that follow from them."""
    p, q = F.col("p_present"), F.col("p_absent")
    decided = F.col("predicted") == F.when(p >= 0.5, 1).otherwise(0)
    confident = (F.col("confidence") == F.greatest(p, q)) & F.col("confidence").between(0.5, 1)
    proper = p.between(0, 1) & (F.abs(p + q - 1) < 1e-12)
    return _refuge(spark, d).select("obs_id", proper.alias("proper"), decided.alias("decided"), confident.alias("confident"))
