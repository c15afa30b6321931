"""Training, validation and batch scoring of the presence classifier.

``fit`` and ``score`` train on all rows with Spark ML. Validation by region or fold fits on all rows
with ``blockfit``; the grid search and the final model use ``boosting``: fits on a bounded sample.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions.temporal import encode_month_day
from terrasift.operators import blockfit, boosting
from terrasift.operators.features import TARGET
from terrasift.operators.quantiles import bucket_of
from terrasift.operators.regions import with_region
from terrasift.operators.lineage import cut_lineage
from terrasift.operators.sampling import stratified_split, with_folds, with_group_rank
from terrasift.operators.stats import classifier_metrics, confusion, roc_auc
from terrasift.operators.summaries import count_if

# Booster settings and the searched grid.
DEFAULTS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "minInstancesPerNode": 10, "subsamplingRate": 0.8}
SEARCH_GRID = {"depth": [4, 6, 8], "rounds": [200, 300, 500], "rate": [0.01, 0.05, 0.1], "least": [5.0, 10.0, 20.0]}
SEARCH_SAMPLE = 4_000  # labelled rows that the fits of a grid search share
THRESHOLDS = [i / 100 for i in range(10, 90)]


def class_weight(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Negative-to-positive ratio, 1.0 without positives."""
    pos, neg = count_if(F.col(label) == 1), count_if(F.col(label) == 0)
    return df.agg(F.coalesce(neg / F.nullif(pos, F.lit(0)), F.lit(1.0)).alias("class_weight"))


def with_class_weight(df: DataFrame, label: str = TARGET, out: str = "weight") -> DataFrame:
    w = class_weight(df, label).first()["class_weight"]
    return df.withColumn(out, F.when(F.col(label) == 1, float(w)).otherwise(1.0))


def best_f1_threshold(scored: DataFrame, probability: str, label: str = TARGET) -> DataFrame:
    """(threshold, f1): first maximum over 0.10..0.89.

    Rows shrink to counts per threshold interval (81 of them) before thresholds are
    compared, so no row meets more than one threshold.
    """
    # a probability p passes every threshold t <= p: its bucket counts those thresholds
    below = bucket_of(-F.col(probability), [-t for t in reversed(THRESHOLDS)])
    passed = F.lit(len(THRESHOLDS)) - below
    counts = scored.groupBy(passed.alias("passed")).agg(
        count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg")
    )
    # one row per threshold index 1..80, also where no probability falls
    index = scored.sparkSession.range(1, len(THRESHOLDS) + 1).select(F.col("id").cast("int").alias("passed"))
    full = counts.join(index, "passed", "full").fillna(0)
    above = Window.orderBy(F.desc("passed"))
    whole = Window.partitionBy()
    tp, fp, total = F.sum("pos").over(above), F.sum("neg").over(above), F.sum("pos").over(whole)
    f1 = F.coalesce(2.0 * tp / F.nullif(tp + fp + total, F.lit(0)), F.lit(0.0))
    table = F.element_at(F.array(*[F.lit(t) for t in THRESHOLDS]), F.col("passed").cast("int"))
    curve = full.withColumn("f1", f1).filter(F.col("passed") >= 1).withColumn("threshold", table)
    best = curve.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    # without any positive hit the customary 0.5 stays
    return best.select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.col("b.f1").alias("f1")
    )


def temporal_split(df: DataFrame, train_until: int = 2016, test_years: tuple[int, int] = (2017, 2019), year: str = "year") -> DataFrame:
    """Adds ``split``; later years are dropped."""
    y = F.col(year)
    split = F.when(y <= train_until, "train").when(y.between(*test_years), "test")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def split_counts(df: DataFrame, label: str = TARGET, year: str = "year") -> DataFrame:
    return df.groupBy("split", year).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(label) == 1).alias("positive")
    )


def last_years_split(df: DataFrame, year: str = "year", last: int = 2) -> DataFrame:
    """Adds ``split``: the last ``last`` years test (one when there are too few)."""
    years = df.select(year).distinct()
    ranked = years.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(year)))).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy())
    )
    keep = F.when(F.col("_n") > last, last).otherwise(1)
    marked = ranked.select(year, F.when(F.col("_r") <= keep, "test").otherwise("train").alias("split"))
    return df.join(marked, year)


def random_split(df: DataFrame, key: list[str], label: str = TARGET, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    s = stratified_split(df, label, key, 1 - test_share, seed)
    return s.withColumn("split", F.when(F.col("is_train"), "train").otherwise("test")).drop("is_train")


class CategoryCodes:
    """Alphabetic category codes; null counts as ``unknown``, unseen values as the first.

    Codes are tables of the distinct values, joined to the rows; no list of labels is collected.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.codes: dict[str, DataFrame] = {}

    @staticmethod
    def _filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))

    def fit(self, df: DataFrame) -> CategoryCodes:
        for c in self.columns:
            labels = df.select(self._filled(c).alias("_label")).distinct()
            ranked = with_group_rank(labels, [], F.substring("_label", 1, 2), [F.col("_label")])
            self.codes[c] = cut_lineage(ranked.select("_label", (F.col("rank") - 1).cast("double").alias(f"{c}_code")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            out = out.withColumn("_label", self._filled(c)).join(self.codes[c], "_label", "left").drop("_label")
            out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0.0)))
        return out


def fill_cyclic(df: DataFrame) -> DataFrame:
    """Day-of-year pair from month (and day, 15 when absent) where it is missing."""
    if "month" not in df.columns:
        return df
    s, c = encode_month_day(F.col("month"), F.col("day") if "day" in df.columns else None)
    new = {}
    for name, value in (("day_of_year_sin", s), ("day_of_year_cos", c)):
        new[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(new)


def missing_features(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def with_missing_share(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Share of wanted features that are absent or null per row."""
    gone = [F.lit(1) if c not in df.columns else F.when(F.col(c).isNull(), 1).otherwise(0) for c in wanted]
    return df.withColumn("ml_missing_share", reduce(lambda a, b: a + b, gone) / len(wanted))


def build_classifier(features: list[str], label: str = TARGET, weight: str | None = "weight", seed: int = 42, **params) -> Pipeline:
    """Median imputation, assembly and gradient-boosted trees."""
    settings = {**DEFAULTS, **params}
    imputed = [f"{c}_filled" for c in features]
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, maxBins=64, **settings)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=imputed),
            VectorAssembler(inputCols=imputed, outputCol="features"),
            gbt,
        ]
    )


def _doubles(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in [*features, label]})


def fit(df: DataFrame, features: list[str], label: str = TARGET, **params) -> PipelineModel:
    rows = with_class_weight(_doubles(df, features, label), label)
    return build_classifier(features, label, **params).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: list[str], threshold: float = 0.5, label: str = TARGET) -> DataFrame:
    """Adds p_absent, p_present, prediction label and confidence (the larger probability)."""
    cast = df.withColumns({c: F.col(c).cast("double") for c in features})
    out = model.transform(cast)
    p = vector_to_array("probability")
    keep = df.columns
    return out.select(*keep, p[0].alias("p_absent"), p[1].alias("p_present")).withColumns(
        {
            "predicted": F.when(F.col("p_present") >= threshold, 1).otherwise(0),
            "confidence": F.greatest("p_absent", "p_present"),
        }
    )


def evaluate(scored: DataFrame, probability: str = "p_present", label: str = TARGET, threshold: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 and AUC."""
    predicted = F.col(probability) >= threshold
    counts = classifier_metrics(confusion(scored, predicted, F.col(label) == 1))
    return counts.withColumn("auc", roc_auc(scored, probability, label).select("auc").scalar())


def train_test_report(scored: DataFrame, probability: str = "p_present", label: str = TARGET, threshold: float = 0.5) -> DataFrame:
    """Metrics per split and the accuracy gap between train and test."""
    predicted, actual = F.col(probability) >= threshold, F.col(label) == 1
    m = classifier_metrics(confusion(scored, predicted, actual, ["split"]))
    gap = F.max(F.when(F.col("split") == "train", F.col("accuracy"))).over(Window.partitionBy()) - F.max(
        F.when(F.col("split") == "test", F.col("accuracy"))
    ).over(Window.partitionBy())
    return m.withColumn("accuracy_gap", gap)


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def _held_out_models(rows: DataFrame, features: list[str], key: list[str], label: str, group: str, jobs: list[dict], sample: int | None) -> list[dict]:
    """A model for each job, fitted on all rows outside its held-out group, or on those among ``sample`` rows."""
    if sample is None:
        return blockfit.fitted_on_all(rows, features, label, key, F.col(group), jobs)
    return boosting.fitted(rows.sparkSession, boosting.labelled_sample(rows, features, label, key, F.col(group), sample), jobs)


def region_validation(
    df: DataFrame, features: list[str], key: list[str], label: str = TARGET, threshold: float | None = 0.5, sample: int | None = None, **settings
) -> DataFrame:
    """Leave-one-region-out metrics per held-out region; ``threshold`` None: chosen for each region.

    The regions' models are fitted side by side, each on all rows of the other regions (or, if
    asked for, on those among a ``sample``); the metrics are those of all rows of the region.
    """
    rows = with_region(_doubles(df, features, label)).filter(F.col(label).isNotNull())
    names = sorted(r["region"] for r in rows.select("region").distinct().collect())  # at most four labels
    jobs = [boosting.job(n, tune=threshold is None, **settings) for n in names]
    models = dict(zip(names, _held_out_models(rows, features, key, label, "region", jobs, sample)))
    # every metric below reads the scores: they are computed once
    scored = cut_lineage(boosting.with_probability(rows, models, F.col("region")).select("region", label, "p_present"))
    parts = []
    for name in names:
        cut = models[name]["threshold"] if threshold is None else threshold
        m = evaluate(scored.filter(F.col("region") == name), label=label, threshold=cut)
        n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
        parts.append(m.select(F.lit(name).alias("region"), n.alias("n"), F.lit(cut).alias("threshold"), "tp", "fp", "fn", "tn", *METRICS))
    return reduce(lambda a, b: a.unionByName(b), parts)


METRICS = ["accuracy", "precision", "recall", "f1", "auc"]


def summarise_validation(per_region: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and size-weighted mean of each metric."""
    n = F.col("n")
    return per_region.groupBy(*(by or [])).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        *[(F.sum(F.col(m) * n) / F.sum(n)).alias(f"weighted_{m}") for m in METRICS],
        F.sum("n").alias("n"),
    )


def fold_validation(
    df: DataFrame, features: list[str], key: list[str], label: str = TARGET, folds: int = 5, seed: int = 42, sample: int | None = None, **settings
) -> DataFrame:
    """Stratified k-fold metrics, one row per fold, of all its rows; fits on all rows of the other folds, or on those among a ``sample``."""
    rows = cut_lineage(with_folds(_doubles(df, features, label).filter(F.col(label).isNotNull()).select(*dict.fromkeys([*key, *features, label])), label, key, folds, seed))
    names = [str(k) for k in range(folds)]
    jobs = [boosting.job(k, **settings) for k in names]
    models = dict(zip(names, _held_out_models(rows, features, key, label, "fold", jobs, sample)))
    scored = cut_lineage(boosting.with_probability(rows, models, F.col("fold")).select("fold", label, "p_present"))
    parts = []
    for k in range(folds):
        m = evaluate(scored.filter(F.col("fold") == k), label=label)
        parts.append(m.select(F.lit(k).alias("fold"), "tp", "fp", "fn", "tn", *METRICS))
    return reduce(lambda a, b: a.unionByName(b), parts)


def final_model(df: DataFrame, features: list[str], key: list[str], label: str = TARGET, sample: int = boosting.SAMPLE, **settings) -> dict:
    """The classifier fitted on at most ``sample`` labelled rows of all regions."""
    drawn = boosting.labelled_sample(df, features, label, key, None, sample)
    return boosting.fitted(df.sparkSession, drawn, [boosting.job(None, **settings)])[0]


def gain_importance(model: dict, spark) -> DataFrame:
    """Average gain of each feature's splits, as shares of their sum."""
    gain = model["trees"].gain
    share = gain / gain.sum() if gain.sum() else gain
    return spark.createDataFrame(list(zip(model["features"], map(float, share))), "feature string, importance double")


def classify(df: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Adds p_absent, p_present, the predicted label and the confidence, the larger probability."""
    out = boosting.with_probability(df, {None: model}).withColumn("p_absent", 1 - F.col("p_present"))
    hit = F.when(F.col("p_present") >= threshold, 1).otherwise(0)
    return out.withColumns({"predicted": hit, "confidence": F.greatest("p_absent", "p_present")})


def grid_search(
    df: DataFrame, features: list[str], key: list[str], label: str = TARGET, grid: dict[str, list] | None = None, sample: int = SEARCH_SAMPLE, **settings
) -> DataFrame:
    """Region validation at every point of the grid, best weighted F1 first, with its ``place``.

    All fits run at once, one task each, on at most ``sample`` labelled rows; points that differ
    only in rounds share a fit. Metrics are those of the sampled rows of the held-out region.
    """
    spark = df.sparkSession
    grid = grid or SEARCH_GRID
    rows = with_region(_doubles(df, features, label))
    drawn = boosting.labelled_sample(rows, features, label, key, F.col("region"), sample)
    names = sorted(set(drawn.group))
    others = [n for n in grid if n != "rounds"]
    points = list(itertools.product(*(grid[n] for n in others)))
    jobs = [boosting.job(region, stages=grid["rounds"], **{**settings, **dict(zip(others, p)), "rounds": max(grid["rounds"])}) for p in points for region in names]
    counts = boosting.held_out_counts(spark, drawn, jobs)
    point = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], T.StructType([T.StructField("point", T.LongType()), *(_number(n, grid[n]) for n in others)]))
    measured = classifier_metrics(counts.withColumn("point", F.expr(f"job div {max(len(names), 1)}")))
    measured = measured.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    out = summarise_validation(measured, ["point", "rounds"]).join(point, "point")
    best = Window.orderBy(F.desc("weighted_f1"), *grid)  # as many rows as the grid has points
    shown = ["weighted_f1", "mean_f1", "mean_accuracy", "mean_auc", "weighted_accuracy"]
    return out.select(*grid, "n", *shown, F.row_number().over(best).alias("place")).orderBy("place")


def _number(name: str, values: list) -> T.StructField:
    return T.StructField(name, T.DoubleType() if any(isinstance(v, float) for v in values) else T.IntegerType())
