"""Effect sizes, correlations, moments, tests and classifier statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.quantiles import average_ranks, exact_quantiles
from terrasift.operators.summaries import count_if, per_column


def _d(c: Column) -> Column:
    return c.cast("double")


def two_group_stats(
    df: DataFrame, columns: list[str], in_first: Column, in_second: Column, by: list[str] | None = None
) -> DataFrame:
    """Counts, means and sample deviations of two groups per feature, in one pass."""
    metrics = {}
    for tag, cond in (("1", in_first), ("2", in_second)):
        metrics[f"n{tag}"] = lambda c, k=cond: F.count(F.when(k, c))
        metrics[f"mean{tag}"] = lambda c, k=cond: F.avg(F.when(k, _d(c)))
        metrics[f"std{tag}"] = lambda c, k=cond: F.stddev_samp(F.when(k, _d(c)))
    return per_column(df, columns, metrics, by)


def cohens_d_pooled() -> Column:
    """Weighted by group sizes; 0 when the pooled deviation is 0."""
    n1, n2 = F.col("n1"), F.col("n2")
    var = ((n1 - 1) * F.pow("std1", F.lit(2)) + (n2 - 1) * F.pow("std2", F.lit(2))) / F.nullif(
        n1 + n2 - 2, F.lit(0)
    )
    sd = F.sqrt(var)
    return F.when(sd == 0, 0.0).otherwise((F.col("mean1") - F.col("mean2")) / F.nullif(sd, F.lit(0.0)))


def cohens_d_simple() -> Column:
    sd = F.sqrt((F.pow("std1", F.lit(2)) + F.pow("std2", F.lit(2))) / 2)
    return F.when(sd == 0, 0.0).otherwise((F.col("mean1") - F.col("mean2")) / F.nullif(sd, F.lit(0.0)))


def effect_sizes(
    df: DataFrame, columns: list[str], in_first: Column, in_second: Column, by: list[str] | None = None, pooled: bool = True
) -> DataFrame:
    """Means, deviations, difference, relative difference and Cohen's d per feature."""
    out = two_group_stats(df, columns, in_first, in_second, by)
    diff = F.col("mean1") - F.col("mean2")
    pct = F.when(F.col("mean2") == 0, 0.0).otherwise(diff / F.nullif(F.abs("mean2"), F.lit(0.0)) * 100)
    d = cohens_d_pooled() if pooled else cohens_d_simple()
    return out.withColumns({"diff": diff, "diff_pct": pct, "cohens_d": d})


def presence_effects(df: DataFrame, columns: list[str], label: str = "elk_present", **kw) -> DataFrame:
    return effect_sizes(df, columns, F.col(label) == 1, F.col(label) == 0, **kw)


def top_effects(effects: DataFrame, n: int) -> DataFrame:
    return effects.orderBy(F.desc(F.abs("cohens_d")), "feature").limit(n)


def t_statistics(stats: DataFrame, equal_var: bool = True) -> DataFrame:
    """Adds ``t`` and ``dof`` to a two-group table (Student or Welch)."""
    n1, n2, s1, s2 = F.col("n1"), F.col("n2"), F.col("std1"), F.col("std2")
    if equal_var:
        pooled = ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)
        se = F.sqrt(pooled * (1 / n1 + 1 / n2))
        dof = (n1 + n2 - 2).cast("double")
    else:
        v1, v2 = s1 * s1 / n1, s2 * s2 / n2
        se = F.sqrt(v1 + v2)
        dof = (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))
    return stats.withColumns({"t": (F.col("mean1") - F.col("mean2")) / F.nullif(se, F.lit(0.0)), "dof": dof})


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def student_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or dof is None or math.isnan(t) or math.isnan(dof):
        return float("nan")
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def with_p_values(stats: DataFrame, alpha: float = 0.01) -> DataFrame:
    """p-values for the k-row result table (one Arrow batch, not the data)."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, b) for a, b in zip(t, dof)])

    return stats.withColumn("p_value", p_value("t", "dof")).withColumn("significant", F.col("p_value") < alpha)


def correlation_long(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature_a, feature_b, r) for a < b, pairwise-complete, in one pass."""
    by = by or []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.groupBy(*by).agg(*[F.corr(_d(F.col(a)), _d(F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*by, F.inline(rows))


def correlated_pairs(corr: DataFrame, cut: float = 0.8) -> DataFrame:
    return corr.filter(F.abs("r") > cut).orderBy(F.desc(F.abs("r")))


def target_correlation(df: DataFrame, columns: list[str], target: str = "elk_present") -> DataFrame:
    return per_column(df, columns, {"r": lambda c: F.corr(_d(c), _d(F.col(target)))})


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """VIF per feature without intercept over complete cases.

    The k x k Gram matrix is aggregated by Spark; only its k(k+1)/2 sums are inverted
    on the driver.
    """
    complete = df.select(*[_d(F.col(c)).alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = complete.agg(
        *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]
    ).first()
    gram = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    inverse = np.linalg.pinv(gram / np.outer(scale, scale))
    # uncentred R^2 of column i on the others is 1 - 1 / (G_ii * inv(G)_ii)
    data = [(c, float(inverse[i, i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(data, "feature string, vif double")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, variance and Jarque-Bera.

    Two passes of plain sums: the means (one fetched row), then powers of the centred
    values. That is as stable as a one-pass moment update and far cheaper per row.
    """
    first = df.agg(*[F.avg(_d(F.col(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    centre = {c: first[f"c{i}"] or 0.0 for i, c in enumerate(columns)}
    centred = df.select(*[(_d(F.col(c)) - centre[c]).alias(c) for c in columns])
    base = per_column(
        centred,
        columns,
        {
            "n": lambda c: F.count(c).cast("double"),
            "s1": lambda c: F.sum(c),
            "s2": lambda c: F.sum(c * c),
            "s3": lambda c: F.sum(c * c * c),
            "s4": lambda c: F.sum(c * c * c * c),
        },
    )
    n = F.col("n")
    size = F.nullif(n, F.lit(0.0))
    # the centre is the mean up to rounding; the remaining shift is removed exactly
    shift = F.col("s1") / size
    base = base.withColumn("d", shift).withColumns(
        {
            "m2": F.col("s2") / size - F.col("d") * F.col("d"),
            "m3": F.col("s3") / size - 3 * F.col("d") * F.col("s2") / size + 2 * F.pow("d", F.lit(3)),
            "m4": F.col("s4") / size - 4 * F.col("d") * F.col("s3") / size
            + 6 * F.col("d") * F.col("d") * F.col("s2") / size - 3 * F.pow("d", F.lit(4)),
        }
    )
    m2 = F.nullif(F.col("m2"), F.lit(0.0))
    base = base.withColumns({"g1": F.col("m3") / F.pow(m2, F.lit(1.5)), "g2": F.col("m4") / (m2 * m2) - 3.0})
    g1, g2 = F.col("g1"), F.col("g2")
    return base.select(
        "feature",
        n.cast("bigint").alias("n"),
        F.when(n > 1, F.col("m2") * n / F.nullif(n - 1, F.lit(0.0))).alias("variance"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skewness"),
        F.when(
            n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
        ).alias("kurtosis"),
        (n / 6 * (g1 * g1 + g2 * g2 / 4)).alias("jarque_bera"),
    )


JARQUE_BERA_5PCT = 5.991464547107979


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jarque-Bera against the 5 % point of chi-square with two degrees of freedom."""
    return moments(df, columns).withColumn("normal", F.col("jarque_bera") < JARQUE_BERA_5PCT)


def top_variance(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    return per_column(df, columns, {"variance": lambda c: F.var_samp(_d(c))}).orderBy(
        F.desc("variance"), "feature"
    ).limit(k)


def kernel_density(df: DataFrame, column: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """Gaussian density on ``points`` grid values by linear binning.

    The data shrink to at most ``8 * points`` cell centres with mean positions before
    any cell meets the grid, so the pairing is bounded whatever the input size.
    """
    cells = 8 * points
    c = _d(F.col(column))
    s = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.stddev_samp(c).alias("sd"), F.count(c).alias("n")).first()
    lo, hi, n = s["lo"], s["hi"], s["n"]
    h = bandwidth or s["sd"] * n ** (-0.2)
    cell = F.least(F.floor((c - lo) / ((hi - lo) or 1.0) * cells), F.lit(cells - 1))
    binned = df.filter(c.isNotNull()).groupBy(cell.alias("cell")).agg(F.count(c).alias("k"), F.avg(c).alias("at"))
    step = (hi - lo) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = F.lit(lo) + F.col("i") * step
    weight = F.exp(-F.pow((x - F.col("at")) / h, F.lit(2)) / 2) * F.col("k")
    return (
        binned.select("k", "at", grid)
        .groupBy("i")
        .agg((F.sum(weight) / (n * h * math.sqrt(2 * math.pi))).alias("density"))
        .select("i", (F.lit(lo) + F.col("i") * step).alias("x"), "density")
    )


def feature_summary(df: DataFrame, columns: list[str], label: str = "elk_present") -> DataFrame:
    """Moments, normality and class discrimination side by side, k rows per side."""
    d = presence_effects(df, columns, label, pooled=False).select("feature", "mean1", "mean2", "cohens_d")
    return normality(df, columns).join(d, "feature")


def linear_check(df: DataFrame, pairs: list[tuple[str, str]], cut: float = 0.5) -> DataFrame:
    """(score, source, r, slope, intercept, passed) for score/source column pairs."""
    aggs = []
    for i, (y, x) in enumerate(pairs):
        yc, xc = _d(F.col(y)), _d(F.col(x))
        aggs += [
            F.corr(yc, xc).alias(f"r{i}"),
            F.regr_slope(yc, xc).alias(f"s{i}"),
            F.regr_intercept(yc, xc).alias(f"b{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(y).alias("score"),
                F.lit(x).alias("source"),
                F.col(f"r{i}").alias("r"),
                F.col(f"s{i}").alias("slope"),
                F.col(f"b{i}").alias("intercept"),
                (F.abs(F.col(f"r{i}")) > cut).alias("passed"),
            )
            for i, (y, x) in enumerate(pairs)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def roc_auc(df: DataFrame, score: str, label: str = "elk_present") -> DataFrame:
    """Rank-sum AUC with average ranks for ties; one row per distinct score is ranked."""
    ranked = average_ranks(
        df.filter(F.col(label).isNotNull()), score, {"pos": F.when(F.col(label) == 1, 1).otherwise(0)}
    )
    pos, n = F.sum("pos"), F.sum("n")
    u = F.sum(F.col("avg_rank") * F.col("pos")) - pos * (pos + 1) / 2.0
    return ranked.agg(F.lit(score).alias("score"), (u / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"))


def auc_table(df: DataFrame, scores: list[str], label: str = "elk_present") -> DataFrame:
    out = roc_auc(df, scores[0], label)
    for s in scores[1:]:
        out = out.unionByName(roc_auc(df, s, label))
    return out


def keep_verdict(auc: Column, source_ok: Column, cut: float = 0.55) -> Column:
    return F.when(~source_ok, "REVIEW").when(auc > cut, "KEEP").otherwise("DROP")


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        count_if(predicted & actual).alias("tp"),
        count_if(predicted & ~actual).alias("fp"),
        count_if(~predicted & actual).alias("fn"),
        count_if(~predicted & ~actual).alias("tn"),
    )


def classifier_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def median_classifier(df: DataFrame, score: str, label: str = "elk_present") -> DataFrame:
    """Score at or above its median predicts presence; the median is one fetched double."""
    median = exact_quantiles(df, [score], [0.5]).first()["value"]
    known = df.filter(F.col(score).isNotNull())
    return classifier_metrics(confusion(known, F.col(score) >= median, F.col(label) == 1))


def imbalance_severity(df: DataFrame, label: str = "elk_present") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.min("n")
    return counts.agg(ratio.alias("ratio")).withColumn(
        "severity", F.when(F.col("ratio") > 4, "severe").when(F.col("ratio") > 2, "moderate").otherwise("mild")
    )


def presence_by_period(df: DataFrame, period: Column, label: str = "elk_present") -> DataFrame:
    """Rate per period with flags on the peak and the low period."""
    rates = df.groupBy(period.alias("period")).agg(
        F.avg(_d(F.col(label))).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy()  # at most a few hundred periods
    peak = F.max_by("period", F.struct("rate", -F.col("period"))).over(whole)
    low = F.min_by("period", F.struct("rate", "period")).over(whole)
    return rates.withColumns({"is_peak": F.col("period") == peak, "is_low": F.col("period") == low})


def baselines(df: DataFrame, feature: str, key: Column, label: str = "elk_present", seed: int = 42) -> DataFrame:
    """Accuracy of random, majority and single-feature rules in one pass after medians."""
    from terrasift.functions.rng import hash_uniform

    med = {
        r[label]: r["value"]
        for r in exact_quantiles(df.filter(F.col(label).isin(0, 1)), [feature], [0.5], by=[label]).collect()
    }
    cut = (med[1] + med[0]) / 2
    above = F.col(feature) > cut
    predicted = above if med[1] >= med[0] else ~above
    y = F.col(label) == 1
    random = hash_uniform(seed, "baseline", key) < 0.5
    total = F.count(F.lit(1))
    agg = df.agg(
        (count_if(random == y) / total).alias("random"),
        (F.greatest(count_if(y), count_if(~y)) / total).alias("majority"),
        (count_if(F.coalesce(predicted, F.lit(False)) == y) / total).alias("single_feature"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("accuracy")) for n in ("random", "majority", "single_feature")])
    return agg.select(F.inline(rows))
