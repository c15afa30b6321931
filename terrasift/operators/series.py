"""Monthly series: rolling means, autocorrelation, profile scaling, ranks of days."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_means(df: DataFrame, columns: list[str], date_col: str = "date") -> DataFrame:
    """(feature, year, month, mean): a few hundred rows per feature whatever the input."""
    by = df.groupBy(F.year(date_col).alias("year"), F.month(date_col).alias("month")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in columns])
    return by.select("year", "month", F.inline(rows))


def rolling_mean(monthly: DataFrame, width: int = 3) -> DataFrame:
    """Centred rolling mean; null unless all ``width`` months are present."""
    half = width // 2
    w = Window.partitionBy("feature").orderBy("year", "month").rowsBetween(-half, half)
    full = F.count("mean").over(w) == width
    return monthly.withColumn("rolling", F.when(full, F.avg("mean").over(w)))


def autocorrelation(monthly: DataFrame, max_lag: int = 40) -> DataFrame:
    """(feature, lag, acf) with the biased denominator, by joining positions to lags."""
    w = Window.partitionBy("feature")
    pos = F.row_number().over(w.orderBy("year", "month"))
    s = monthly.filter(F.col("mean").isNotNull()).select(
        "feature", pos.alias("t"), (F.col("mean") - F.avg("mean").over(w)).alias("dev")
    )
    var = s.groupBy("feature").agg(F.sum(F.col("dev") * F.col("dev")).alias("var"))
    lags = s.select("feature", "dev", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "t")
    shifted = lags.select("feature", "lag", (F.col("t") + F.col("lag")).alias("t"), F.col("dev").alias("prior"))
    pairs = shifted.join(s, ["feature", "t"])
    sums = pairs.groupBy("feature", "lag").agg(F.sum(F.col("dev") * F.col("prior")).alias("cross"))
    return sums.join(var, "feature").select(
        "feature", "lag", (F.col("cross") / F.nullif(F.col("var"), F.lit(0.0))).alias("acf")
    )


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Durbin-Levinson recursion per feature over at most max_lag + 1 values."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].tolist()
        out, phi = [1.0], []
        for k in range(1, len(r)):
            num = r[k] - sum(phi[j] * r[k - 1 - j] for j in range(k - 1))
            den = 1.0 - sum(phi[j] * r[j + 1] for j in range(k - 1))
            last = num / den if den else float("nan")
            phi = [phi[j] - last * phi[k - 2 - j] for j in range(k - 1)] + [last]
            out.append(last)
        return pd.DataFrame({"feature": pdf["feature"], "lag": pdf["lag"], "pacf": out})

    return acf.groupBy("feature").applyInPandas(solve, "feature string, lag int, pacf double")


def scaled_profile(monthly: DataFrame, axis: str = "feature") -> DataFrame:
    """Month profile scaled to 0..1 per feature, or per month across features."""
    profile = monthly.groupBy("feature", "month").agg(F.avg("mean").alias("mean"))
    w = Window.partitionBy(axis)
    span = F.max("mean").over(w) - F.min("mean").over(w)
    return profile.withColumn("scaled", (F.col("mean") - F.min("mean").over(w)) / F.nullif(span, F.lit(0.0)))


def rank_days(daily: DataFrame) -> DataFrame:
    """Best day first; ``daily`` has one row per date, so one window task is enough."""
    return daily.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "date")))
