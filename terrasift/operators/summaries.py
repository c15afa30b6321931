"""Descriptive reports: one wide aggregate, unpivoted once, instead of a scan per column."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.quantiles import bucket_of, exact_quantiles, value_counts_long

Metric = Callable[[Column], Column]


def per_column(
    df: DataFrame, columns: list[str], metrics: dict[str, Metric], by: list[str] | None = None, label: str = "feature"
) -> DataFrame:
    """Long table (by..., feature, metrics...) from a single aggregation pass."""
    by = by or []
    aggs = [fn(F.col(c)).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, fn in metrics.items()]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(label), *[F.col(f"{i}_{m}").alias(m) for m in metrics])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*by, F.inline(rows))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def class_distribution(df: DataFrame, label: str = "elk_present", by: list[str] | None = None) -> DataFrame:
    """Totals, shares and negative/positive ratio; the ratio is infinite without positives."""
    pos, neg, total = F.col("positive"), F.col("negative"), F.col("total")
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col(label) == 1).alias("positive"),
        count_if(F.col(label) == 0).alias("negative"),
    )
    return out.withColumns(
        {
            "positive_pct": F.round(pos / total * 100, 6),
            "negative_pct": F.round(neg / total * 100, 6),
            "imbalance_ratio": F.when(pos > 0, F.round(neg / F.nullif(pos, F.lit(0)), 6)).otherwise(math.inf),
        }
    )


def class_subtotals(df: DataFrame, keys: list[str], label: str = "elk_present") -> DataFrame:
    """Class counts with subtotal rows; null keys mark the rolled-up levels."""
    return df.rollup(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col(label) == 1).alias("positive")
    )


def month_class_table(df: DataFrame, date_col: str = "date", label: str = "elk_present") -> DataFrame:
    out = df.groupBy(F.month(date_col).alias("month")).agg(
        count_if(F.col(label) == 0).alias("absent"),
        count_if(F.col(label) == 1).alias("present"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.withColumn("present_pct", F.round(F.col("present") / F.col("total") * 100, 1))


def missing_report(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    metrics = {
        "n_missing": lambda c: count_if(c.isNull()),
        "pct_missing": lambda c: F.round(count_if(c.isNull()) / F.count(F.lit(1)) * 100, 6),
    }
    return per_column(df, columns or df.columns, metrics, by)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, min, max, mean, std, median and distinct values per numeric column."""
    d = lambda c: c.cast("double")
    base = per_column(
        df,
        columns,
        {
            "count": lambda c: F.count(c),
            "min": lambda c: F.min(d(c)),
            "max": lambda c: F.max(d(c)),
            "mean": lambda c: F.avg(d(c)),
            "std": lambda c: F.stddev_samp(d(c)),
        },
    )
    medians = exact_quantiles(df, columns, [0.5]).select(F.col("column").alias("feature"), F.col("value").alias("median"))
    distinct = value_counts_long(df, columns).groupBy(F.col("column").alias("feature")).agg(
        F.count(F.lit(1)).alias("nunique")
    )
    return base.join(medians, "feature", "left").join(distinct, "feature", "left")


def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(column, value, n, pct) per category; optionally the ``top`` ones of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        # row limits of this form are applied per partition before the shuffle
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.col("value")))
        counts = counts.withColumn("rank", rank).filter(F.col("rank") <= top)
    # every row has one value per column, so a column's counts add up to the table's rows
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 6))


def monthly_stats(df: DataFrame, column: str, date_col: str = "date") -> DataFrame:
    c = F.col(column)
    return df.groupBy(F.month(date_col).alias("month")).agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count")
    )


def season_contrast(df: DataFrame, columns: list[str], date_col: str = "date") -> DataFrame:
    """Summer mean, winter mean and their difference per column."""
    m = F.month(date_col)
    summer = lambda c: F.avg(F.when(m.isin(6, 7, 8), c))
    winter = lambda c: F.avg(F.when(m.isin(12, 1, 2), c))
    return per_column(
        df,
        columns,
        {"summer": summer, "winter": winter, "difference": lambda c: summer(c) - winter(c)},
    )


def per_group_counts(df: DataFrame, key: str) -> DataFrame:
    """Distribution of rows per individual, from counts of counts."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean")
    )
    median = exact_quantiles(sizes, ["n"], [0.5]).select(F.col("value").alias("median"))
    return stats.withColumn("median", median.scalar())


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each identical combination, and infinite values."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def infinite_values(df: DataFrame, columns: list[str]) -> DataFrame:
    inf = F.lit(math.inf)
    return per_column(df, columns, {"n_infinite": lambda c: count_if(F.abs(c.cast("double")) == inf)})


def distinct_locations(df: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct("latitude", "longitude")).alias("locations"))
    return df.groupBy("latitude", "longitude").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("locations"))


# Distance bands, right-closed, the first including zero.
DISTANCE_EDGES = [0, 1, 5, 10, 20, 50, 100]
DISTANCE_LABELS = ["<1mi", "1-5mi", "5-10mi", "10-20mi", "20-50mi", "50-100mi", "100+mi"]


def distance_band(value: Column) -> Column:
    expr = F.lit(DISTANCE_LABELS[-1])
    for upper, label in reversed(list(zip(DISTANCE_EDGES[1:], DISTANCE_LABELS))):
        expr = F.when(value <= upper, label).otherwise(expr)
    return F.when(value >= 0, expr)


def distance_bands(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of each band among all rows of the table; negative distances are left out."""
    banded = df.select(*[distance_band(F.col(c)).alias(c) for c in columns])
    return value_counts(banded, columns).filter(F.col("value").isNotNull())


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the maximum belongs to the last one."""
    raw = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))


def grid_means(
    df: DataFrame, x: str, y: str, target: str, bins: int = 10, high: float = 0.6, low: float = 0.4
) -> DataFrame:
    """Mean and count of ``target`` on an equal-width ``bins`` x ``bins`` grid."""
    ends = [F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")]
    edge = df.agg(F.struct(*ends).alias("e")).scalar()
    binned = df.select(
        equal_width_bin(F.col(x), edge["x0"], edge["x1"], bins).alias("x_bin"),
        equal_width_bin(F.col(y), edge["y0"], edge["y1"], bins).alias("y_bin"),
        F.col(target).alias("t"),
    )
    out = binned.groupBy("x_bin", "y_bin").agg(F.avg("t").alias("mean"), F.count("t").alias("count"))
    level = F.when(F.col("mean") > high, "high").when(F.col("mean") < low, "low").otherwise("middle")
    return out.withColumn("level", level)


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Pointy-top hexagon (q, r) of a planar point by cube rounding."""
    q = (x * math.sqrt(3) / 3 - y / 3) / size
    r = (y * 2 / 3) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    out_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    out_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return out_q.cast("bigint"), out_r.cast("bigint")


def hex_surface(df: DataFrame, x: str, y: str, value: str, size: float, min_count: int = 1) -> DataFrame:
    """Density and mean per hexagon with at least ``min_count`` points."""
    q, r = hex_cell(F.col(x), F.col(y), size)
    out = df.groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"))
    return out.filter(F.col("count") >= min_count)


def quantile_bins(df: DataFrame, feature: str, target: str, bins: int = 20) -> DataFrame:
    """Response curve over quantile bins; equal edges are merged.

    The ``bins + 1`` edges are fetched once and become literals of the scan.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = sorted({r["value"] for r in exact_quantiles(df, [feature], probs).collect()})
    bin_of = bucket_of(F.col(feature), edges[1:-1])
    return df.filter(F.col(feature).isNotNull()).groupBy(bin_of.alias("bin")).agg(
        F.avg(target).alias("mean_target"), F.avg(feature).alias("mean_feature"), F.count(F.lit(1)).alias("n")
    )


def date_span(df: DataFrame, date_col: str = "date", pad: int = 30, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.date_sub(F.min(date_col), pad).alias("first_date"),
        F.date_add(F.max(date_col), pad).alias("last_date"),
        (F.max(F.year(date_col)) - F.min(F.year(date_col)) + 1).alias("years"),
    )


def needed_dates(df: DataFrame, date_col: str = "date", lookback: int = 7) -> DataFrame:
    """Distinct dates plus their look-back days; distinct first, so the explode stays small."""
    days = df.select(F.col(date_col).alias("d")).filter(F.col("d").isNotNull()).distinct()
    return days.select(F.explode(F.sequence(F.date_sub("d", lookback), F.col("d"))).alias("date")).distinct()


def share_by(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 6))
