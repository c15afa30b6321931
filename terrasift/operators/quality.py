"""Data-quality rules, completeness, outliers and readiness scores.

Every report is one aggregate over the table (plus exact quantiles where a rule needs
them), unpivoted into rows; a missing column simply contributes no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions.vegetation import NLCD_CLASSES
from terrasift.operators.features import PLACEHOLDERS
from terrasift.operators.quantiles import exact_quantiles
from terrasift.operators.summaries import count_if, per_column

# Plausible ranges per column.
EXPECTED_RANGES = {
    "latitude": (40.9950, 45.0060),
    "longitude": (-111.0550, -104.0530),
    "elevation_ft": (1000, 14000),
    "slope_degrees": (0, 60),
    "aspect_degrees": (0, 360),
    "canopy_cover_percent": (0, 100),
    "water_distance_miles": (0, 50),
    "water_reliability": (0, 1),
    "road_distance_miles": (0, 100),
    "trail_distance_miles": (0, 100),
    "security_habitat_percent": (0, 100),
    "snow_depth_inches": (0, 300),
    "snow_water_equiv_inches": (0, 200),
    "temperature_f": (-50, 110),
    "precip_last_7_days_inches": (0, 20),
    "cloud_cover_percent": (0, 100),
    "ndvi": (-1, 1),
    "ndvi_age_days": (0, 365),
    "irg": (-1, 1),
    "summer_integrated_ndvi": (0, 10),
    "moon_phase": (0, 1),
    "moon_altitude_midnight": (-90, 90),
    "effective_illumination": (0, 1),
    "cloud_adjusted_illumination": (0, 1),
}

# Comparison tolerance of placeholder values.
PLACEHOLDER_TOLERANCE = {"temperature_f": 0.1, "ndvi": 0.01, "irg": 0.01, "precip_last_7_days_inches": 0.01}

# Feature list of the readiness score.
READINESS_FEATURES = [
    "elevation_ft", "slope_degrees", "aspect_degrees", "canopy_cover_percent", "land_cover_code", "land_cover_type",
    "water_distance_miles", "water_reliability", "road_distance_miles", "trail_distance_miles", "security_habitat_percent",
]

STATION_COLUMNS = ["snow_station_name", "snow_station_distance_km"]
FOREST_CODES = [41, 42, 43]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _d(c: Column) -> Column:
    return c.cast("double")


def is_placeholder(name: str, profile: str = "analyze") -> Column:
    value = _d(F.col(name))
    tol = PLACEHOLDER_TOLERANCE.get(name)
    tests = [F.abs(value - m) < tol if tol else value == m for m in PLACEHOLDERS[profile][name]]
    return reduce(lambda a, b: a | b, tests)


def placeholder_report(df: DataFrame, profile: str = "analyze") -> DataFrame:
    names = [n for n in PLACEHOLDERS[profile] if n in df.columns]
    total = F.count(F.lit(1))
    wide = df.agg(total.alias("total"), *[count_if(is_placeholder(n, profile)).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_placeholder")) for n in names])
    return wide.select("total", F.inline(rows)).select(
        "feature", "n_placeholder", (F.col("n_placeholder") / F.col("total") * 100).alias("pct")
    )


def missing_expectation(df: DataFrame, columns: list[str], source_col: str = "snow_data_source", real: str = "snotel") -> DataFrame:
    """Missing values split into expected (station columns of estimated rows) and not."""
    from_station = F.col(source_col) == real
    metrics = {}
    for n in columns:
        gone = F.col(n).isNull()
        metrics[n] = count_if(gone & from_station) if n in STATION_COLUMNS else count_if(gone)
    wide = df.agg(*[m.alias(f"u_{n}") for n, m in metrics.items()], *[count_if(F.col(n).isNull()).alias(f"m_{n}") for n in columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.col(f"u_{n}").alias("unexpected"), (F.col(f"m_{n}") - F.col(f"u_{n}")).alias("expected")
            )
            for n in columns
        ]
    )
    return wide.select(F.inline(rows))


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    ranges = {k: v for k, v in (ranges or EXPECTED_RANGES).items() if k in df.columns}
    wide = df.agg(
        *[count_if(_d(F.col(n)) < lo).alias(f"lo_{n}") for n, (lo, _) in ranges.items()],
        *[count_if(_d(F.col(n)) > hi).alias(f"hi_{n}") for n, (_, hi) in ranges.items()],
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(f"lo_{n}").alias("below"), F.col(f"hi_{n}").alias("above")) for n in ranges]
    )
    return wide.select(F.inline(rows))


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column: two doubles each, fetched once."""
    q: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(df, columns, [0.25, 0.75]).collect():
        q.setdefault(r["column"], {})[r["prob"]] = r["value"]
    out = {}
    for c, v in q.items():
        spread = v[0.75] - v[0.25]
        out[c] = (v[0.25] - 1.5 * spread, v[0.75] + 1.5 * spread)
    return out


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, with the share above which they matter."""
    fences = iqr_bounds(df, columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if((_d(F.col(c)) < lo) | (_d(F.col(c)) > hi)).alias(c) for c, (lo, hi) in fences.items()],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.col(c).alias("n_outliers"))
            for c, (lo, hi) in fences.items()
        ]
    )
    return wide.select("total", F.inline(rows)).select(
        "feature", "lower", "upper", "n_outliers", (F.col("n_outliers") > F.col("total") * 0.01).alias("above_1_pct")
    )


def z_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(F.col(c)).alias(f"{t}_{c}") for c in columns for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns if row[f"s_{c}"]}


def z_outliers(df: DataFrame, key: str, columns: list[str], cut: float = 3.0) -> DataFrame:
    """(key, feature, value, z) for |z| > cut, population deviation; outliers only are unpivoted."""
    mom = z_moments(df, columns)
    items = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), _d(F.col(c)).alias("value"), ((_d(F.col(c)) - m) / s).alias("z"))
            for c, (m, s) in mom.items()
        ]
    )
    kept = F.filter(items, lambda i: F.abs(i["z"]) > cut)
    return df.select(key, F.inline(kept))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percent filled with status; columns the table lacks are listed as absent."""
    present = [c for c in columns if c in df.columns]
    out = per_column(df, present, {"pct": lambda c: F.count(c) / F.count(F.lit(1)) * 100})
    status = F.when(F.col("pct") >= 90, "complete").when(F.col("pct") >= 50, "partial").otherwise("sparse")
    out = out.withColumn("status", status)
    absent = [(c, None, "absent") for c in columns if c not in df.columns]
    if absent:
        out = out.unionByName(df.sparkSession.createDataFrame(absent, "feature string, pct double, status string"))
    return out


def month_gap(df: DataFrame, label: str = "elk_present", date_col: str = "date") -> DataFrame:
    """Largest difference between the monthly shares of presences and absences.

    Months seen in both classes only; above 20 percent points is poor, above 10 weak.
    """
    m = df.groupBy(F.month(date_col).alias("month")).agg(
        count_if(F.col(label) == 1).alias("p"), count_if(F.col(label) == 0).alias("a")
    )
    w = Window.partitionBy()  # twelve rows
    shares = m.withColumns({"ps": F.col("p") / F.sum("p").over(w) * 100, "as": F.col("a") / F.sum("a").over(w) * 100})
    gap = shares.filter((F.col("p") > 0) & (F.col("a") > 0)).agg(F.max(F.abs(F.col("ps") - F.col("as"))).alias("max_gap"))
    return gap.withColumn(
        "status", F.when(F.col("max_gap") > 20, "poor").when(F.col("max_gap") > 10, "weak").otherwise("good")
    )


def absence_dates(df: DataFrame, label: str = "elk_present", date_col: str = "date") -> DataFrame:
    """Date completeness of absences with the January and single-year alarms."""
    a = df.filter(F.col(label) == 0)
    n = F.count(F.lit(1))
    out = a.agg(
        n.alias("n"),
        (F.count(date_col) / n * 100).alias("dated_pct"),
        (count_if(F.month(date_col) == 1) / n * 100).alias("january_pct"),
        (count_if(F.year(date_col) == 2024) / n * 100).alias("year_2024_pct"),
    )
    return out.withColumns(
        {"january_alarm": F.col("january_pct") > 30, "year_2024_alarm": F.col("year_2024_pct") > 40}
    )


def _check(severity: str, rule: str, n: Column, failed: Column) -> Column:
    """One rule row: affected rows (or null) and whether it failed."""
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), n.cast("double").alias("measure"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )


class RuleSet:
    """Collects aggregates once and turns them into rule rows over a single pass."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggs: list[Column] = []
        self.rows: list[Column] = []

    def agg(self, expr: Column) -> Column:
        name = f"a{len(self.aggs)}"
        self.aggs.append(expr.alias(name))
        return F.col(name)

    def share(self, condition: Column, of: Column | None = None) -> Column:
        base = count_if(of) if of is not None else F.count(F.lit(1))
        return self.agg(count_if(condition if of is None else of & condition) / F.nullif(base, F.lit(0)) * 100)

    def rule(self, severity: str, name: str, measure: Column, failed: Column) -> None:
        self.rows.append(_check(severity, name, measure, failed))

    def has(self, *names: str) -> bool:
        return all(n in self.df.columns for n in names)

    def result(self) -> DataFrame:
        return self.df.agg(*self.aggs).select(F.inline(F.array(*self.rows)))


def _season_mean(rs: RuleSet, column: str, months: list[int]) -> Column:
    return rs.agg(F.avg(F.when(F.month("date").isin(*months), F.col(column))))


SUMMER, WINTER = [6, 7, 8], [12, 1, 2]


def rule_report(df: DataFrame) -> DataFrame:
    """(severity, rule, measure, failed) for every rule whose columns exist."""
    rs = RuleSet(df)
    c = F.col
    if rs.has("road_distance_miles", "trail_distance_miles"):
        road, trail = c("road_distance_miles"), c("trail_distance_miles")
        both = road.isNotNull() & trail.isNotNull()
        near = rs.share(trail < road, both)
        rs.rule("info", "trail_closer_than_road_pct", near, F.lit(False))
        rs.rule("info", "road_trail_correlation", rs.agg(F.corr(road, trail)), F.lit(False))
        rs.rule("info", "mean_trail_where_road_under_1", rs.agg(F.avg(F.when(road < 1, trail))), F.lit(False))
        default_road = rs.share(road == 2.0, road.isNotNull())
        rs.rule("warning", "default_road_distance_pct", default_road, default_road > 10)
        default_trail = rs.share(trail == 1.5, trail.isNotNull())
        rs.rule("warning", "default_trail_distance_pct", default_trail, default_trail > 10)
    if rs.has("ndvi"):
        v = c("ndvi")
        marks = rs.share((F.abs(v - 0.3) < 0.01) | (F.abs(v - 0.5) < 0.01), v.isNotNull())
        rs.rule("warning", "ndvi_placeholder_pct", marks, marks > 10)
        bad = rs.agg(count_if((v < -1) | (v > 1)))
        rs.rule("error", "ndvi_out_of_range", bad, bad > 0)
        if rs.has("date"):
            d = _season_mean(rs, "ndvi", SUMMER) - _season_mean(rs, "ndvi", WINTER)
            rs.rule("warning", "ndvi_summer_minus_winter", d, d < 0.1)
    if rs.has("ndvi_age_days"):
        age = c("ndvi_age_days")
        same = rs.share(age == 8, age.isNotNull())
        rs.rule("warning", "ndvi_age_placeholder_pct", same, same > 50)
        old = rs.agg(count_if(age > 90))
        rs.rule("info", "ndvi_older_than_90_days", old, old > 0)
    if rs.has("irg"):
        zero = rs.share(c("irg") == 0, c("irg").isNotNull())
        rs.rule("warning", "irg_zero_pct", zero, zero > 80)
        if rs.has("date"):
            spring = _season_mean(rs, "irg", [4, 5])
            fall = _season_mean(rs, "irg", [9, 10])
            rs.rule("warning", "irg_spring_mean", spring, spring <= 0)
            rs.rule("warning", "irg_fall_mean", fall, fall >= 0)
    if rs.has("summer_integrated_ndvi"):
        top = rs.agg(F.max("summer_integrated_ndvi"))
        rs.rule("warning", "summer_ndvi_maximum", top, (top < 0.5) | (top > 10))
    if rs.has("temperature_f"):
        t = c("temperature_f")
        mark = rs.share(F.abs(t - 45.0) < 0.1, t.isNotNull())
        rs.rule("warning", "temperature_placeholder_pct", mark, mark > 10)
        if rs.has("date"):
            d = _season_mean(rs, "temperature_f", SUMMER) - _season_mean(rs, "temperature_f", WINTER)
            rs.rule("warning", "temperature_summer_minus_winter", d, d < 20)
            span = rs.agg(F.max(t) - F.min(t))
            rs.rule("warning", "temperature_span", span, span < 10)
        if rs.has("elevation_ft"):
            n, r = rs.agg(count_if(t.isNotNull() & c("elevation_ft").isNotNull())), rs.agg(F.corr("elevation_ft", "temperature_f"))
            rs.rule("warning", "elevation_temperature_correlation", r, (n > 50) & (r > -0.2))
            rs.rule("warning", "elevation_temperature_positive", r, (n > 50) & (r > 0.3))
    if rs.has("precip_last_7_days_inches"):
        p = c("precip_last_7_days_inches")
        zero = rs.share(p == 0, p.isNotNull())
        rs.rule("warning", "zero_precipitation_pct", zero, zero > 70)
        rs.rule("info", "precipitation_above_5_inches", rs.agg(count_if(p > 5)), F.lit(False))
    if rs.has("cloud_cover_percent"):
        k = c("cloud_cover_percent")
        mark = rs.share(k.isin(20, 30, 40), k.isNotNull())
        rs.rule("warning", "cloud_placeholder_pct", mark, mark > 50)
        bad = rs.agg(count_if((k < 0) | (k > 100)))
        rs.rule("error", "cloud_out_of_range", bad, bad > 0)
    if rs.has("snow_data_source", "snow_depth_inches", "elevation_ft"):
        src, depth, e = c("snow_data_source"), c("snow_depth_inches"), c("elevation_ft")
        est = src == "estimate"
        share = rs.share(est)
        rs.rule("warning", "snow_estimated_pct", share, share > 50)
        low = rs.agg(count_if(est & (e < 3000) & (depth > 5)))
        rs.rule("warning", "deep_snow_at_low_elevation", low, low > 0)
        n_est = rs.agg(count_if(est))
        lo, hi = rs.agg(F.min(F.when(est, depth))), rs.agg(F.max(F.when(est, depth)))
        rs.rule("warning", "constant_snow_estimate", lo, (n_est > 5) & (lo == hi) & (lo > 0))
        e_span = rs.agg(F.max(F.when(est, e)) - F.min(F.when(est, e)))
        r = rs.agg(F.corr(F.when(est, e), F.when(est, depth)))
        rs.rule("warning", "snow_estimate_elevation_correlation", r, (e_span > 2000) & (n_est > 10) & (r < 0.5))
        high = rs.agg(F.avg(F.when(est & (e > 8000), depth)))
        rs.rule("warning", "mean_snow_estimate_above_8000", high, high < 10)
        under = rs.agg(count_if(est & (e < 6000) & (depth > 0.1)))
        rs.rule("info", "snow_estimate_below_6000", under, under > 0)
        if rs.has("snow_station_distance_km"):
            far = rs.agg(count_if(~est & (c("snow_station_distance_km") > 50)))
            rs.rule("warning", "station_beyond_50_km", far, far > 0)
    if rs.has("snow_depth_inches", "snow_water_equiv_inches"):
        depth, swe = c("snow_depth_inches"), c("snow_water_equiv_inches")
        neg = rs.agg(count_if((depth < 0) | (swe < 0)))
        rs.rule("error", "negative_snow", neg, neg > 0)
        dense = rs.agg(count_if(swe > depth))
        rs.rule("warning", "water_equivalent_above_depth", dense, dense > 0)
    if rs.has("latitude", "longitude"):
        (a, b), (x, y) = EXPECTED_RANGES["latitude"], EXPECTED_RANGES["longitude"]
        out = rs.share(~(c("latitude").between(a, b) & c("longitude").between(x, y)))
        rs.rule("error", "outside_study_area_pct", out, out > 0)
    if rs.has("land_cover_code"):
        k = c("land_cover_code")
        bad = rs.agg(count_if(k.isNotNull() & ~k.isin(*NLCD_CLASSES)))
        rs.rule("error", "invalid_land_cover", bad, bad > 0)
        if rs.has("canopy_cover_percent"):
            canopy = c("canopy_cover_percent")
            forest = k.isin(*FOREST_CODES) & canopy.isNotNull()
            bare = rs.share(canopy < 10, forest)
            rs.rule("warning", "forest_without_canopy_pct", bare, bare > 10)
            other = k.isNotNull() & ~k.isin(*FOREST_CODES, 52) & canopy.isNotNull()
            dense = rs.share(canopy > 50, other)
            rs.rule("warning", "canopy_without_forest_pct", dense, dense > 10)
        if rs.has("ndvi"):
            f = rs.agg(F.avg(F.when(k.isin(*FOREST_CODES), c("ndvi"))))
            o = rs.agg(F.avg(F.when(~k.isin(*FOREST_CODES), c("ndvi"))))
            rs.rule("warning", "forest_minus_other_ndvi", f - o, f < o)
    for name, lo, hi, strict in (("aspect_degrees", 0, 360, True), ("water_reliability", 0, 1, False), ("security_habitat_percent", 0, 100, False)):
        if rs.has(name):
            over = c(name) >= hi if strict else c(name) > hi
            bad = rs.agg(count_if((c(name) < lo) | over))
            rs.rule("error", f"{name}_out_of_range", bad, bad > 0)
    return rs.result()


def issues(report: DataFrame) -> DataFrame:
    """Failed rules only, most severe first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return report.filter("failed").orderBy(rank, "rule").drop("failed")


def suspicious_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Impossible temperatures and elevations, and constant features."""
    limits = {"temperature_f": (-60, 120), "elevation_ft": (0, 15000)}
    out = per_column(df, columns, {"std": lambda c: F.stddev_samp(_d(c)), "_n": lambda c: F.count(c)}).drop("_n")
    extreme = df.agg(
        *[
            count_if((F.col(n) < lo) | (F.col(n) > hi)).alias(n)
            for n, (lo, hi) in limits.items()
            if n in df.columns
        ]
    )
    names = [n for n in limits if n in df.columns]
    e = extreme.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_impossible")) for n in names]))
    )
    return out.join(e, "feature", "left").select(
        "feature", F.coalesce("n_impossible", F.lit(0)).alias("n_impossible"), (F.col("std") < 1e-10).alias("constant")
    )


def monthly_missing(df: DataFrame, column: str, date_col: str = "date", sparse: int = 100) -> DataFrame:
    """Rows, missing rate and success rate per month; months with few rows are marked."""
    n = F.count(F.lit(1))
    return df.groupBy(F.month(date_col).alias("month")).agg(
        n.alias("n"),
        (count_if(F.col(column).isNull()) / n * 100).alias("missing_pct"),
        (F.count(column) / n * 100).alias("success_pct"),
        (n < sparse).alias("sparse"),
    )


def yearly_counts(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.groupBy(F.year(date_col).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def quality_score(df: DataFrame, columns: list[str], numeric: list[str]) -> DataFrame:
    """0-100: completeness 40, validity 30, geography 15, vegetation index 15."""
    fences = iqr_bounds(df, numeric)
    n = F.count(F.lit(1))
    filled = reduce(lambda a, b: a + b, [F.count(c) for c in columns])
    out = reduce(lambda a, b: a + b, [count_if((_d(F.col(c)) < lo) | (_d(F.col(c)) > hi)) for c, (lo, hi) in fences.items()])
    bad_lat = count_if(~F.col("latitude").between(-90, 90))
    bad_lon = count_if(~F.col("longitude").between(-180, 180))
    bad_ndvi = count_if((F.col("ndvi") < -1) | (F.col("ndvi") > 1))
    s = df.agg(
        (filled / (n * len(columns)) * 40).alias("completeness"),
        ((1 - out / (n * len(numeric))) * 30).alias("validity"),
        ((1 - (bad_lat + bad_lon) / (n * 2)) * 15).alias("geographic"),
        (F.count("ndvi") / n * F.when(bad_ndvi == 0, 1.0).otherwise(0.5) * 15).alias("vegetation"),
    )
    total = F.col("completeness") + F.col("validity") + F.col("geographic") + F.col("vegetation")
    s = s.withColumn("score", total)
    return s.withColumn(
        "rating",
        F.when(F.col("score") >= 90, "EXCELLENT").when(F.col("score") >= 80, "GOOD").when(F.col("score") >= 70, "ACCEPTABLE")
        .when(F.col("score") >= 60, "NEEDS IMPROVEMENT").otherwise("POOR"),
    )


def readiness(df: DataFrame, core: list[str], by: list[str] | None = None, label: str = "elk_present") -> DataFrame:
    """Training readiness in percent: volume .25, richness .25, quality .35, dates .15."""
    n = F.count(F.lit(1))
    have = [c for c in READINESS_FEATURES if c in df.columns]
    richness = len(have) / len(READINESS_FEATURES)
    missing = F.greatest(F.lit(0.0), *[count_if(F.col(c).isNull()) / n * 100 for c in core if c in df.columns])
    marks = F.greatest(
        F.lit(0.0),
        *[count_if(_d(F.col(c)) == v[0]) / n * 100 for c, v in PLACEHOLDERS["assess"].items() if c in df.columns],
    )
    absent = F.col(label) == 0
    share = lambda c: count_if(absent & c.isNull()) / F.nullif(count_if(absent), F.lit(0)) * 100
    gap = F.greatest(F.lit(0.0), share(F.month("date")), share(F.year("date")))
    g = df.groupBy(*(by or [])).agg(n.alias("samples"), missing.alias("_missing"), marks.alias("_marks"), gap.alias("_gap"))
    volume = F.when(F.col("samples") < 1000, 0.3).when(F.col("samples") < 10000, 0.6).when(F.col("samples") < 100000, 0.9).otherwise(1.0)
    quality = F.least(F.greatest(F.lit(0.0), 1 - F.col("_missing") / 100), 1 - F.col("_marks") / 200)
    dates = F.when(F.col("_gap") > 50, 0.5).when(F.col("_gap") > 10, 0.8).otherwise(1.0)
    pct = (volume * 0.25 + richness * 0.25 + quality * 0.35 + dates * 0.15) * 100
    out = g.withColumns(
        {"volume": volume, "richness": F.lit(richness), "quality": quality, "dates": dates, "readiness_pct": pct}
    )
    return out.withColumn(
        "status",
        F.when(F.col("readiness_pct") >= 80, "ready").when(F.col("readiness_pct") >= 60, "mostly_ready").otherwise("not_ready"),
    ).drop("_missing", "_marks", "_gap")


def context_check(df: DataFrame, label: str = "elk_present", columns: list[str] | None = None) -> DataFrame:
    """One row: target, periods, bounds, missing cells and range failures of a table."""
    columns = columns or df.columns
    ranges = {k: v for k, v in EXPECTED_RANGES.items() if k in df.columns}
    outside = reduce(
        lambda a, b: a + b, [count_if((_d(F.col(k)) < lo) | (_d(F.col(k)) > hi)) for k, (lo, hi) in ranges.items()]
    )
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col(label) == 1).alias("positive"),
        count_if(F.col(label) == 0).alias("negative"),
        F.countDistinct(F.year("date")).alias("years"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
        reduce(lambda a, b: a + b, [count_if(F.col(c).isNull()) for c in columns]).alias("missing_cells"),
        outside.alias("range_failures"),
    )
