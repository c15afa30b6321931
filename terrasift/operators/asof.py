"""Time lookups: nearest day in a series, day windows, containing ranges.

Requests are reduced to distinct keys first. Distinct (key, day) pairs are bounded by
keys times days, so spreading each over its few candidate days and using equi-joins
stays small, and the wide rows join back once on a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_day(
    requests: DataFrame,
    series: DataFrame,
    key: list[str],
    values: list[str],
    days: int = 7,
    date_col: str = "date",
    series_date: str = "date",
    out: str = "matched",
) -> DataFrame:
    """Adds struct ``out`` (matched date, offset, values): exact day, else the closest
    within ``days`` (earliest on ties), else null. ``series`` has one row per key and day.
    """
    distinct = requests.select(*key, F.col(date_col).alias("_d")).dropna().distinct()
    spread = distinct.select(
        *key, "_d", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_o")
    ).withColumn("_s", F.date_add("_d", F.col("_o")))
    s = series.select(*key, F.col(series_date).alias("_s"), F.struct(*values).alias("_v"))
    hits = spread.join(s, [*key, "_s"])
    best = hits.groupBy(*key, "_d").agg(
        F.min_by(F.struct(F.col("_s").alias("date"), F.abs("_o").alias("days_off"), F.col("_v").alias("v")), F.struct(F.abs("_o"), F.col("_s"))).alias("_m")
    )
    found = best.select(
        *key,
        F.col("_d").alias(date_col),
        F.struct("_m.date", "_m.days_off", *[F.col(f"_m.v.{v}").alias(v) for v in values]).alias(out),
    )
    return requests.join(found, [*key, date_col], "left")


def window_sum(
    requests: DataFrame,
    series: DataFrame,
    key: list[str],
    value: str,
    back: int = 7,
    date_col: str = "date",
    out: str = "total",
) -> DataFrame:
    """Sum of ``value`` over the request day and the ``back`` days before it."""
    distinct = requests.select(*key, F.col(date_col).alias("_d")).dropna().distinct()
    spread = distinct.select(*key, "_d", F.explode(F.sequence(F.date_sub("_d", back), F.col("_d"))).alias("_s"))
    hits = spread.join(series.select(*key, F.col("date").alias("_s"), value), [*key, "_s"])
    total = hits.groupBy(*key, F.col("_d").alias(date_col)).agg(F.sum(value).alias(out))
    return requests.join(total, [*key, date_col], "left")


def expand_days(requests: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """One row per request and day, both ends included."""
    return requests.select("*", F.explode(F.sequence(F.col(start), F.col(end))).alias(out))


def containing_range(
    requests: DataFrame, cached: DataFrame, key: list[str], request_id: str, start: str = "start", end: str = "end"
) -> DataFrame:
    """Widest cached range that contains each request's range (smallest id on ties), or null.

    Per key and start only the latest end matters; those rows form one array per key,
    at most one element per calendar day, so a request meets a single row.
    """
    ranges = (
        cached.groupBy(*key, F.col(start).alias("c_start"))
        .agg(F.max(F.struct(F.col(end).alias("c_end"), (-F.col("cache_id")).alias("neg_id"))).alias("m"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("c_start", F.col("m.c_end").alias("c_end"), F.col("m.neg_id").alias("neg_id"))).alias("_r"))
    )
    joined = requests.join(ranges, key, "left")
    fits = F.filter("_r", lambda r: (r["c_start"] <= F.col(start)) & (r["c_end"] >= F.col(end)))
    ranked = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                F.datediff(r["c_end"], r["c_start"]).alias("span"), r["neg_id"].alias("neg_id"),
                r["c_start"].alias("c_start"), r["c_end"].alias("c_end"),
            ),
        )
    )
    return joined.withColumn("_best", ranked).select(
        request_id,
        *key,
        start,
        end,
        (-F.col("_best.neg_id")).alias("cache_id"),
        F.col("_best.c_start").alias("cached_start"),
        F.col("_best.c_end").alias("cached_end"),
    )


def split_cached(requests: DataFrame, cached: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(already available, still needed)."""
    known = cached.select(*key).distinct()
    return requests.join(known, key, "left_semi"), requests.join(known, key, "left_anti")


def missing_work(dates: DataFrame, variables: list[str], done: DataFrame) -> DataFrame:
    """(variable, date) pairs needed but not downloaded; variables are a literal list."""
    every = dates.select("date").distinct().select(
        F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable"), "date"
    )
    return every.join(done.select("variable", "date").distinct(), ["variable", "date"], "left_anti")


def available_work(dates: DataFrame, variables: list[str], done: DataFrame) -> DataFrame:
    every = dates.select("date").distinct().select(
        F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable"), "date"
    )
    return every.intersect(done.select("variable", "date"))


def match_results(
    points: DataFrame, results: DataFrame, point_id: str, tolerance: float = 0.01, digits: int = 4
) -> DataFrame:
    """Two-tier match of requested points to returned rows of the same day.

    Tier one joins on coordinates rounded to ``digits``; points left over are compared
    within ``tolerance`` degrees. The smallest result id wins, since results of one day do
    not differ in date. On a grid of half the tolerance the nine cells around a point lie
    within reach as a whole: of these only the smallest result counts, one row a cell and day.
    The sixteen cells around them are compared by distinct coordinate.
    """
    r = results.select("result_id", "latitude", "longitude", "date", "ndvi", "qa_flags")
    lat4, lon4 = F.round("latitude", digits).alias("_lat4"), F.round("longitude", digits).alias("_lon4")
    payload = F.struct("result_id", "ndvi", "qa_flags")
    exact = r.groupBy(lat4, lon4, "date").agg(F.min(payload).alias("hit"))
    keyed = points.withColumns({"_lat4": F.round("latitude", digits), "_lon4": F.round("longitude", digits)})
    tier1 = keyed.join(exact, ["_lat4", "_lon4", "date"], "left").drop("_lat4", "_lon4")
    cell = lambda c: F.floor(F.col(c) / (tolerance / 2))
    loose = r.groupBy("latitude", "longitude", "date").agg(F.min(payload).alias("_best"))
    loose = loose.select(cell("latitude").alias("_cy"), cell("longitude").alias("_cx"), "date", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"), "_best")
    whole = loose.groupBy("_cy", "_cx", "date").agg(F.min("_best").alias("_best"))
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    open_points = tier1.filter(F.col("hit").isNull()).select(point_id, "latitude", "longitude", "date")
    spread = (
        open_points.withColumn("_dy", around)
        .withColumn("_dx", around)
        .withColumns({"_cy": cell("latitude") + F.col("_dy"), "_cx": cell("longitude") + F.col("_dx")})
    )
    near = (F.abs("_dy") <= 1) & (F.abs("_dx") <= 1)
    slack = tolerance + 1e-12
    inside = (F.abs(F.col("_y") - F.col("latitude")) <= slack) & (F.abs(F.col("_x") - F.col("longitude")) <= slack)
    keys = ["_cy", "_cx", "date"]
    inner = spread.filter(near).join(whole, keys).select(point_id, "_best")
    rim = spread.filter(~near).join(loose, keys).filter(inside).select(point_id, "_best")
    tier2 = inner.unionByName(rim).groupBy(point_id).agg(F.min("_best").alias("_loose"))
    out = tier1.join(tier2, point_id, "left")
    hit = F.coalesce("hit", "_loose")
    return out.select(
        *points.columns,
        hit["ndvi"].alias("ndvi"),
        hit["qa_flags"].alias("qa_flags"),
        F.when(F.col("hit").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "tolerance").alias("tier"),
    )


def update_flagged(df: DataFrame, updates: DataFrame, key: str, column: str, flag: Column, low: float, high: float) -> DataFrame:
    """Overwrite ``column`` on flagged rows with valid new values; other rows keep theirs.

    ``updates`` has one ``new_value`` per key.
    """
    new = F.when(flag & F.col("new_value").between(low, high), F.col("new_value"))
    return df.join(updates.select(key, "new_value"), key, "left").withColumn(column, F.coalesce(new, F.col(column))).drop("new_value")
