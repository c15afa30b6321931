"""Habitat prediction for polygons and date ranges, many requests at a time.

A request is a row (request_id, ring, start, end); every step takes and returns
DataFrames, so one request or a million follow the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions import scores
from terrasift.functions.geo import METRES_PER_DEGREE, point_in_ring, polygon_area_acres
from terrasift.operators.keys import title_case
from terrasift.operators.lineage import cut_lineage
from terrasift.operators.spatial import ring_bounds
from terrasift.operators.summaries import count_if

ACRES_PER_SQ_MILE = 640.0
STATUSES = ["excellent", "good", "fair", "poor", "critical"]


def grid_points(requests: DataFrame, spacing_m: float = 500.0) -> DataFrame:
    """(request_id, start, end, latitude, longitude) inside each polygon.

    Grid positions are index times step from the south-west corner. Rows of the grid
    are spread over the cluster before they fan out into columns.
    """
    step = spacing_m / METRES_PER_DEGREE
    b = requests.withColumns(ring_bounds(F.col("ring")))
    n_rows = F.ceil((F.col("max_lat") - F.col("min_lat")) / step).cast("int")
    n_cols = F.ceil((F.col("max_lon") - F.col("min_lon")) / step).cast("int")
    lines = b.withColumns({"n_cols": n_cols}).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(n_rows - 1, F.lit(0)))).alias("i")
    )
    lines = lines.repartition("request_id", "i")
    cells = lines.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_cols") - 1, F.lit(0)))).alias("j"))
    placed = cells.withColumns(
        {"latitude": F.col("min_lat") + F.col("i") * step, "longitude": F.col("min_lon") + F.col("j") * step}
    )
    return placed.filter(point_in_ring(F.col("longitude"), F.col("latitude"), F.col("ring"))).select(
        "request_id", "start", "end", "i", "j", "latitude", "longitude"
    )


def with_dates(grid: DataFrame) -> DataFrame:
    """One row per grid point and day of its request, both ends included."""
    return grid.select("*", F.explode(F.sequence("start", "end")).alias("date"))


def predict(
    requests: DataFrame,
    context: Callable[[DataFrame], DataFrame],
    factors: list[str] = scores.RULE_FACTORS,
    spacing_m: float = 500.0,
    as_of: Column | None = None,
    place: Callable[[DataFrame], DataFrame] = lambda points: points,
    **kw,
) -> DataFrame:
    """Scored grid points; ``place`` adds feature columns to points, ``context`` to (point, date) rows."""
    points = context(with_dates(place(grid_points(requests, spacing_m))))
    return scores.score_habitat(points, factors, as_of=as_of, **kw)


def areas_sq_miles(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", (polygon_area_acres(F.col("ring")) / ACRES_PER_SQ_MILE).alias("sq_miles"))


def density(score: Column) -> Column:
    """Animals per square mile, 2 to 10."""
    return 2.0 + score / 100 * 8.0


def overall(scored: DataFrame, requests: DataFrame) -> DataFrame:
    means = scored.groupBy("request_id").agg(F.avg("total_score").alias("score"))
    s = F.col("score")
    return means.join(areas_sq_miles(requests), "request_id").select(
        "request_id",
        "score",
        F.when(s >= 75, "high").when(s >= 60, "medium").otherwise("low").alias("confidence_level"),
        F.floor(density(s) * F.col("sq_miles")).alias("estimated_population"),
        density(s).alias("population_density"),
        scores.habitat_class(s).alias("habitat_quality"),
    )


def factor_breakdown(scored: DataFrame, factors: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Mean score, contribution and most frequent status per request and factor.

    One wide aggregate (means and status counts per factor), then one unpivot: the
    scored rows are never multiplied by the number of factors.
    """
    w = scores.factor_weights(factors, weights)
    aggs = []
    for n in factors:
        aggs.append(F.avg(f"{n}_score").alias(f"{n}_mean"))
        aggs += [count_if(F.col(f"{n}_status") == s).alias(f"{n}_{s}") for s in STATUSES]
    wide = scored.groupBy("request_id").agg(*aggs)
    rows = []
    for n in factors:
        # highest count first, then alphabetical: array_min over (-count, status)
        modal = F.array_min(F.array(*[F.struct((-F.col(f"{n}_{s}")).alias("k"), F.lit(s).alias("status")) for s in STATUSES]))
        rows.append(
            F.struct(
                F.lit(n).alias("factor"),
                F.col(f"{n}_mean").alias("score"),
                F.lit(w[n]).alias("weight"),
                (F.col(f"{n}_mean") * w[n]).alias("contribution"),
                modal["status"].alias("status"),
            )
        )
    long = wide.select("request_id", F.inline(F.array(*rows)))
    word = (
        F.when(F.col("status") == "excellent", "optimal")
        .when(F.col("status") == "good", "favorable")
        .when(F.col("status") == "fair", "acceptable")
        .otherwise("limiting")
    )
    return long.withColumn("note", F.concat(title_case(F.col("factor")), F.lit(" is "), word))


def day_ranking(scored: DataFrame, requests: DataFrame, factors: list[str], as_of: Column) -> DataFrame:
    """Days of each request ranked by mean score, with population and reason.

    A mean depends on the order of its sum in the last digits, so means that agree to nine
    decimals tie and the earlier day comes first. A request has at most as many rows here as
    days, so its window stays small.
    """
    daily = scored.groupBy("request_id", "date").agg(
        F.avg("total_score").alias("score"), *[F.avg(f"{n}_score").alias(n) for n in factors]
    )
    means = F.array(*[F.struct(F.col(n).alias("m"), F.lit(-i).alias("o"), F.lit(n).alias("f")) for i, n in enumerate(factors)])
    lows = F.array(*[F.struct(F.col(n).alias("m"), F.lit(i).alias("o"), F.lit(n).alias("f")) for i, n in enumerate(factors)])
    best = F.regexp_replace(F.array_max(means)["f"], "_", " ")
    worst = F.regexp_replace(F.array_min(lows)["f"], "_", " ")
    s = F.col("score")
    reason = (
        F.when(s >= 80, F.concat(F.lit("Excellent conditions - "), best, F.lit(" is optimal")))
        .when(s >= 65, "Good conditions overall")
        .when(s >= 50, F.concat(F.lit("Fair conditions - "), worst, F.lit(" is limiting")))
        .otherwise(F.concat(F.lit("Poor conditions - "), worst, F.lit(" is suboptimal")))
    )
    ahead = F.datediff("date", as_of)
    out = daily.join(areas_sq_miles(requests), "request_id").select(
        "request_id",
        "date",
        "score",
        F.floor(density(s) * F.col("sq_miles")).alias("estimated_population"),
        reason.alias("reason"),
        F.when(ahead <= 3, "high").when(ahead <= 7, "medium").otherwise("low").alias("confidence"),
    )
    order = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), "date")
    return out.withColumn("rank", F.row_number().over(order))


HOTSPOT_RADIUS_DEG = 0.01
ACRES_PER_POINT = 0.25
SLICES = 64
PREFIX = 4096  # best open locations of a request that one walk holds


def _near(lat: Column, lon: Column, seed: Column, radius: float) -> Column:
    dy, dx = lat - seed["latitude"], lon - seed["longitude"]
    return F.sqrt(dy * dy + dx * dx) <= radius


def hotspot_seeds(scored: DataFrame, top: int = 10, radius: float = HOTSPOT_RADIUS_DEG, prefix: int = PREFIX) -> DataFrame:
    """Greedy non-overlapping seeds per request, best score first.

    Locations are reduced to their best day once. A walk down the ``prefix`` best locations that
    no seed covers yet takes each one that is not within ``radius`` of a seed. A seed covers few
    places of a grid, so the first walk mostly finds all ``top``; where locations crowd, another
    one goes on from its seeds. A walk holds ``prefix`` rows of a request, found in ``SLICES``
    parts first, so a large polygon is shared by many tasks.
    """
    order = F.struct("total_score", -F.datediff("date", F.lit("1970-01-01")), -F.col("longitude"), -F.col("latitude"))
    details = ["latitude", "longitude", "date", "total_score", "limiting_factor", "best_factor", "description"]
    best = scored.filter(F.col("total_score").isNotNull()).groupBy("request_id", "latitude", "longitude").agg(
        F.max_by(F.struct(*details), order).alias("p")
    )
    locations = cut_lineage(best.select("request_id", "p.*"))
    part = F.pmod(F.xxhash64("latitude", "longitude"), F.lit(SLICES))
    down = [F.desc("total_score"), F.col("date"), F.col("longitude"), F.col("latitude")]
    place = F.struct("latitude", "longitude")
    places = T.ArrayType(T.StructType([T.StructField(c, locations.schema[c].dataType) for c in ("latitude", "longitude")]))
    seeds = None
    while True:
        open_rows = locations.withColumn("_s", F.lit(None).cast(places))
        if seeds is not None:
            lists = seeds.filter("more").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", place.alias("at")))).alias("_l"))
            joined = locations.join(lists.select("request_id", F.transform("_l", lambda x: x["at"]).alias("_s")), "request_id")
            open_rows = joined.filter(~F.exists("_s", lambda s: _near(F.col("latitude"), F.col("longitude"), s, radius)))
        rows = open_rows.withColumn("slice", part)
        for cell in (["request_id", "slice"], ["request_id"]):
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*down))).filter(F.col("_n") <= prefix)
        walked = rows.groupBy("request_id").agg(
            F.sort_array(F.collect_list(F.struct("_n", *details))).alias("walk"), F.coalesce(F.first("_s"), F.array().cast(places)).alias("before")
        )
        covers = lambda found, x: F.exists(found, lambda s: _near(x["latitude"], x["longitude"], s, radius))
        taken = F.aggregate(
            "walk",
            F.struct(F.col("before").alias("at"), F.array().cast("array<int>").alias("n")),
            lambda acc, x: F.when(
                (F.size(acc["at"]) >= top) | covers(acc["at"], x), acc
            ).otherwise(F.struct(F.concat(acc["at"], F.array(F.struct(x["latitude"], x["longitude"]))).alias("at"), F.concat(acc["n"], F.array(x["_n"])).alias("n"))),
        )
        walked = walked.withColumn("taken", taken)
        more = (F.size("walk") == prefix) & (F.size("taken.at") < top)
        picks = walked.select("request_id", more.alias("more"), F.size("before").alias("_b"), "walk", F.posexplode("taken.n").alias("_i", "_n"))
        new = picks.select("request_id", (F.col("_b") + F.col("_i") + 1).alias("rank"), "more", F.element_at("walk", F.col("_n")).alias("p")).select(
            "request_id", "rank", "more", *[f"p.{c}" for c in details]
        )
        if seeds is not None:
            going = new.select("request_id", F.col("more").alias("_m")).distinct()
            kept = seeds.join(going, "request_id", "left").withColumn("more", F.coalesce("_m", F.lit(False))).drop("_m")
            new = kept.unionByName(new)
        seeds = cut_lineage(new)
        if seeds.filter("more").isEmpty():
            return seeds.drop("more")


def hotspots(scored: DataFrame, top: int = 10, radius: float = HOTSPOT_RADIUS_DEG) -> DataFrame:
    """Clusters around the seeds: every point-day within the radius counts, clusters may overlap."""
    needed = ["request_id", "latitude", "longitude", "date", "total_score", "limiting_factor", "best_factor", "description"]
    scored = cut_lineage(with_description(scored).select(*needed))
    seeds = hotspot_seeds(scored, top, radius)
    lists = seeds.groupBy("request_id").agg(F.collect_list(F.struct("rank", "latitude", "longitude")).alias("_s"))
    near = F.filter("_s", lambda s: _near(F.col("latitude"), F.col("longitude"), s, radius))
    members = scored.select("request_id", "latitude", "longitude", "total_score").join(lists, "request_id").select(
        "request_id",
        "total_score",
        F.pmod(F.xxhash64("latitude", "longitude"), F.lit(SLICES)).alias("slice"),
        F.explode(F.transform(near, lambda s: s["rank"])).alias("rank"),
    )
    sums = members.groupBy("request_id", "rank", "slice").agg(F.count(F.lit(1)).alias("points"), F.sum("total_score").alias("sum"))
    stats = sums.groupBy("request_id", "rank").agg(F.sum("points").alias("points"), (F.sum("sum") / F.sum("points")).alias("score"))
    acres = F.col("points") * ACRES_PER_POINT
    elk = lambda share: F.floor(density(F.col("score")) * share * (acres / ACRES_PER_SQ_MILE))
    low = F.greatest(F.lit(1), elk(0.8))
    return stats.join(seeds.drop("total_score"), ["request_id", "rank"]).select(
        "request_id",
        "rank",
        F.concat(F.lit("hotspot_"), F.col("rank").cast("string")).alias("id"),
        "latitude",
        "longitude",
        acres.alias("area_acres"),
        "score",
        low.alias("elk_min"),
        F.greatest(low, elk(1.2)).alias("elk_max"),
        F.greatest(F.lit(1), elk(1.0)).alias("elk_mean"),
        "description",
        "limiting_factor",
        "best_factor",
    )


def with_description(scored: DataFrame) -> DataFrame:
    """Short text from elevation, security and forage of a point."""
    parts = []
    if "elevation_score" in scored.columns:
        feet = F.coalesce(F.col("elevation_ft"), F.lit(8500.0))
        parts.append(F.concat(F.format_string("%.0f", feet), F.lit("ft elevation")))
    if "security_habitat_score" in scored.columns:
        parts.append(F.when(F.col("security_habitat_score") > 7, "secure terrain"))
    if "vegetation_quality_score" in scored.columns:
        parts.append(F.when(F.col("vegetation_quality_score") > 7, "good forage"))
    text = F.concat_ws(", ", *parts) if parts else F.lit("")
    return scored.withColumn("description", F.when(text == "", "elk habitat").otherwise(text))


def migration_status(date: Column) -> Column:
    """Phase, trend and days to the next movement as a struct."""
    m, y = F.month(date), F.year(date)

    def until(year: Column, month: int, day: int) -> Column:
        return F.datediff(F.make_date(year, F.lit(month), F.lit(day)), date)

    phase = (
        F.when(m.isin(6, 7, 8), "summer_range")
        .when(m.isin(9, 10), "pre_migration")
        .when(m == 11, "active_migration")
        .when(m.isin(12, 1, 2, 3), "winter_range")
        .otherwise("spring_migration")
    )
    trend = F.when(m == 11, "decreasing").when(m.isin(4, 5), "increasing").otherwise("stable")
    # winter months before April count to next year's spring, December to this year's
    days = (
        F.when(m.isin(6, 7, 8), until(y, 10, 15))
        .when(m.isin(9, 10), F.greatest(F.lit(0), until(y, 11, 1)))
        .when(m.isin(12, 1, 2, 3), until(F.when(m > 3, y).otherwise(y + 1), 4, 1))
        .otherwise(0)
    )
    return F.struct(
        phase.alias("current_phase"),
        F.when(phase == "pre_migration", "2026-11-01").alias("expected_migration_date"),
        F.when(days > 0, days).alias("days_until_migration"),
        F.lit("medium").alias("confidence"),
        trend.alias("trend"),
    )
