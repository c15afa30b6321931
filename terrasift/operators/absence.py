"""Pseudo-absence sampling: strategies as functions ``(presence, n, ...) -> DataFrame``.

Candidates are numbered rows whose coordinates, dates and picks are hashes of that
number, so results do not depend on partitioning or retries. Each strategy filters its
candidates and keeps the first ``n`` by number through bucketed ranks, never through one
task. Further ranges of numbers are drawn until there are ``n``; a range without a single
acceptable candidate raises, as the rules then leave no room.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import temporal
from terrasift.functions.rng import hash_uniform
from terrasift.operators import habitat
from terrasift.operators.features import STUDY_AREA, TARGET
from terrasift.operators.lineage import cut_lineage
from terrasift.operators.nearest import beyond_distance, with_distance
from terrasift.operators.sampling import sample_rows, shuffle_order, with_group_rank, with_hash_rank

RANK_BUCKET_ROWS = 4096
RANGE_ROWS = 250_000  # candidates drawn in one task

# Share of each strategy in the default mix.
STRATEGY_SHARES = {"environmental": 0.40, "unsuitable": 0.30, "background": 0.20, "temporal": 0.10}
# Month offset per dataset where it differs from six.
SEASON_OFFSETS = {"southern_gye": 4}
NO_WATER_MILES = 20.0
FAR_M = "_far_m"  # metres from the nearest presence, null beyond the search


def targets(n_presence: int, ratio: float = 1.0, shares: dict[str, float] = STRATEGY_SHARES) -> dict[str, int]:
    """Rows wanted per strategy."""
    total = int(n_presence * ratio)
    return {k: int(total * v) for k, v in shares.items()}


# Presence rows above which the search widens, least factor, rows per unit of factor.
WIDENING = [(50_000, 3.0, 5_000.0), (10_000, 2.0, 10_000.0), (-1, 1.0, 10_000.0)]
BASE_ATTEMPTS, MOST_ATTEMPTS = 10_000, 1_000_000


def oversampling(n_presence: Column, wanted: Column) -> Column:
    """Struct (factor, attempts): how far the search for ``wanted`` rows widens with the presence table."""
    factor = None
    for above, least, unit in reversed(WIDENING):
        own = F.greatest(F.lit(least), wanted / unit)
        factor = own if factor is None else F.when(n_presence > above, own).otherwise(factor)
    attempts = F.least(F.floor(factor * BASE_ATTEMPTS), F.lit(MOST_ATTEMPTS)).cast("bigint")
    return F.struct(factor.alias("factor"), attempts.alias("attempts"))


def first_range(n: int) -> int:
    """Candidates drawn at first for ``n`` samples."""
    return max(10_000, 2 * n)


def candidates(spark: SparkSession, low: int, high: int, seed: int, box: dict[str, float] = STUDY_AREA) -> DataFrame:
    """Uniform locations in the study box for the candidate numbers from ``low`` to ``high - 1``."""
    k = F.col("candidate_id")
    return (
        spark.range(low, high, 1, max(spark.sparkContext.defaultParallelism, -(-(high - low) // RANGE_ROWS)))
        .withColumnRenamed("id", "candidate_id")
        .withColumns(
            {
                "latitude": box["min_lat"] + hash_uniform(seed, "lat", k) * (box["max_lat"] - box["min_lat"]),
                "longitude": box["min_lon"] + hash_uniform(seed, "lon", k) * (box["max_lon"] - box["min_lon"]),
            }
        )
    )


def first_n(df: DataFrame, n: int, group: list[str] | None = None) -> DataFrame:
    """The ``n`` smallest candidate numbers (per group)."""
    bucket = F.floor(F.col("candidate_id") / RANK_BUCKET_ROWS)
    ranked = with_group_rank(df, group or [], bucket, [F.col("candidate_id")])
    return ranked.filter(F.col("rank") <= n).drop("rank", "rank_total")


def fill(n: int, accept: Callable[[int, int], DataFrame], first: int | None = None) -> DataFrame:
    """The first ``n`` accepted candidates; ``accept(low, high)`` filters a range of numbers.

    Ranges double from ``first`` on, and what a range yields is written before the next is drawn.
    """
    low, high = 0, first or first_range(n)
    kept = cut_lineage(accept(low, high))
    have = kept.count()
    while have < n:
        low, high = high, 2 * high
        more = cut_lineage(accept(low, high))
        found = more.count()
        if not found:
            raise ValueError(f"no acceptable candidate among {high - low}; {have} of {n} found")
        kept, have = kept.unionByName(more), have + found
    return first_n(kept, n)


def _pick(options: list[int], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def _draw_presence(df: DataFrame, presence: DataFrame, key: str, columns: list[str], seed: int, stream: str) -> DataFrame:
    """Attach ``columns`` of a presence row drawn with replacement per candidate."""
    ranked = with_hash_rank(presence.select(key, *columns), [key], seed, stream).withColumnRenamed("rank_total", "_size")
    size = presence.agg(F.count(F.lit(1))).scalar()
    u = hash_uniform(seed, f"{stream}_pick", F.col("candidate_id"))
    keyed = df.withColumn("rank", (F.floor(u * size) + 1).cast("bigint"))
    return keyed.join(ranked.select("rank", *columns), "rank").drop("rank")


def _obstacles(presence: DataFrame) -> DataFrame:
    return presence.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def _year_span(presence: DataFrame) -> tuple[Column, Column]:
    """First and last presence year as scalar subqueries."""
    y = F.year("date")
    return presence.agg(F.min(y)).scalar(), presence.agg(F.max(y)).scalar()


def random_day(year: Column, month: Column, u: Column) -> Column:
    day = F.floor(u * temporal.days_in_month(year, month)) + 1
    return F.make_date(year, month, day.cast("int"))


def _far_ranges(presence: DataFrame, seed: int, metres: float) -> Callable[[int, int], DataFrame]:
    """Ranges of candidates at least ``metres`` from every presence."""
    spark, obstacles = presence.sparkSession, _obstacles(presence)
    return lambda low, high: beyond_distance(candidates(spark, low, high, seed), obstacles, metres)


@dataclass
class SharedRanges:
    """Ranges of candidates that several strategies of one seed filter.

    A range meets the presences once, at the widest distance asked for. Its rows get their context
    once, those beyond that distance apart from the nearer ones, which not every strategy needs.
    All is written and read again by every strategy that comes to the range. Ranges begin with ``first`` candidates and double for all strategies alike.
    """

    presence: DataFrame
    context: Callable[[DataFrame], DataFrame]
    seed: int
    first: int
    near_m: float  # no strategy takes candidates nearer than this
    far_m: float  # nor asks for a greater distance than this
    _far: dict[tuple[int, int], DataFrame] = field(default_factory=dict)
    _rows: dict[tuple[int, int, bool], DataFrame] = field(default_factory=dict)

    def far(self, low: int, high: int, metres: float) -> DataFrame:
        if (low, high) not in self._far:
            spark, obstacles = self.presence.sparkSession, _obstacles(self.presence)
            measured = with_distance(candidates(spark, low, high, self.seed), obstacles, self.far_m, FAR_M)
            self._far[low, high] = cut_lineage(measured.filter(_at_least(self.near_m)))
        return self._far[low, high].filter(_at_least(metres)).drop(FAR_M)

    def rows(self, low: int, high: int, metres: float) -> DataFrame:
        """Candidates at least ``metres`` from every presence, with their context."""
        beyond = self._band(low, high, True)
        if metres >= self.far_m:
            return beyond.drop(FAR_M)
        return beyond.unionByName(self._band(low, high, False)).filter(_at_least(metres)).drop(FAR_M)

    def _band(self, low: int, high: int, beyond: bool) -> DataFrame:
        if (low, high, beyond) not in self._rows:
            self.far(low, high, self.near_m)
            rows = self._far[low, high]
            rows = rows.filter(_at_least(self.far_m) if beyond else ~_at_least(self.far_m))
            self._rows[low, high, beyond] = cut_lineage(self.context(rows))
        return self._rows[low, high, beyond]


def _at_least(metres: float) -> Column:
    return F.col(FAR_M).isNull() | (F.col(FAR_M) >= metres)


def _calendar(df: DataFrame) -> DataFrame:
    """Year, month, day of year and season of ``date``."""
    return df.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "day_of_year": F.dayofyear("date"),
            "season": temporal.season_code(F.month("date")),
        }
    )


def temporally_matched(
    presence: DataFrame, n: int, key: str, seed: int = 42, min_distance_m: float = 2000.0, jitter: bool = True
) -> DataFrame:
    """Random places far from presences with a drawn presence date.

    ``jitter`` moves the day by up to three within its month; callers leave it off for
    presence tables of 100 dates or fewer. The dataset is drawn on its own, by its share of
    the presence rows.
    """
    placed = fill(n, _far_ranges(presence, seed, min_distance_m))
    dated = _draw_presence(placed, presence, key, ["date"], seed, "date")
    picked = _draw_presence(dated, presence, key, ["dataset"], seed, "dataset")
    if jitter:
        shift = F.floor(hash_uniform(seed, "jitter", F.col("candidate_id")) * 7) - 3
        day = F.least(F.greatest(F.dayofmonth("date") + shift, F.lit(1)), F.dayofmonth(F.last_day("date")))
        picked = picked.withColumn("date", F.make_date(F.year("date"), F.month("date"), day.cast("int")))
    return _finish(_calendar(picked), "temporal_matched", "medium")


def seasonal_segregation(
    presence: DataFrame, n: int, key: str, seed: int = 42, offset_months: int = 6, offsets: dict[str, int] | None = None
) -> DataFrame:
    """Presence places dated half a year (or the dataset's offset) later."""
    rows = sample_rows(presence.select(key, "latitude", "longitude", "date", "dataset"), n, [key], seed, "season")
    shift = F.lit(offset_months)
    for name, months in (SEASON_OFFSETS if offsets is None else offsets).items():
        shift = F.when(F.col("dataset") == name, months).otherwise(shift)
    out = rows.withColumns(
        {
            "original_date": F.col("date"),
            "source_dataset": F.col("dataset"),
            "date": F.add_months("date", shift),
        }
    )
    return _finish(out, "seasonal_segregation", "high")


def unsuitable_season(
    presence: DataFrame, n: int, elevation: Callable[[DataFrame], DataFrame] | None, seed: int = 42, rules: str = "config"
) -> DataFrame:
    """Places too high or too low for the season; ``n // rules`` rows per rule.

    ``elevation`` adds ``elevation_ft``; without it only the months of a rule apply. The
    remainder of n divided by the number of rules is not drawn.
    """
    table = habitat.SEASON_ELEVATION_RULES[rules]
    spark = presence.sparkSession
    first, last = _year_span(presence)
    parts = []
    for i, (name, months, op, feet) in enumerate(table):

        def accept(low: int, high: int, i=i, name=name, months=months, op=op, feet=feet) -> DataFrame:
            c = candidates(spark, low, high, seed + i + 1)
            if elevation is not None:
                c = elevation(c)
                e = F.col("elevation_ft")
                c = c.filter(F.coalesce((e >= feet) if op == ">=" else (e <= feet), F.lit(True)))
            month = _pick(months, hash_uniform(seed + i + 1, "month", F.col("candidate_id")))
            return c.withColumns({"rule": F.lit(name), "month": month, "_seed": F.lit(seed + i + 1)})

        parts.append(fill(n // len(table), accept))
    kept = reduce(lambda a, b: a.unionByName(b), parts)
    u = lambda stream: F.conv(
        F.substring(F.md5(F.concat_ws("|", F.col("_seed").cast("string"), F.lit(stream), F.col("candidate_id").cast("string"))), 1, 13), 16, 10
    ).cast("bigint") / F.lit(4503599627370496.0)
    dated = kept.withColumn("_year", (first + F.floor(u("year") * (last - first + 1))).cast("int"))
    dated = dated.withColumn("date", random_day(F.col("_year"), F.col("month"), u("day")))
    return _finish(dated.drop("_year", "month", "_seed"), "unsuitable_temporal_environmental", "high")


def random_temporal(
    presence: DataFrame, n: int, seed: int = 42, min_distance_m: float = 500.0
) -> DataFrame:
    """Uniform place, year, month and day at least ``min_distance_m`` from presences."""
    far = fill(n, _far_ranges(presence, seed, min_distance_m))
    first, last = _year_span(presence)
    k = F.col("candidate_id")
    dated = far.withColumns(
        {
            "_year": (first + F.floor(hash_uniform(seed, "year", k) * (last - first + 1))).cast("int"),
            "_month": (F.floor(hash_uniform(seed, "month", k) * 12) + 1).cast("int"),
        }
    ).withColumn("date", random_day(F.col("_year"), F.col("_month"), hash_uniform(seed, "day", k)))
    return _finish(dated.drop("_year", "_month"), "random_background", "low")


def environmental(
    presence: DataFrame, n: int, context: Callable[[DataFrame], DataFrame], seed: int = 42, min_distance_m: float = 2000.0,
    shared: SharedRanges | None = None,
) -> DataFrame:
    """Suitable habitat without presences; ``context`` adds elevation, slope and water."""
    far = _far_ranges(presence, seed, min_distance_m)
    rows = (lambda low, high: shared.rows(low, high, min_distance_m)) if shared else (lambda low, high: context(far(low, high)))
    ok = habitat.suitable(F.col("elevation_ft"), F.col("slope_degrees"), F.col("water_distance_miles"))
    return _finish(fill(n, lambda low, high: rows(low, high).filter(ok), shared and shared.first), "environmental", None)


def unsuitable_habitat(
    presence: DataFrame, n: int, context: Callable[[DataFrame], DataFrame], seed: int = 42,
    min_distance_m: float = 500.0, variant: str = "full", shared: SharedRanges | None = None,
) -> DataFrame:
    far = _far_ranges(presence, seed, min_distance_m)

    def accept(low: int, high: int) -> DataFrame:
        rows = shared.rows(low, high, min_distance_m) if shared else context(far(low, high))
        cover = F.col("land_cover_code") if "land_cover_code" in rows.columns else None
        water = F.coalesce("water_distance_miles", F.lit(NO_WATER_MILES))
        return rows.filter(habitat.unsuitable(F.col("elevation_ft"), F.col("slope_degrees"), water, cover, variant))

    return _finish(fill(n, accept, shared and shared.first), "unsuitable", None)


def random_background(
    presence: DataFrame, n: int, seed: int = 42, min_distance_m: float = 500.0, shared: SharedRanges | None = None
) -> DataFrame:
    far = (lambda low, high: shared.far(low, high, min_distance_m)) if shared else _far_ranges(presence, seed, min_distance_m)
    return _finish(fill(n, far, shared and shared.first), "background", None)


def opposite_season_date(date: Column, u: Column) -> Column:
    """Summer to a winter month and back; other months move by six. Day at most 28."""
    m, y = F.month(date), F.year(date)
    day = F.least(F.dayofmonth(date), F.lit(28))
    winter = _pick([12, 1, 2], u)
    summer = _pick([6, 7, 8], u)
    month = (
        F.when(m.isin(6, 7, 8), winter)
        .when(m.isin(12, 1, 2), summer)
        .otherwise(F.when(m == 6, 12).otherwise((m + 6) % 12))
    )
    year = (
        F.when(m.isin(6, 7, 8), F.when(winter == 12, y).otherwise(y + 1))
        .when(m.isin(12, 1, 2), y)
        .otherwise(y + F.when(m > 6, 1).otherwise(0))
    )
    return F.make_date(year, month, day)


def opposite_season(presence: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    rows = sample_rows(presence.select(key, "latitude", "longitude", "date"), n, [key], seed, "opposite")
    u = hash_uniform(seed, "opposite_month", F.col(key))
    out = rows.withColumns({"original_date": F.col("date"), "date": opposite_season_date(F.col("date"), u)})
    return _finish(out, "temporal", None)


def with_presence_dates(absences: DataFrame, presence: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Date, year, month, day of year and season drawn from the presence dates."""
    dated = _draw_presence(absences, presence.filter(F.col("date").isNotNull()), key, ["date"], seed, "metadata")
    return _calendar(dated)


def mix(presence: DataFrame, n_presence: int, key: str, context: Callable[[DataFrame], DataFrame], seed: int = 42) -> dict[str, DataFrame]:
    """All strategies of the default mix at their shares, each with as many rows as wanted.

    Three of them filter the same candidates, so they share the search among the presences.
    """
    wanted = targets(n_presence)
    first = first_range(max(wanted[k] for k in ("environmental", "unsuitable", "background")))
    shared = SharedRanges(presence, context, seed, first, near_m=500.0, far_m=2000.0)
    dated = lambda df: with_presence_dates(df, presence, key, seed)
    return {
        "environmental": dated(environmental(presence, wanted["environmental"], context, seed, shared=shared)),
        "unsuitable": dated(unsuitable_habitat(presence, wanted["unsuitable"], context, seed, shared=shared)),
        "background": dated(random_background(presence, wanted["background"], seed, shared=shared)),
        "temporal": opposite_season(presence, wanted["temporal"], key, seed),
    }


def _finish(df: DataFrame, strategy: str, confidence: str | None) -> DataFrame:
    new = {"absence_strategy": F.lit(strategy), TARGET: F.lit(0)}
    if confidence:
        new["confidence"] = F.lit(confidence)
    return df.withColumns(new)


def assemble(presence: DataFrame, absences: list[DataFrame], key: list[str], seed: int = 42) -> DataFrame:
    """Presence and absence rows in one table, columns by name, in seeded order."""
    merged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [a.withColumn(TARGET, F.lit(0)) for a in absences],
        presence.withColumn(TARGET, F.lit(1)),
    )
    return shuffle_order(merged.select(*sorted(merged.columns)), key, seed)


def validate_separation(presence: DataFrame, absences: DataFrame, cap_km: float = 100.0) -> DataFrame:
    """Distance of absences to their nearest presence, pass flag and class ratio."""
    from terrasift.operators.nearest import nearest
    from terrasift.operators.quantiles import exact_quantiles

    ids = presence.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(0).alias("presence_id"))
    near = nearest(absences, ids, cap_km, "presence_id", out="_near").select(
        (F.col("_near.distance_km") * 1000).alias("metres")
    )
    stats = near.agg(
        F.count(F.lit(1)).alias("n_absence"), F.avg("metres").alias("mean_m"), F.min("metres").alias("min_m")
    )
    median = exact_quantiles(near, ["metres"], [0.5]).select(F.col("value").alias("median_m"))
    ratio = F.col("n_absence") / F.nullif(F.col("n_presence"), F.lit(0))
    return (
        stats.withColumns(
            {"median_m": median.scalar(), "n_presence": presence.agg(F.count(F.lit(1))).scalar()}
        )
        .withColumns(
            {
                "class_ratio": ratio,
                "separated": F.col("mean_m") >= 1000,
                "balanced": ratio.between(0.5, 2.0),
            }
        )
    )
