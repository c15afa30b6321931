"""Habitat factors: each returns one struct Column with score, confidence and notes.

A factor is any function ``(Inputs, date) -> Column``; register more with
:func:`register_factor`. Missing inputs take a factor's documented default; inputs
without a default make the factor null.

Values used more than once go through :meth:`Inputs.let`, which materialises them as
columns of an earlier projection. Inlined, the nested CASE expressions would multiply
and outgrow a generated method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.temporal import rut_phase, season_name


class Inputs:
    """Feature columns by name, with defaults for absent or null values."""

    def __init__(self, columns: Iterable[str], as_of: Column | None = None, options: dict | None = None):
        self.columns = set(columns)
        self.as_of = as_of if as_of is not None else F.current_date()
        self.options = options or {}
        self.stages: dict[int, dict[str, Column]] = {}

    def let(self, level: int, name: str, expr: Column) -> Column:
        """Name an intermediate value; ``level`` n may use columns of levels below n."""
        full = f"__{name}"
        self.stages.setdefault(level, {}).setdefault(full, expr)
        return F.col(full)

    def month(self, date: Column) -> Column:
        return self.let(1, "month", F.month(date))

    def rut_phase(self, date: Column) -> Column:
        return self.let(2, "phase", rut_phase(self.month(date), F.dayofmonth(date)))

    def season(self, date: Column) -> Column:
        return self.let(2, "season", season_name(self.month(date)))

    def staged(self, df: DataFrame) -> DataFrame:
        for level in sorted(self.stages):
            df = df.withColumns(self.stages[level])
        return df

    def has(self, name: str) -> bool:
        return name in self.columns

    def get(self, name: str, default=None, type_: str = "double") -> Column:
        fallback = default if isinstance(default, Column) else F.lit(default).cast(type_)
        if name not in self.columns:
            return fallback
        if default is None:
            return F.col(name).cast(type_)
        return F.coalesce(F.col(name).cast(type_), fallback)


def factor_struct(score, confidence, status, note, raw, **metadata) -> Column:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        score.cast("double").alias("score"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        (status if isinstance(status, Column) else F.lit(status)).alias("status"),
        note.alias("note"),
        raw.cast("string").alias("raw_value"),
        meta.alias("metadata"),
    )


def normalize_score(raw: Column, low: float, high: float, inverse: bool = False) -> Column:
    unit = F.least(F.greatest((raw - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return (1 - unit) * 10 if inverse else unit * 10


def score_status(score: Column) -> Column:
    return (
        F.when(score >= 9, "excellent")
        .when(score >= 7, "good")
        .when(score >= 5, "fair")
        .when(score >= 3, "poor")
        .when(score.isNotNull(), "critical")
    )


def _text(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def _tag(condition: Column, text) -> Column:
    """Optional note suffix; empty when the condition is false or null."""
    return F.when(condition, text if isinstance(text, Column) else F.lit(text)).otherwise("")


# Month -> (optimal low, optimal high, acceptable low, acceptable high), feet.
ELEVATION_BANDS = {
    1: (6500, 7500, 6000, 8000),
    2: (6500, 7500, 6000, 8000),
    3: (7000, 8000, 6500, 8500),
    4: (7500, 8500, 7000, 9000),
    5: (8000, 9000, 7500, 9500),
    6: (9500, 10500, 9000, 11000),
    7: (9500, 10500, 9000, 11000),
    8: (9500, 10500, 9000, 11000),
    9: (9000, 10000, 8500, 10500),
    10: (8500, 9500, 8000, 10000),
    11: (8000, 9000, 7500, 9500),
    12: (7000, 8000, 6500, 8500),
}
EARLY_RUT_BAND = (9000, 10000, 8500, 10500)


def elevation(x: Inputs, date: Column) -> Column:
    e = x.get("elevation_ft")
    month = x.month(date)
    early_rut = x.let(2, "early_rut", (month == 9) | ((month == 10) & (F.dayofmonth(date) < 10)))

    def bound(k: int) -> Column:
        by_month = F.element_at(F.array(*[F.lit(float(ELEVATION_BANDS[m][k])) for m in range(1, 13)]), month)
        raised = F.greatest(by_month, F.when(early_rut, float(EARLY_RUT_BAND[k])))
        return x.let(3, f"elevation_band_{k}", raised)

    lo, hi, mn, mx = (bound(k) for k in range(4))
    gap = F.when(e < mn, mn - e).otherwise(e - mx)
    outside = x.let(4, "elevation_outside", F.greatest(F.lit(0.0), 7.0 - gap / 1000 * 5))
    edge = F.when(e < lo, (lo - e) / (lo - mn)).otherwise((e - hi) / (mx - hi))
    optimal, accepted = e.between(lo, hi), e.between(mn, mx)
    score = F.when(e.isNull(), None).when(optimal, 10.0).when(accepted, 10.0 - edge * 3.0).otherwise(outside)
    status = (
        F.when(e.isNull(), None)
        .when(optimal, "excellent")
        .when(accepted, "good")
        .when(outside > 3, "poor")
        .otherwise("critical")
    )
    fit = (
        F.when(optimal, F.concat(F.lit("is optimal for "), F.date_format(date, "MMMM")))
        .when(accepted, F.concat(F.lit("is acceptable for "), F.date_format(date, "MMMM")))
        .when(e < mn, "is below preferred range")
        .otherwise("is above preferred range")
    )
    note = F.concat(F.lit("Elevation "), _text(e), F.lit("ft "), fit)
    return factor_struct(
        score, 0.95, status, note, e, elevation_ft=e, month=month, optimal_low=lo, optimal_high=hi
    )


def snow_conditions(x: Inputs, date: Column) -> Column:
    d = x.get("snow_depth_inches", 0.0)
    crust = x.get("snow_crust_detected", False, "boolean")
    d = x.let(1, "snow_depth", d)
    deep = F.greatest(F.lit(0.0), 3.0 - (d - 30.0) / 10.0)
    base = (
        F.when(d <= 6, 10.0)
        .when(d <= 18, 10.0 - (d - 6.0) / 12.0 * 3.0)
        .when(d <= 30, 7.0 - (d - 18.0) / 12.0 * 4.0)
        .otherwise(deep)
    )
    status = (
        F.when(d <= 6, "excellent")
        .when(d <= 18, "good")
        .when(d <= 30, "fair")
        .when(deep > 1, "poor")
        .otherwise("critical")
    )
    crusted = crust & (d > 6)
    ahead = x.let(1, "days_ahead", F.datediff(date, x.as_of))
    confidence = F.when(ahead <= 3, 0.90).when(ahead <= 7, 0.75).otherwise(0.60)
    note = F.concat(F.lit("Snow depth "), _text(d, 1), F.lit(" in"), _tag(crusted, " [crusted]"))
    return factor_struct(
        base * F.when(crusted, 0.7).otherwise(1.0),
        confidence,
        status,
        note,
        d,
        snow_depth_inches=d,
        snow_crust=crust,
        forecast_days_out=ahead,
    )


def water_distance(x: Inputs, date: Column) -> Column:
    d = x.get("water_distance_miles")
    reliability = x.let(1, "water_reliability", x.get("water_reliability", 1.0))
    d = x.let(1, "water_distance", d)
    far = F.greatest(F.lit(0.0), 3.0 - (d - 2.0))
    base = (
        F.when(d <= 0.25, 10.0)
        .when(d <= 1.0, 10.0 - (d - 0.25) / 0.75 * 3.0)
        .when(d <= 2.0, 7.0 - (d - 1.0) * 4.0)
        .when(d.isNotNull(), far)
    )
    status = (
        F.when(d <= 0.25, "excellent")
        .when(d <= 1.0, "good")
        .when(d <= 2.0, "fair")
        .when(far > 1, "poor")
        .when(d.isNotNull(), "critical")
    )
    note = F.concat(F.lit("Water "), _text(d, 2), F.lit(" mi away"))
    return factor_struct(
        base * reliability,
        F.when(reliability > 0.8, 0.85).otherwise(0.70),
        status,
        note,
        d,
        distance_miles=d,
        water_reliability=reliability,
        base_score=base,
    )


# NDVI cuts (poor, good, excellent) by season.
NDVI_CUTS = {
    "spring": (0.3, 0.5, 0.7),
    "summer": (0.5, 0.7, 0.85),
    "fall": (0.3, 0.5, 0.65),
    "winter": (0.2, 0.3, 0.4),
}


def vegetation_quality(x: Inputs, date: Column) -> Column:
    ndvi = x.get("ndvi")
    irg = x.get("irg", 0.0)
    precip = x.get("precip_last_7_days_inches", 0.0)
    cloud = x.get("cloud_cover_percent", 0.0)
    age = x.get("ndvi_age_days", 0.0)
    season = x.season(date)

    def cut(k: int) -> Column:
        expr = F.lit(None).cast("double")
        for name, cuts in NDVI_CUTS.items():
            expr = F.when(season == name, cuts[k]).otherwise(expr)
        return x.let(3, f"ndvi_cut_{k}", expr)

    poor, good, best = cut(0), cut(1), cut(2)
    base = (
        F.when(ndvi >= best, 10.0)
        .when(ndvi >= good, 7.0 + (ndvi - good) / (best - good) * 3.0)
        .when(ndvi >= poor, 4.0 + (ndvi - poor) / (good - poor) * 3.0)
        .when(ndvi.isNotNull(), F.greatest(F.lit(0.0), 4.0 * (ndvi / poor)))
    )
    status = (
        F.when(ndvi >= best, "excellent")
        .when(ndvi >= good, "good")
        .when(ndvi >= poor, "fair")
        .when(ndvi.isNotNull(), "poor")
    )
    base = x.let(4, "vegetation_base", base)
    ten = F.lit(10.0)
    greening = (season == "spring") & (irg > 0.01)
    browning = (season == "fall") & (irg < -0.01)
    timed = F.when(ndvi.isNull(), None).when(greening, F.least(ten, base * 1.15)).when(browning, base * 0.9).otherwise(base)
    timed = x.let(5, "vegetation_timed", timed)
    wet = (precip > 0.5) & (season != "winter")
    score = F.when(ndvi.isNull(), None).when(wet, F.least(ten, timed * 1.1)).otherwise(timed)
    confidence = F.greatest(
        F.lit(0.5),
        F.lit(0.85)
        - F.when(cloud > 30, 0.15).otherwise(0.0)
        - F.when(age > 16, 0.10).otherwise(0.0),
    )
    note = F.concat(
        F.lit("NDVI "), _text(ndvi, 2), F.lit(" in "), season,
        _tag(greening, " [greening]"), _tag(browning, " [browning]"), _tag(wet, " [recent rain]"),
    )
    return factor_struct(
        score, confidence, status, note, ndvi,
        ndvi=ndvi, irg=irg, season=season, recent_precipitation=precip,
        cloud_cover=cloud, data_age_days=age,
    )


# Open seasons (first day, last day), inclusive.
HUNTING_SEASONS = {
    "archery": ("2026-09-01", "2026-09-30"),
    "rifle_1": ("2026-10-01", "2026-10-14"),
    "rifle_2": ("2026-10-15", "2026-10-31"),
    "rifle_3": ("2026-11-01", "2026-11-14"),
}


def hunting_season(date: Column, every_year: bool = False) -> Column:
    """Name of the open season or null. ``every_year`` ignores the calendar year."""
    expr = F.lit(None).cast("string")
    for name, (first, last) in reversed(list(HUNTING_SEASONS.items())):
        if every_year:
            key = F.month(date) * 100 + F.dayofmonth(date)
            inside = key.between(int(first[5:7] + first[8:]), int(last[5:7] + last[8:]))
        else:
            inside = date.between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
        expr = F.when(inside, name).otherwise(expr)
    return expr


def hunting_pressure(x: Inputs, date: Column) -> Column:
    road = x.get("road_distance_miles")
    trail = x.get("trail_distance_miles")
    security = x.get("security_habitat_percent", 50.0)
    # a missing or zero trail distance counts as the road distance
    access = F.least(road, F.when(trail == 0, road).otherwise(F.coalesce(trail, road)))
    d = x.let(1, "access_distance", F.when(road.isNotNull(), access))
    season = x.let(1, "hunting_season", hunting_season(date, bool(x.options.get("seasons_every_year"))))
    open_season = season.isNotNull()
    peak = F.coalesce(x.rut_phase(date) == "peak_rut", F.lit(False))
    middle = 5.0 + (d - 0.5) * 5.0
    hunted = (
        F.when(d >= 1.5, 10.0)
        .when(d >= 0.5, middle)
        .when(d.isNotNull(), F.greatest(F.lit(1.0), 5.0 * (d / 0.5)))
    )
    hunted = hunted * F.when(peak & (d >= 0.5), 1.05).otherwise(1.0)
    base = F.when(open_season, hunted).otherwise(F.when(d >= 0.5, 9.0).when(d.isNotNull(), 7.0))
    status = F.when(
        open_season,
        F.when(d >= 1.5, "excellent")
        .when(d >= 0.5, F.when(middle > 7, "good").otherwise("fair"))
        .when(d.isNotNull(), "poor"),
    ).otherwise(F.when(d >= 0.5, "good").when(d.isNotNull(), "fair"))
    exposed = open_season & (security < 30)
    weekend = F.weekday(date).isin(5, 6)
    score = base * F.when(exposed, 0.8).otherwise(1.0)
    score = score * F.when(open_season & weekend, 0.85).otherwise(1.0)
    if x.options.get("clamp_hunting_pressure"):
        score = F.least(score, F.lit(10.0))
    note = F.concat(
        F.lit("Access "), _text(d, 1), F.lit(" mi, "),
        F.when(open_season, F.concat(F.lit("open season "), season)).otherwise("closed season"),
        _tag(exposed, " [limited escape terrain]"), _tag(open_season & weekend, " [weekend]"),
    )
    return factor_struct(
        score, 0.80, status, note, d,
        min_access_distance=d, in_hunting_season=open_season,
        season_name=F.coalesce(season, F.lit("closed")), security_cover_percent=security,
        is_weekend=weekend,
    )


def security_habitat(x: Inputs, date: Column) -> Column:
    slope = x.get("slope_degrees", 0.0)
    canopy = x.get("canopy_cover_percent", 0.0)
    road = x.get("road_distance_miles", 0.0)
    trail = x.get("trail_distance_miles", road)
    secure = x.let(1, "is_secure", (slope > 40) | (canopy > 70) | ((road > 2.5) & (trail > 1.5)))
    pct = x.let(2, "security_percent", x.get("security_habitat_percent", F.when(secure, 50.0).otherwise(20.0)))
    ten = F.lit(10.0)
    base = (
        F.when(pct >= 40, 10.0)
        .when(pct >= 30, 7.0 + (pct - 30.0) / 10.0 * 3.0)
        .when(pct >= 20, 4.0 + (pct - 20.0) / 10.0 * 3.0)
        .otherwise(F.greatest(F.lit(1.0), 4.0 * (pct / 20.0)))
    )
    status = F.when(pct >= 40, "excellent").when(pct >= 30, "good").when(pct >= 20, "fair").otherwise("poor")
    # raw scores never exceed 10, so capping after a factor of 1 changes nothing
    base = F.least(ten, base * F.when(secure, 1.1).otherwise(1.0))
    phase = x.rut_phase(date)
    boosted = phase.isin("pre_rut", "peak_rut")
    boost = F.when(phase == "peak_rut", 1.2).when(phase == "pre_rut", 1.15).otherwise(1.0)
    score = x.let(3, "security_score", F.least(ten, base * boost))
    status = (
        F.when(boosted & (score >= 9), "excellent")
        .when(boosted & (score >= 7) & status.isin("fair", "poor"), "good")
        .otherwise(status)
    )
    note = F.concat(
        F.lit("Security habitat "), _text(pct), F.lit("% in area"),
        _tag(secure, " [location is secure]"),
        _tag(slope > 40, " [steep]"), _tag(canopy > 70, " [dense cover]"), _tag(road > 2.5, " [remote]"),
    )
    return factor_struct(
        score, 0.85, status, note, pct,
        security_percent=pct, is_security_habitat=secure, slope_degrees=slope,
        canopy_cover=canopy, road_distance=road, rut_phase=phase,
    )


def predation_risk(x: Inputs, date: Column) -> Column:
    wolves = x.get("wolves_per_1000_elk", 0.0)
    bears = x.get("bear_activity_distance_miles", 10.0)
    snow = x.get("snow_depth_inches", 0.0)
    security = x.get("security_habitat_percent", 30.0)
    calving = x.month(date).isin(5, 6)
    wolf_cost = (
        F.when(wolves > 5, F.least(F.lit(3.0), (wolves - 5.0) * 0.3)).when(wolves > 2.5, 0.5).otherwise(0.0)
    )
    snow_cost = F.when(snow.between(12, 18), 1.5).otherwise(0.0)
    bear_cost = F.when(calving & (bears < 3), 2.0 * (1 - bears / 3.0)).otherwise(0.0)
    raw = F.lit(7.0) - wolf_cost - snow_cost - bear_cost
    # the sum before the bonus stays below 10, so one cap covers both branches
    raw = raw + F.when(security > 40, 1.0).otherwise(0.0)
    score = x.let(2, "predation_score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)))
    status = F.when(score >= 8, "excellent").when(score >= 6, "good").when(score >= 4, "fair").otherwise("poor")
    level = F.when(score >= 8, "Low").when(score >= 6, "Moderate").when(score >= 4, "Elevated").otherwise("High")
    risks = F.array_compact(
        F.array(
            F.when(wolves > 5, "high wolf density").when(wolves > 2.5, "moderate wolves"),
            F.when(snow.between(12, 18), "wolf-favourable snow"),
            F.when(calving & (bears < 3), "bears near calving ground"),
        )
    )
    note = F.concat(
        level, F.lit(" predation risk"),
        F.when(F.size(risks) > 0, F.concat(F.lit(": "), F.array_join(risks, ", "))).otherwise(""),
    )
    confidence = (x.get("wolf_data_quality", 0.7) + x.get("bear_data_quality", 0.6)) / 2
    return factor_struct(
        score, confidence, status, note, F.to_json(F.struct(wolves.alias("wolves"), bears.alias("bears"))),
        wolf_density=wolves, bear_distance_miles=bears, snow_depth_inches=snow,
        security_percent=security, is_calving_season=calving, risk_factors=F.array_join(risks, ", "),
    )


def nutritional_condition(x: Inputs, date: Column) -> Column:
    summer = x.get("summer_integrated_ndvi", x.get("ndvi", 0.5) * 90)
    stress = (10.0 - x.get("predation_score", 7.0)) / 10.0
    pregnancy = x.get("pregnancy_rate", 0.90)
    fat = x.let(1, "body_fat", (9.0 + (summer - 45) * 0.2) * (1 - stress * 0.15))
    score = (
        F.when(fat >= 13.7, 10.0)
        .when(fat >= 11.0, 7.0 + (fat - 11.0) / (13.7 - 11.0) * 3.0)
        .when(fat >= 7.9, 4.0 + (fat - 7.9) / (11.0 - 7.9) * 3.0)
        .otherwise(F.greatest(F.lit(1.0), 4.0 * (fat / 7.9)))
    )

    def tier(a, b, c, d):
        return F.when(fat >= 13.7, a).when(fat >= 11.0, b).when(fat >= 7.9, c).otherwise(d)

    status = tier("excellent", "good", "fair", "poor")
    calf, cow = tier(80, 65, 45, 35), tier(97, 93, 88, 85)
    month = x.month(date)
    confidence = F.when(month.isin(9, 10, 11), 0.75).when(month.isin(12, 1, 2, 3), 0.80).otherwise(0.60)
    note = F.concat(F.initcap(status), F.lit(" body condition (~"), _text(fat, 1), F.lit("% fat)"))
    return factor_struct(
        score, confidence, status, note, fat,
        estimated_body_fat_pct=fat, summer_integrated_ndvi=summer, predation_stress=stress,
        pregnancy_rate=pregnancy, predicted_calf_survival=calf, predicted_cow_survival=cow,
        recruitment_rate=pregnancy * calf / 100,
    )


def winter_severity(x: Inputs, date: Column) -> Column:
    """Scores a ``winter_severity_index`` column (see operators.snow); 0 when absent."""
    wsi = x.get("winter_severity_index", 0.0)
    extreme = F.greatest(F.lit(0.0), 3.0 - (wsi - 6000) / 2000 * 3.0)
    score = (
        F.when(wsi < 2000, 10.0)
        .when(wsi < 4000, 10.0 - (wsi - 2000) / 2000 * 3.0)
        .when(wsi < 6000, 7.0 - (wsi - 4000) / 2000 * 4.0)
        .otherwise(extreme)
    )

    def tier(a, b, c, d):
        return F.when(wsi < 2000, a).when(wsi < 4000, b).when(wsi < 6000, c).otherwise(d)

    status = tier("excellent", "good", "fair", F.when(extreme > 1, "poor").otherwise("critical"))
    confidence = F.when(x.month(date).isin(11, 12, 1, 2, 3, 4), 0.80).otherwise(0.95)
    klass = tier("mild", "moderate", "severe", "extreme")
    note = F.concat(F.initcap(klass), F.lit(" winter (WSI: "), _text(wsi), F.lit(")"))
    return factor_struct(
        score, confidence, status, note, wsi,
        wsi=wsi, mortality_estimate=tier("<5%", "5-15%", "15-30%", ">30%"), winter_severity=klass,
    )


def rut_behavior(x: Inputs, date: Column) -> Column:
    """``options['rut_forest_column']`` names the land-cover column of the forest boost.

    It defaults to ``nlcd_code``, which the assembled context does not carry, so the
    boost stays off unless asked for.
    """
    phase = x.rut_phase(date)
    peak = phase == "peak_rut"
    e = x.get("elevation_ft")
    canopy = x.get("canopy_cover_percent", 0.0)
    slope = x.get("slope_degrees", 0.0)
    security = x.get("security_habitat_percent", 0.0)
    code = x.get(x.options.get("rut_forest_column", "nlcd_code"), None, "int")
    terrain = F.least(
        F.lit(2.5),
        F.when(canopy.between(30, 60), 0.8).otherwise(0.0)
        + F.when((e > 8500) & slope.between(15, 35), 0.6).otherwise(0.0)
        + F.when(code.isin(41, 42, 43), 0.3).otherwise(0.0),
    )
    strength = F.when(peak, 1.0).when(phase == "pre_rut", 0.7).otherwise(0.5)
    high = (
        F.when(e.between(8500, 10000), F.when(peak, 0.5).otherwise(0.3))
        .when(e.between(8000, 10500), F.when(peak, 0.2).otherwise(0.1))
        .otherwise(0.0)
    )
    cover = (
        F.when(security >= 40, F.when(peak, 0.6).otherwise(0.4))
        .when(security >= 30, F.when(peak, 0.3).otherwise(0.2))
        .otherwise(0.0)
    )
    score = x.let(
        3,
        "rut_score",
        F.when(phase.isNull(), 7.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(10.0), 7.0 + terrain * strength + high + cover))
        ),
    )
    status = F.when(phase.isNull(), "good").otherwise(score_status(score))
    note = F.when(phase.isNull(), "Outside rut period").otherwise(
        F.concat(F.initcap(F.regexp_replace(phase, "_", " ")), F.lit(" adjustments applied"))
    )
    return factor_struct(
        score, F.when(phase.isNull(), 0.9).otherwise(0.85), status, note, phase,
        rut_phase=phase, is_rut_period=phase.isNotNull(), terrain_boost=terrain,
        elevation_boost=high, security_boost=cover,
    )


def ml_prediction(x: Inputs, date: Column) -> Column:
    """Scores columns ``ml_probability`` and ``ml_missing_share`` (0 when absent)."""
    p = x.get("ml_probability")
    missing = x.get("ml_missing_share", 0.0)
    unusable = (missing > 0.3) | p.isNull()
    confidence = x.let(
        1, "model_confidence", F.abs(p - 0.5) * 2.0 * F.when(missing > 0, 1.0 - missing).otherwise(1.0)
    )
    status = (
        F.when(unusable | (confidence < 0.2), "fair")
        .when(p >= 0.7, "excellent")
        .when(p >= 0.5, "good")
        .when(p >= 0.3, "fair")
        .when(p >= 0.15, "poor")
        .otherwise("critical")
    )
    note = F.when(unusable, "Too many missing features for a model score").otherwise(
        F.concat(F.lit("Model probability "), _text(p * 100), F.lit("%"))
    )
    return factor_struct(
        F.when(unusable, 5.0).otherwise(p * 10.0),
        F.when(unusable, 0.1).otherwise(confidence),
        status,
        note,
        F.when(unusable, 0.5).otherwise(p),
        prediction_available=~unusable,
        missing_share=missing,
    )


Factor = Callable[[Inputs, Column], Column]

# name -> (default weight, factor); order decides ties between equal scores.
FACTORS: dict[str, tuple[float, Factor]] = {
    "elevation": (1.0, elevation),
    "snow_conditions": (1.0, snow_conditions),
    "water_distance": (1.0, water_distance),
    "vegetation_quality": (1.0, vegetation_quality),
    "hunting_pressure": (1.0, hunting_pressure),
    "security_habitat": (1.0, security_habitat),
    "predation_risk": (1.0, predation_risk),
    "nutritional_condition": (1.0, nutritional_condition),
    "winter_severity": (1.0, winter_severity),
    "rut_behavior": (1.0, rut_behavior),
    "ml_prediction": (2.0, ml_prediction),
}

RULE_FACTORS = [name for name in FACTORS if name != "ml_prediction"]


def register_factor(name: str, factor: Factor, weight: float = 1.0) -> None:
    FACTORS[name] = (weight, factor)


FIELDS = ("score", "confidence", "status")
DETAILS = ("note", "raw_value", "metadata")


def with_scores(
    df: DataFrame,
    factors: Iterable[str] = RULE_FACTORS,
    date_col: str = "date",
    as_of: Column | None = None,
    options: dict | None = None,
    fields: Iterable[str] = ("score",),
) -> DataFrame:
    """Flat ``<factor>_<field>`` columns; fields are score, confidence, status and
    the detail fields note, raw_value and metadata."""
    x = Inputs(df.columns, as_of, options)
    structs = {n: FACTORS[n][1](x, F.col(date_col)) for n in factors}
    flat = [structs[n][f].alias(f"{n}_{f}") for n in structs for f in fields]
    return x.staged(df).select(*df.columns, *flat)


def habitat_class(total: Column) -> Column:
    return (
        F.when(total >= 80, "excellent").when(total >= 65, "good").when(total >= 50, "fair")
        .when(total.isNotNull(), "poor")
    )


def factor_weights(factors: Iterable[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    return {n: float((weights or {}).get(n, FACTORS[n][0])) for n in factors}


def with_totals(
    df: DataFrame,
    factors: Iterable[str] = RULE_FACTORS,
    weights: dict[str, float] | None = None,
    method: str = "additive",
    clamp: bool = False,
) -> DataFrame:
    """Total score, confidence and extremes from flat score and confidence columns.

    A null factor score makes the row's totals null, as a missing required input does.
    Ties between factors go to the one listed first.
    """
    names = list(factors)
    w = factor_weights(names, weights)
    whole = sum(w.values())
    score = {n: F.col(f"{n}_score") for n in names}
    if method == "additive":
        total = sum((score[n] * w[n] for n in names[1:]), score[names[0]] * w[names[0]]) / (whole * 10) * 100
    elif method == "multiplicative":
        total = F.lit(100.0)
        for n in names:
            total = total * F.pow(score[n] / 10.0, F.lit(w[n] / whole))
    else:
        raise ValueError(f"unknown aggregation method {method!r}")
    if clamp:
        total = F.least(total, F.lit(100.0))
    out = df.withColumns(
        {
            "total_score": total,
            "overall_confidence": sum(F.col(f"{n}_confidence") * w[n] for n in names) / whole,
            "_low": F.least(*score.values()) if len(names) > 1 else score[names[0]],
            "_high": F.greatest(*score.values()) if len(names) > 1 else score[names[0]],
        }
    )

    def first_at(mark: str) -> Column:
        expr = F.lit(None).cast("string")
        for n in reversed(names):
            expr = F.when(score[n] == F.col(mark), n).otherwise(expr)
        return expr

    return out.withColumns(
        {
            "limiting_factor": first_at("_low"),
            "best_factor": first_at("_high"),
            "habitat_quality": habitat_class(F.col("total_score")),
        }
    ).drop("_low", "_high")


def score_habitat(
    df: DataFrame,
    factors: Iterable[str] = RULE_FACTORS,
    date_col: str = "date",
    weights: dict[str, float] | None = None,
    method: str = "additive",
    as_of: Column | None = None,
    options: dict | None = None,
    details: bool = False,
    clamp: bool = False,
) -> DataFrame:
    """Flat factor columns plus totals: the form every scan-heavy report uses."""
    names = list(factors)
    fields = FIELDS + DETAILS if details else FIELDS
    return with_totals(
        with_scores(df, names, date_col, as_of, options, fields), names, weights, method, clamp
    )


def with_factor_array(
    df: DataFrame,
    factors: Iterable[str] = RULE_FACTORS,
    weights: dict[str, float] | None = None,
    method: str = "additive",
) -> DataFrame:
    """Nested form: ``factors`` as ``array<struct<factor, weight, score, ...>>``.

    ``contribution_pct`` relates a contribution to the 0-100 total, so the shares do not
    add up to 100; it is null when the total is 0 and for multiplicative totals.
    """
    names = list(factors)
    w = factor_weights(names, weights)
    items = []
    for n in names:
        present = [f for f in FIELDS + DETAILS if f"{n}_{f}" in df.columns]
        contribution = F.col(f"{n}_score") * (w[n] if method == "additive" else 1.0)
        pct = contribution / F.nullif(F.col("total_score"), F.lit(0.0)) * 100
        items.append(
            F.struct(
                F.lit(n).alias("factor"),
                F.lit(w[n]).alias("weight"),
                *[F.col(f"{n}_{f}").alias(f) for f in present],
                contribution.alias("contribution"),
                (pct if method == "additive" else F.lit(None).cast("double")).alias("contribution_pct"),
            )
        )
    flat = [f"{n}_{f}" for n in names for f in FIELDS + DETAILS]
    return df.withColumn("factors", F.array(*items)).drop(*flat)
