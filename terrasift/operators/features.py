"""Training-table preparation: column choice, rut features, transforms, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions import temporal
from terrasift.functions.vegetation import lookup
from terrasift.operators.quantiles import exact_quantiles

TARGET = "elk_present"

# Columns that never become features (matched without case).
METADATA_COLUMNS = {
    "route_id", "id", "elk_id", "aid", "point_index",
    "distance_to_area_048_km", "inside_area_048",
    "mig", "firstdate", "lastdate", "season",
    "utm_x", "utm_y", "utm_easting", "utm_northing", "easting", "northing", "zone",
    "lat", "long", "dt", "tz", "t",
    "date_time_mst", "datetime", "timestamp",
    "absence_strategy", "feedground", "date", "dataset_name", "dataset",
    "snow_station_name", "snow_station_distance_km", "snow_data_source",
    "wolf_data_quality", "bear_data_quality", "bear_activity_distance_miles",
    "wolves_per_1000_elk", "pregnancy_rate",
}

TEMPORAL_COLUMNS = {"year", "month", "day_of_year"}

# Features dropped as redundant or weak, and skewed ones to transform.
REDUNDANT_FEATURES = [
    "snow_water_equiv_inches",
    "cloud_adjusted_illumination",
    "moon_altitude_midnight",
    "moon_phase",
]
SKEWED_FEATURES = {"security_habitat_percent": "log1p"}

STUDY_AREA = {"min_lat": 41.0, "max_lat": 45.0, "min_lon": -111.0, "max_lon": -104.0}
OUTLIER_BOUNDS = {"min_lat": 40.99, "max_lat": 45.01, "min_lon": -111.06, "max_lon": -104.05}

# Constants that mark unfilled features, per consumer.
PLACEHOLDERS: dict[str, dict[str, list]] = {
    "integrate": {
        "elevation_ft": [8500.0], "slope_degrees": [15.0], "aspect_degrees": [180.0],
        "canopy_cover_percent": [30.0], "water_distance_miles": [0.5], "water_reliability": [0.5],
        "land_cover_code": [0], "road_distance_miles": [10.0], "trail_distance_miles": [10.0],
        "security_habitat_percent": [0.5], "snow_depth_inches": [0.0],
        "snow_water_equiv_inches": [0.0], "snow_crust_detected": [0.0], "temperature_f": [45.0],
        "precip_last_7_days_inches": [0.0], "cloud_cover_percent": [20.0], "ndvi": [0.5],
        "ndvi_age_days": [8.0], "irg": [0.0], "summer_integrated_ndvi": [0.0],
        "moon_phase": [0.5], "moon_altitude_midnight": [0.0], "effective_illumination": [0.0],
        "cloud_adjusted_illumination": [0.0],
    },
    "analyze": {
        "elevation_ft": [8500.0], "water_distance_miles": [0.5], "canopy_cover_percent": [30.0],
        "land_cover_code": [0], "temperature_f": [45.0], "precip_last_7_days_inches": [0.0],
        "ndvi": [0.3, 0.5], "ndvi_age_days": [8.0], "irg": [0.0], "summer_integrated_ndvi": [0.0],
        "moon_phase": [0.5], "moon_altitude_midnight": [0.0], "effective_illumination": [0.0],
        "cloud_adjusted_illumination": [0.0],
    },
    "assess": {
        "elevation_ft": [8500.0], "slope_degrees": [15.0], "aspect_degrees": [180.0],
        "canopy_cover_percent": [30.0], "water_distance_miles": [0.5], "land_cover_code": [0],
    },
}


def is_metadata(name: str) -> bool:
    return name.lower() in METADATA_COLUMNS


def feature_columns(df: DataFrame, exclude_temporal: bool = False) -> list[str]:
    """Sorted non-metadata columns without the target."""
    return sorted(
        c
        for c in df.columns
        if not is_metadata(c) and c != TARGET and not (exclude_temporal and c in TEMPORAL_COLUMNS)
    )


def needs_enrichment(df: DataFrame, env_columns: list[str], tolerance: float = 0.01) -> Column:
    """True when any environment column is absent, null or still at its placeholder."""
    marks = PLACEHOLDERS["integrate"]
    tests = []
    for name in env_columns:
        if is_metadata(name):
            continue
        if name not in df.columns:
            return F.lit(True)
        value = F.col(name)
        test = value.isNull()
        if not isinstance(df.schema[name].dataType, T.StringType):
            for mark in marks.get(name, []):
                test = test | (F.abs(value.cast("double") - mark) <= tolerance)
        tests.append(F.coalesce(test, F.lit(True)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def split_for_enrichment(
    df: DataFrame, env_columns: list[str], force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows to enrich, rows left alone); everything is enriched under ``force``."""
    need = F.lit(True) if force else needs_enrichment(df, env_columns)
    return df.filter(need), df.filter(~need)


def with_rut_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """``rut_phase`` ('none' outside the rut) and ``days_since_rut_start``.

    Falls back to year-free month/day-of-year columns when there is no date column.
    """
    if date_col in df.columns:
        month, day, doy = F.month(date_col), F.dayofmonth(date_col), F.dayofyear(date_col)
    else:
        month = F.col("month")
        if "day_of_year" in df.columns:
            doy = F.col("day_of_year")
        else:
            doy = temporal.day_of_year_from_cyclic(F.col("day_of_year_sin"), F.col("day_of_year_cos"))
        year = F.col("year") if "year" in df.columns else F.lit(2023)
        day = F.dayofmonth(temporal.date_from_year_day(year, doy.cast("int")))
    return df.withColumns(
        {
            "rut_phase": F.coalesce(temporal.rut_phase(month, day), F.lit("none")),
            "days_since_rut_start": temporal.days_since_rut_start(month, doy),
        }
    )


RUT_PHASE_CODES = {"none": 0, "pre_rut": 1, "peak_rut": 2, "post_rut": 3}


def with_rut_interactions(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    since = F.col("days_since_rut_start")
    for source, name in (
        ("temperature_f", "rut_days_x_temperature"),
        ("elevation_ft", "rut_days_x_elevation"),
        ("water_distance_miles", "rut_days_x_water_distance"),
    ):
        if source in df.columns:
            new[name] = since * F.col(source)
    code = F.coalesce(lookup(RUT_PHASE_CODES, F.col("rut_phase")), F.lit(0))
    if "elevation_ft" in df.columns:
        new["rut_phase_x_elevation"] = code * F.col("elevation_ft")
    if "month" in df.columns or "date" in df.columns:
        new["rut_phase_x_month"] = code * (F.col("month") if "month" in df.columns else F.month("date"))
    return df.withColumns(new)


def prepare_training(
    df: DataFrame,
    exclude_temporal: bool = False,
    include_day_of_year: bool = True,
    include_interactions: bool = False,
) -> DataFrame:
    """Training view of an enriched table: target first, features sorted by name."""
    df = with_rut_features(df)
    if include_interactions:
        df = with_rut_interactions(df)
    cols = [c for c in feature_columns(df, exclude_temporal) if c != "day_of_year"]
    if include_day_of_year and "day_of_year" in df.columns:
        s, c = temporal.day_of_year_cyclic(F.col("day_of_year"))
        df = df.withColumns({"day_of_year_sin": s, "day_of_year_cos": c})
        cols = sorted(set(cols) | {"day_of_year_sin", "day_of_year_cos"})
    elif not include_day_of_year:
        cols = [c for c in cols if c not in ("day_of_year_sin", "day_of_year_cos")]
    lead = [TARGET] if TARGET in df.columns else []
    return df.select(*lead, *cols)


def drop_redundant(df: DataFrame) -> DataFrame:
    return df.drop(*REDUNDANT_FEATURES)


def transform_skewed(df: DataFrame, transforms: dict[str, str] | None = None) -> DataFrame:
    """log1p / sqrt (shifted by a negative minimum) or cap at the 95th percentile.

    The column statistics come from one aggregate row joined as a literal, so the
    rows themselves are only projected.
    """
    transforms = {k: v for k, v in (transforms or SKEWED_FEATURES).items() if k in df.columns}
    shifted = [c for c, t in transforms.items() if t in ("log1p", "sqrt")]
    capped = [c for c, t in transforms.items() if t == "cap_95"]
    floors = {}
    if shifted:
        row = df.agg(*[F.min(c).alias(c) for c in shifted]).first()
        floors = {c: min(float(row[c]), 0.0) if row[c] is not None else 0.0 for c in shifted}
    caps = {}
    if capped:
        caps = {r["column"]: r["value"] for r in exact_quantiles(df, capped, [0.95]).collect()}
    new = {}
    for name, kind in transforms.items():
        value = F.col(name)
        if kind == "log1p":
            new[name] = F.log1p(value - floors[name])
        elif kind == "sqrt":
            new[name] = F.sqrt(value - floors[name])
        elif kind == "cap_95":
            new[name] = F.least(value, F.lit(caps.get(name)))
        else:
            raise ValueError(f"unknown transform {kind!r}")
    return df.withColumns(new)


def inside_box(lat: Column, lon: Column, bounds: dict[str, float] = STUDY_AREA) -> Column:
    return lat.between(bounds["min_lat"], bounds["max_lat"]) & lon.between(
        bounds["min_lon"], bounds["max_lon"]
    )


def flag_outliers(df: DataFrame, remove: bool = False, bounds: dict[str, float] = OUTLIER_BOUNDS) -> DataFrame:
    outside = ~inside_box(F.col("latitude"), F.col("longitude"), bounds)
    if remove:
        return df.filter(~outside)
    return df.withColumn("outside_bounds", outside)


def apply_recommendations(df: DataFrame, remove_outliers: bool = False) -> DataFrame:
    out = transform_skewed(drop_redundant(df))
    return flag_outliers(out, remove=True) if remove_outliers else out


def combine_tables(tables: list[DataFrame], require: str = TARGET) -> DataFrame:
    """Outer-column union with columns sorted by name; tables without the target are refused."""
    for t in tables:
        if require not in t.columns:
            raise ValueError(f"column {require!r} missing from a feature table")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return merged.select(*sorted(merged.columns))
