"""Snow expressions: elevation-based estimate, density and crust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNOW_DENSITY = 0.25
CRUST_RATIO = 0.35


def estimated_depth_inches(elevation_ft: Column, month: Column) -> Column:
    raw = (
        F.when(month.isin(12, 1, 2), (elevation_ft - 6000) / 100)
        .when(month.isin(3, 4), (elevation_ft - 7000) / 150)
        .when(month.isin(10, 11), (elevation_ft - 9000) / 200)
        .otherwise((elevation_ft - 10000) / 100)
    )
    return F.greatest(raw, F.lit(0.0))


def estimated_swe_inches(depth: Column) -> Column:
    return depth * SNOW_DENSITY


def depth_or_from_swe(depth: Column, swe: Column) -> Column:
    return F.coalesce(depth, swe / SNOW_DENSITY)


def crust_detected(depth: Column, swe: Column) -> Column:
    return F.coalesce((depth > 0) & (swe / F.nullif(depth, F.lit(0.0)) > CRUST_RATIO), F.lit(False))


def temperature_severity(temp_f: Column) -> Column:
    """Daily multiplier of the winter severity index."""
    return (
        F.when(temp_f > 20, F.lit(0.0))
        .when(temp_f >= 0, (20 - temp_f) / 20)
        .when(temp_f < 0, F.lit(2.0))
    )
