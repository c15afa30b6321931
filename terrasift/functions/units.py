"""Unit conversions used across feature sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_MILE = 1609.34
FEET_PER_METRE = 3.28084
MM_PER_INCH = 25.4


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def mm_to_inches(mm: Column) -> Column:
    return mm / MM_PER_INCH


def metres_to_miles(m: Column) -> Column:
    return m / METRES_PER_MILE


def metres_to_feet(m: Column) -> Column:
    return m * FEET_PER_METRE


def elevation_to_feet(value: Column, source_unit: str = "ft") -> Column:
    """Elevation in feet.

    ``ft`` keeps the value, ``m`` converts, ``guess`` treats values below 500 as
    feet already and converts the rest.
    """
    if source_unit == "ft":
        return value
    if source_unit == "m":
        return metres_to_feet(value)
    if source_unit == "guess":
        return F.when(value < 500, value).otherwise(metres_to_feet(value))
    raise ValueError(f"unknown elevation unit {source_unit!r}")
