"""Region labels and region-dependent filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_label(lat: Column, lon: Column) -> Column:
    """West of -109 splits at 43.5 degrees north, east of it at 44."""
    west = F.when(lat >= 43.5, "northwest").otherwise("southwest")
    east = F.when(lat >= 44.0, "northeast").otherwise("southeast")
    return F.when(lon < -109.0, west).otherwise(east)


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", region_label(F.col("latitude"), F.col("longitude")))


def region_year_rule(region: Column, year: Column, years: tuple[int, int] = (2017, 2019)) -> Column:
    """Southeast rows only within ``years``; other regions unrestricted."""
    return (region != "southeast") | year.between(*years)
