"""NDVI defaults, placeholder flags and land-cover decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NDVI constants that mark an unfilled reading.
NDVI_PLACEHOLDERS = [0.3, 0.5, 0.55, 0.7]
SUMMER_NDVI_PLACEHOLDER = 60.0

# Land-cover code names.
LAND_COVER_TYPES = {
    41: "deciduous_forest",
    42: "evergreen_forest",
    43: "mixed_forest",
    52: "shrub",
    71: "grassland",
    81: "pasture",
    90: "wetland",
    95: "emergent_wetland",
}

# National land-cover class names.
NLCD_CLASSES = {
    11: "Open Water",
    12: "Perennial Ice/Snow",
    21: "Developed, Open Space",
    22: "Developed, Low Intensity",
    23: "Developed, Medium Intensity",
    24: "Developed, High Intensity",
    31: "Barren Land",
    41: "Deciduous Forest",
    42: "Evergreen Forest",
    43: "Mixed Forest",
    51: "Dwarf Scrub",
    52: "Shrub/Scrub",
    71: "Grassland/Herbaceous",
    72: "Sedge/Herbaceous",
    73: "Lichens",
    74: "Moss",
    81: "Pasture/Hay",
    82: "Cultivated Crops",
    90: "Woody Wetlands",
    95: "Emergent Herbaceous Wetlands",
}


def lookup(mapping: dict, key: Column) -> Column:
    """Dictionary lookup as a literal map (null for unknown keys)."""
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*items), key)


def land_cover_type(code: Column) -> Column:
    return F.when(code.isNull(), "outside_bounds").otherwise(
        F.coalesce(lookup(LAND_COVER_TYPES, code.cast("int")), F.lit("unknown"))
    )


def nlcd_class(code: Column) -> Column:
    return F.coalesce(lookup(NLCD_CLASSES, code.cast("int")), F.lit("Unknown"))


def ndvi_month_default(month: Column) -> Column:
    return (
        F.when(month.isin(6, 7, 8), 0.70)
        .when(month.isin(9, 10), 0.55)
        .when(month.isin(11, 12, 1, 2, 3), 0.30)
        .otherwise(0.50)
    )


def irg_month_default(month: Column) -> Column:
    return F.when(month.isin(4, 5), 0.01).when(month.isin(9, 10), -0.005).otherwise(0.0)


def is_placeholder_ndvi(value: Column) -> Column:
    return F.coalesce(value.isin(*NDVI_PLACEHOLDERS), F.lit(False))


def is_placeholder_summer_ndvi(value: Column) -> Column:
    return F.coalesce(F.abs(value - SUMMER_NDVI_PLACEHOLDER) < 0.01, F.lit(False))


def scale_ndvi(raw: Column, fill: float = -3000.0) -> Column:
    """Integer-scaled readings to [-1, 1]; fill and out-of-range become null."""
    scaled = F.when(raw > 1, raw / 10000.0).otherwise(raw)
    return F.when((raw != fill) & scaled.between(-1.0, 1.0), scaled)
