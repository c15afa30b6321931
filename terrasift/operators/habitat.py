"""Habitat rule sets for pseudo-absence sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-cover codes no animal uses (water, ice, developed, barren).
UNSUITABLE_LAND_COVER = [11, 12, 21, 22, 23, 24, 31]

# Season elevation rules (months, comparison, feet); ``default`` is the
# reduced set used without configuration.
SEASON_ELEVATION_RULES = {
    "config": [
        ("winter_too_high", [12, 1, 2, 3], ">=", 9000.0),
        ("summer_too_low", [6, 7, 8], "<=", 6000.0),
        ("fall_too_high", [9, 10, 11], ">=", 11000.0),
        ("fall_too_low", [9, 10, 11], "<=", 5000.0),
    ],
    "default": [
        ("winter_too_high", [12, 1, 2, 3], ">=", 9000.0),
        ("summer_too_low", [6, 7, 8], "<=", 6000.0),
    ],
}


def suitable(elevation_ft: Column, slope: Column, water_miles: Column) -> Column:
    return elevation_ft.between(6000, 13500) & (slope < 45) & (water_miles <= 5)


def unsuitable(elevation_ft: Column, slope: Column, water_miles: Column, land_cover: Column | None = None, variant: str = "full") -> Column:
    """``full`` uses all rules; ``worker`` the shorter set of the parallel sampler."""
    if variant == "worker":
        return (elevation_ft < 4000) | (slope >= 45) | (water_miles > 10)
    if variant != "full":
        raise ValueError(f"unknown variant {variant!r}")
    rules = [elevation_ft < 4000, elevation_ft > 14000, slope > 60, water_miles > 10]
    if land_cover is not None:
        rules.append(land_cover.isin(*UNSUITABLE_LAND_COVER))
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])


def season_elevation_rule(month: Column, elevation_ft: Column, rules: str = "config") -> Column:
    """Name of the first violated season rule, or null."""
    expr = F.lit(None).cast("string")
    for name, months, op, feet in reversed(SEASON_ELEVATION_RULES[rules]):
        limit = elevation_ft >= feet if op == ">=" else elevation_ft <= feet
        expr = F.when(month.isin(*months) & limit, name).otherwise(expr)
    return expr
