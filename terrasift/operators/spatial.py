"""Territories, coverage and layer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import haversine_km, line_length_km
from terrasift.operators.polygons import first_containing
from terrasift.operators.summaries import count_if

def box_ring(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Closed ring of a bounding box."""
    corners = [(min_lon, min_lat), (max_lon, min_lat), (max_lon, max_lat), (min_lon, max_lat), (min_lon, min_lat)]
    return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in corners])


def ring_bounds(ring: Column) -> dict[str, Column]:
    lons, lats = F.transform(ring, lambda v: v["lon"]), F.transform(ring, lambda v: v["lat"])
    return {
        "min_lon": F.array_min(lons), "max_lon": F.array_max(lons),
        "min_lat": F.array_min(lats), "max_lat": F.array_max(lats),
    }


BACKGROUND_WOLVES = 0.5
PACK_SIZE, PACK_ELK = 6, 2000


def with_wolf_density(points: DataFrame, packs: DataFrame, **kw) -> DataFrame:
    """Wolves per 1000 elk of the first territory holding the point, else 0.5."""
    out = first_containing(points, packs, "area_id", ["pack_size", "elk_count"], out="_pack", **kw)
    size = F.coalesce("_pack.pack_size", F.lit(PACK_SIZE))
    elk = F.coalesce("_pack.elk_count", F.lit(PACK_ELK))
    density = F.when(F.col("_pack").isNull(), BACKGROUND_WOLVES).otherwise(size / elk * 1000)
    return out.withColumn("wolves_per_1000_elk", density).drop("_pack")


def within_shares(df: DataFrame, distance: Column, limits: list[float]) -> DataFrame:
    """Share of rows within each distance of an area."""
    return df.select(distance.alias("_km")).agg(
        F.count(F.lit(1)).alias("n"),
        *[(count_if(F.col("_km") <= k) / F.count(F.lit(1))).alias(f"within_{k:g}_km") for k in limits],
    )


def centre_distance_km(lat: Column, lon: Column, centre_lat: float, centre_lon: float) -> Column:
    return haversine_km(lat, lon, F.lit(centre_lat), F.lit(centre_lon))


def coverage_report(points: DataFrame, state: dict[str, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Extent of a layer against a state box: gaps per side, overlap share, quadrant counts."""
    mid_lat = (state["min_lat"] + state["max_lat"]) / 2
    mid_lon = (state["min_lon"] + state["max_lon"]) / 2
    y, x = F.col(lat), F.col(lon)
    north, east = y >= mid_lat, x >= mid_lon
    agg = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"),
        F.max(lon).alias("max_lon"),
        count_if(north & east).alias("n_ne"),
        count_if(north & ~east).alias("n_nw"),
        count_if(~north & east).alias("n_se"),
        count_if(~north & ~east).alias("n_sw"),
    )
    zero = F.lit(0.0)
    width = F.greatest(F.least(F.col("max_lon"), F.lit(state["max_lon"])) - F.greatest(F.col("min_lon"), F.lit(state["min_lon"])), zero)
    height = F.greatest(F.least(F.col("max_lat"), F.lit(state["max_lat"])) - F.greatest(F.col("min_lat"), F.lit(state["min_lat"])), zero)
    area = (state["max_lon"] - state["min_lon"]) * (state["max_lat"] - state["min_lat"])
    return agg.withColumns(
        {
            "gap_south": F.greatest(F.col("min_lat") - state["min_lat"], zero),
            "gap_north": F.greatest(F.lit(state["max_lat"]) - F.col("max_lat"), zero),
            "gap_west": F.greatest(F.col("min_lon") - state["min_lon"], zero),
            "gap_east": F.greatest(F.lit(state["max_lon"]) - F.col("max_lon"), zero),
            "overlap_pct": width * height / area * 100,
        }
    )


def layer_profile(lines: DataFrame, type_col: str, geometry: str = "vertices") -> DataFrame:
    """Features, length, bounds per type of a line layer, with the grand total as null type."""
    b = ring_bounds(F.col(geometry))
    rows = lines.select(type_col, line_length_km(F.col(geometry)).alias("km"), *[v.alias(k) for k, v in b.items()])
    return rows.rollup(type_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("km").alias("length_km"),
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    )


# Reliability tiers of a water layer report.
def reliability_tier(reliability: Column) -> Column:
    return F.when(reliability >= 0.9, "high").when(reliability >= 0.6, "medium").otherwise("low")
