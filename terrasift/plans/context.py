"""All environmental lookups of a (point, date) table side by side.

Layers that are not given leave their documented defaults, so the output schema is the
same whatever the inputs. Rows outside the study area get null terrain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import lunar, snow, vegetation
from terrasift.functions.temporal import parse_date, summer_year
from terrasift.operators import gridlookup, nearest, scenes
from terrasift.operators.asof import nearest_day
from terrasift.operators.features import STUDY_AREA, inside_box
from terrasift.operators.spatial import with_wolf_density

# Features of missing layers or cells.
TERRAIN_DEFAULTS = {
    "elevation_ft": 8500.0,
    "slope_degrees": 15.0,
    "aspect_degrees": 180.0,
    "canopy_cover_percent": 30.0,
    "land_cover_code": 0.0,
}
ABSENT_LAYER = {
    "water_distance_miles": 0.5,
    "water_reliability": 0.8,
    "road_distance_miles": 2.0,
    "trail_distance_miles": 1.5,
    "security_habitat_percent": 35.0,
    "wolves_per_1000_elk": 2.0,
    "bear_activity_distance_miles": 5.0,
    "temperature_f": 45.0,
    "precip_last_7_days_inches": 0.0,
    "cloud_cover_percent": 20.0,
    "summer_integrated_ndvi": 60.0,
    "pregnancy_rate": 0.90,
}
DATA_QUALITY = {"wolf": (0.75, 0.5), "bear": (0.65, 0.5)}
DEFAULT_DATE = "2024-01-01"


@dataclass
class Layers:
    """Inputs of the context; every one is optional."""

    rasters: DataFrame | None = None
    grid: dict[str, float] = field(default_factory=dict)
    water: DataFrame | None = None
    roads: DataFrame | None = None
    trails: DataFrame | None = None
    bears: DataFrame | None = None
    packs: DataFrame | None = None
    security: DataFrame | None = None
    stations: DataFrame | None = None
    station_series: DataFrame | None = None
    weather: DataFrame | None = None
    weather_key: list[str] = field(default_factory=list)
    scenes: DataFrame | None = None
    max_cloud: float = 50.0
    ephemeris: bool = True


def with_enrichment_date(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Parsed date in ``enrichment_date`` with the default for missing ones; year, month
    and day of year are filled only where they are null, and only from real dates."""
    out = df.withColumn("_d", parse_date(F.col(date_col)))
    fill = {"year": F.year("_d"), "month": F.month("_d"), "day_of_year": F.dayofyear("_d")}
    new = {n: F.coalesce(F.col(n), v) if n in df.columns else v for n, v in fill.items()}
    new["enrichment_date"] = F.coalesce("_d", F.to_date(F.lit(DEFAULT_DATE)))
    return out.withColumns(new).drop("_d")


def _terrain(df: DataFrame, layers: Layers) -> DataFrame:
    inside = inside_box(F.col("latitude"), F.col("longitude"), STUDY_AREA)
    if layers.rasters is not None:
        df = gridlookup.sample_layers(df, layers.rasters, layers.grid, TERRAIN_DEFAULTS)
    else:
        df = df.withColumns({k: F.lit(v) for k, v in TERRAIN_DEFAULTS.items()})
    clamped = F.least(F.greatest(F.col("canopy_cover_percent"), F.lit(0.0)), F.lit(100.0))
    new = {k: F.when(inside, clamped if k == "canopy_cover_percent" else F.col(k)) for k in TERRAIN_DEFAULTS}
    df = df.withColumns(new)
    return df.withColumn("land_cover_type", vegetation.land_cover_type(F.col("land_cover_code")))


def _distances(df: DataFrame, layers: Layers) -> DataFrame:
    """Every layer that is searched for its nearest feature takes part in one walk."""
    lines = {"road": layers.roads, "trail": layers.trails, "bear_activity": layers.bears}
    lines = {name: f for name, f in lines.items() if f is not None}
    wanted = [nearest.Layer(f, f"_{name}") for name, f in lines.items()]
    if layers.water is not None:
        wanted.append(nearest.water_layer(layers.water))
    if layers.stations is not None and layers.station_series is not None:
        wanted += nearest.station_layers(layers.stations)
    if wanted:
        df = nearest.nearest_layers(df, wanted)
    if layers.water is not None:
        df = nearest.add_water(df)
    for name in lines:
        df = nearest.add_distance(df, f"_{name}", f"{name}_distance_miles")
    if layers.packs is not None:
        df = with_wolf_density(df, layers.packs)
    if layers.security is not None:
        row, col = gridlookup.cell_of(F.col("latitude"), F.col("longitude"), **layers.grid)
        s = layers.security.withColumnRenamed("share", "security_habitat_percent")
        df = df.withColumns({"cell_row": row, "cell_col": col}).join(s, ["cell_row", "cell_col"], "left").drop("cell_row", "cell_col")
    return df


def _snow(df: DataFrame, layers: Layers) -> DataFrame:
    month = F.month("date")
    estimate = snow.estimated_depth_inches(F.coalesce("elevation_ft", F.lit(8500.0)), month)
    if layers.stations is None or layers.station_series is None:
        return df.withColumns(
            {
                "snow_depth_inches": estimate,
                "snow_water_equiv_inches": snow.estimated_swe_inches(estimate),
                "snow_crust_detected": F.lit(False),
                "snow_data_source": F.lit("estimate"),
                "snow_station_name": F.lit(None).cast("string"),
                "snow_station_distance_km": F.lit(None).cast("double"),
            }
        )
    df = nearest.add_station(df).withColumn("station_id", F.col("station.station_id"))
    df = nearest_day(df, layers.station_series, ["station_id"], ["depth_in", "swe_in"], out="_snow")
    depth = snow.depth_or_from_swe(F.col("_snow.depth_in"), F.col("_snow.swe_in"))
    found = F.col("_snow").isNotNull() & depth.isNotNull()
    return df.withColumns(
        {
            "snow_depth_inches": F.when(found, depth).otherwise(estimate),
            "snow_water_equiv_inches": F.when(found, F.col("_snow.swe_in")).otherwise(snow.estimated_swe_inches(estimate)),
            "snow_crust_detected": F.when(found, snow.crust_detected(depth, F.col("_snow.swe_in"))).otherwise(False),
            "snow_data_source": F.when(found, "snotel").otherwise("estimate"),
            "snow_station_name": F.when(found, F.col("station.name")),
            "snow_station_distance_km": F.col("station.distance_km"),
        }
    ).drop("station", "station_id", "_snow")


def _weather(df: DataFrame, layers: Layers) -> DataFrame:
    """``weather`` carries temp, precip_7d and cloud_cover per key and date."""
    if layers.weather is None:
        return df
    w = layers.weather.select(
        *layers.weather_key, "date", F.col("temp").alias("temperature_f"),
        F.col("precip_7d").alias("precip_last_7_days_inches"), F.col("cloud_cover").alias("cloud_cover_percent"),
    )
    return df.join(w, [*layers.weather_key, "date"], "left")


def _vegetation(df: DataFrame, layers: Layers) -> DataFrame:
    month = F.month("date")
    if layers.scenes is None:
        return df.withColumns(
            {"ndvi": vegetation.ndvi_month_default(month), "ndvi_age_days": F.lit(8), "irg": vegetation.irg_month_default(month)}
        )
    df = scenes.with_vegetation(df, layers.scenes, layers.max_cloud)
    cloud = F.coalesce(F.col("scene_cloud"), F.col("cloud_cover_percent") if "cloud_cover_percent" in df.columns else F.lit(None))
    df = df.withColumn("cloud_cover_percent", cloud).drop("scene_cloud", "ndvi_found")
    sums = scenes.summer_integrals(layers.scenes, layers.max_cloud)
    return df.withColumn("year_", summer_year(F.col("date"))).join(
        sums.withColumnRenamed("year", "year_"), ["tile_id", "year_"], "left"
    ).drop("year_")


def place_context(points: DataFrame, layers: Layers) -> DataFrame:
    """What depends on the place alone: terrain, distances, territories, security and stations in reach."""
    return _distances(_terrain(points, layers), layers)


def day_context(places: DataFrame, layers: Layers) -> DataFrame:
    """The rest, for (place, date) rows of ``place_context``."""
    df = _snow(places, layers)
    df = _weather(df, layers)
    df = _vegetation(df, layers)
    df = df.withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in ABSENT_LAYER.items()}
    )
    wolf, bear = DATA_QUALITY["wolf"], DATA_QUALITY["bear"]
    df = df.withColumns(
        {
            "wolf_data_quality": F.lit(wolf[0] if layers.packs is not None else wolf[1]),
            "bear_data_quality": F.lit(bear[0] if layers.bears is not None else bear[1]),
        }
    )
    df = lunar.with_night_features(
        df, F.col("latitude"), F.col("longitude"), F.col("date"), F.col("cloud_cover_percent"), layers.ephemeris
    )
    return df.withColumnRenamed("effective_illumination_midnight", "effective_illumination").drop(
        "moon_altitude_mean", "moon_visible_hours", "effective_illumination_mean", "cloud_adjusted_illumination_mean"
    )


def assemble_context(points: DataFrame, layers: Layers) -> DataFrame:
    """``points`` needs latitude, longitude and date (and tile_id when scenes are given)."""
    return day_context(place_context(points, layers), layers)
