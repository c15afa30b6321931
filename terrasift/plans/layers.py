"""Every layer of the context over the given tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrasift.plans.context import Layers
from terrasift.plans.join_queries import GRID
from terrasift.plans.spatial_queries import _areas
from terrasift.sources.surrogates import view


def context_layers(spark: SparkSession, d: str, later: int = 0) -> Layers:
    """Rasters, features, stations, weather and scenes; dated ones moved by ``later`` days."""
    v = F.col("value")
    rasters = view(spark, d, "raster_cells").select(
        "cell_row",
        "cell_col",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("layer"), e.alias("value"))
                    for n, e in (("elevation_ft", v), ("slope_degrees", v % 60), ("canopy_cover_percent", v % 130))
                ]
            )
        ),
    )
    hydro = view(spark, d, "hydro").select("feature_id", "lat", "lon", "ftype")
    series = view(spark, d, "station_series").withColumn("date", F.date_add("date", later))
    scenes = view(spark, d, "scenes").withColumn("scene_date", F.date_add("scene_date", later))
    return Layers(
        rasters=rasters,
        grid=GRID,
        water=view(spark, d, "water_features"),
        roads=view(spark, d, "road_lines").select(F.col("road_id").alias("feature_id"), "lat1", "lon1", "lat2", "lon2"),
        trails=hydro.drop("ftype"),
        bears=hydro.where("ftype = 999").drop("ftype"),
        packs=_areas(spark, d),
        security=view(spark, d, "raster_cells").select("cell_row", "cell_col", (v % 101).alias("share")),
        stations=view(spark, d, "stations"),
        station_series=series,
        weather=series.select(
            F.col("station_id").alias("tile_id"), "date", F.col("temperature_f").alias("temp"),
            F.col("swe_in").alias("precip_7d"), F.col("depth_in").alias("cloud_cover"),
        ),
        weather_key=["tile_id"],
        scenes=scenes,
        max_cloud=50.0,
    )
