"""Satellite scenes: sensor choice, clearest scene in a window, green-up rate, summer sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.vegetation import irg_month_default, ndvi_month_default

# First day of the newer sensor and half-window in days per sensor.
NEW_SENSOR_FROM = "2013-02-11"
WINDOW_DAYS = {"landsat5": 21, "landsat8": 14}


def sensor_for_date(date: Column) -> Column:
    return F.when(date < F.to_date(F.lit(NEW_SENSOR_FROM)), "landsat5").otherwise("landsat8")


def window_days(date: Column, override: int | None = None) -> Column:
    if override:
        return F.lit(override)
    return F.when(sensor_for_date(date) == "landsat5", WINDOW_DAYS["landsat5"]).otherwise(WINDOW_DAYS["landsat8"])


def clearest_per_day(scenes: DataFrame, max_cloud: float) -> DataFrame:
    """One scene per tile and day: (tile_id, scene_date, best) with the least cloud.

    Equal clouds go to the smaller NDVI, then the smaller id.
    """
    return (
        scenes.filter((F.col("cloud_cover") < max_cloud) & F.col("ndvi").isNotNull())
        .groupBy("tile_id", "scene_date")
        .agg(F.min(F.struct("cloud_cover", "ndvi", "scene_id")).alias("best"))
    )


def clearest_scene(
    requests: DataFrame, scenes: DataFrame, max_cloud: float = 30.0, buffer_days: int | None = None, out: str = "scene"
) -> DataFrame:
    """Adds struct ``out`` for the least cloudy scene in [date - b, date + b).

    Distinct (tile, date) requests are spread over their window days and joined to the
    per-day winners on (tile, day).
    """
    best_of_day = clearest_per_day(scenes, max_cloud)
    wanted = requests.select("tile_id", "date").dropna().distinct()
    b = window_days(F.col("date"), buffer_days)
    spread = wanted.select(
        "tile_id", "date", F.explode(F.sequence(F.date_sub("date", b), F.date_add("date", b - 1))).alias("scene_date")
    )
    pick = (
        spread.join(best_of_day, ["tile_id", "scene_date"])
        .groupBy("tile_id", "date")
        .agg(F.min(F.struct("best.cloud_cover", "scene_date", "best.ndvi", "best.scene_id")).alias("s"))
        .select(
            "tile_id",
            "date",
            F.struct(
                "s.ndvi", "s.cloud_cover", "s.scene_date", F.abs(F.datediff("date", "s.scene_date")).alias("age_days")
            ).alias(out),
        )
    )
    return requests.join(pick, ["tile_id", "date"], "left")


def with_vegetation(
    points: DataFrame, scenes: DataFrame, max_cloud: float = 30.0, buffer_days: int | None = None, lookback: int = 21
) -> DataFrame:
    """NDVI, scene cloud, age and green-up rate per row, with month defaults.

    Works on distinct (tile, date) keys, including the lagged dates of the green-up
    rate, and joins the finished columns back once.
    """
    keys = points.select("tile_id", "date").dropna().distinct()
    lagged = keys.select("tile_id", F.date_sub("date", lookback).alias("date"))
    looked = clearest_scene(keys.unionByName(lagged).distinct(), scenes, max_cloud, buffer_days)
    prior = looked.select("tile_id", F.date_add("date", lookback).alias("date"), F.col("scene.ndvi").alias("prior_ndvi"))
    month = F.month("date")
    found = F.col("scene").isNotNull()
    rate = (F.col("scene.ndvi") - F.col("prior_ndvi")) / lookback
    features = (
        keys.join(looked, ["tile_id", "date"], "left")
        .join(prior, ["tile_id", "date"], "left")
        .select(
            "tile_id",
            "date",
            found.alias("ndvi_found"),
            F.coalesce(F.col("scene.ndvi"), ndvi_month_default(month)).alias("ndvi"),
            F.col("scene.cloud_cover").alias("scene_cloud"),
            F.coalesce(F.col("scene.age_days"), F.lit(8)).alias("ndvi_age_days"),
            F.coalesce(rate, irg_month_default(month)).alias("irg"),
        )
    )
    return points.join(features, ["tile_id", "date"], "left")


def ndvi_success(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ndvi_found").cast("int")).alias("success_rate"))


def summer_integrals(scenes: DataFrame, max_cloud: float = 50.0, keep: int = 8) -> DataFrame:
    """(tile_id, year, summer_integrated_ndvi): sum of the first ``keep`` clear scene days.

    Values outside [-1, 1] are dropped. Days are reduced to their clearest scene before
    ranking, so a tile-year holds at most 122 rows.
    """
    month = F.month("scene_date")
    summer = scenes.filter(month.between(6, 9) & F.col("ndvi").between(-1.0, 1.0))
    days = clearest_per_day(summer, max_cloud).withColumn("year", F.year("scene_date"))
    rank = F.row_number().over(Window.partitionBy("tile_id", "year").orderBy("scene_date"))
    return (
        days.withColumn("rn", rank)
        .filter(F.col("rn") <= keep)
        .groupBy("tile_id", "year")
        .agg(F.sum("best.ndvi").alias("summer_integrated_ndvi"))
    )


def with_summer_ndvi(points: DataFrame, scenes: DataFrame, default: float | None = 60.0, **kw) -> DataFrame:
    from terrasift.functions.temporal import summer_year

    sums = summer_integrals(scenes, **kw)
    out = points.withColumn("year", summer_year(F.col("date"))).join(sums, ["tile_id", "year"], "left").drop("year")
    if default is not None:
        out = out.withColumn("summer_integrated_ndvi", F.coalesce("summer_integrated_ndvi", F.lit(default)))
    return out
