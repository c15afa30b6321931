"""Raster operators on cell tables: gradients, clip, mosaic, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.quantiles import exact_quantiles
from terrasift.operators.summaries import count_if

METRES_PER_DEGREE = 111320.0


def pixel_metres(d_lon: float, d_lat: float, centre_lat: float) -> tuple[float, float]:
    """Pixel width and height in metres at the raster's centre latitude."""
    return abs(d_lon) * METRES_PER_DEGREE * math.cos(math.radians(centre_lat)), abs(d_lat) * METRES_PER_DEGREE


def _gradient(partition: str, order: str) -> Column:
    """Central difference along a line of cells, one-sided at its ends, per pixel.

    A missing or nodata neighbour makes the value null, as NaN arithmetic would.
    """
    w = Window.partitionBy(partition).orderBy(order)
    prev, nxt = F.lag("z").over(w), F.lead("z").over(w)
    has_prev, has_next = F.lag(F.lit(1)).over(w).isNotNull(), F.lead(F.lit(1)).over(w).isNotNull()
    return (
        F.when(has_prev & has_next, (nxt - prev) / 2)
        .when(has_next, nxt - F.col("z"))
        .when(has_prev, F.col("z") - prev)
    )


def slope_aspect(cells: DataFrame, pixel_x: float, pixel_y: float, nodata: float | None = None) -> DataFrame:
    """(cell_row, cell_col, slope, aspect) in degrees; nodata cells stay nodata.

    Two window passes, one per axis, each partitioned by its own lines.
    """
    z = F.col("value") if nodata is None else F.nullif(F.col("value"), F.lit(nodata))
    c = cells.select("cell_row", "cell_col", z.alias("z"))
    c = c.withColumn("gx", _gradient("cell_row", "cell_col") / pixel_x)
    c = c.withColumn("gy", _gradient("cell_col", "cell_row") / pixel_y)
    steep = F.hypot("gx", "gy")
    slope = F.degrees(F.atan(steep))
    raw = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    aspect = F.when(steep < 0.01, 0.0).otherwise(F.when(raw < 0, raw + 360.0).otherwise(raw))
    missing = F.lit(nodata).cast("double")
    return c.select(
        "cell_row",
        "cell_col",
        F.when(F.col("z").isNull(), missing).otherwise(slope).alias("slope"),
        F.when(F.col("z").isNull(), missing).otherwise(aspect).alias("aspect"),
    )


def clip_cells(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return cells.filter(F.col("cell_row").between(*rows) & F.col("cell_col").between(*cols))


def mosaic(tiles: DataFrame, nodata: float | None = None) -> DataFrame:
    """Later tiles (higher ``tile``) win where tiles overlap; nodata never does."""
    z = tiles if nodata is None else tiles.filter(F.col("value") != nodata)
    return z.groupBy("cell_row", "cell_col").agg(F.max_by("value", "tile").alias("value"))


def class_histogram(cells: DataFrame, names: Column | None = None) -> DataFrame:
    """Cells per class code with percent of all valid cells."""
    counts = cells.groupBy(F.col("value").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)
    return out if names is None else out.withColumn("class_name", names)


# Canopy report ranges, inclusive.
CANOPY_RANGES = [(0, 0), (1, 10), (11, 20), (21, 40), (41, 60), (61, 80), (81, 100)]
PERCENTILES = [0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


def range_bands(cells: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    total = F.count("value")
    agg = cells.agg(total.alias("total"), *[count_if(F.col("value").between(a, b)).alias(f"b{i}") for i, (a, b) in enumerate(ranges)])
    rows = F.array(
        *[
            F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(f"b{i}").alias("n"))
            for i, (a, b) in enumerate(ranges)
        ]
    )
    return agg.select("total", F.inline(rows)).select("low", "high", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def value_percentiles(cells: DataFrame, probs: list[float] = PERCENTILES) -> DataFrame:
    return exact_quantiles(cells, ["value"], probs).select("prob", "value")


def raster_profile(cells: DataFrame, nodata: float | None = None, expected_cells: int | None = None) -> DataFrame:
    """Range, mean and share of valid cells."""
    valid = F.col("value").isNotNull() if nodata is None else (F.col("value") != nodata)
    v = F.when(valid, F.col("value"))
    total = F.count(F.lit(1)) if expected_cells is None else F.lit(expected_cells)
    return cells.agg(
        F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        (F.count(v) / total * 100).alias("coverage_pct"),
    )
