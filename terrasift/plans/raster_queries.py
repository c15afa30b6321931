"""Raster-as-table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.vegetation import nlcd_class
from terrasift.operators import rasters
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view


@query(
    "slope_aspect",
    "R-1 R-2 R-3 F34",
    cte("raster_cells")
    + """
, z AS (SELECT cell_row, cell_col, nullif(value, 4097) AS z FROM raster_cells),
g AS (SELECT *, CASE WHEN lag(1) OVER x IS NOT NULL AND lead(1) OVER x IS NOT NULL THEN (lead(z) OVER x - lag(z) OVER x) / 2
    WHEN lead(1) OVER x IS NOT NULL THEN lead(z) OVER x - z WHEN lag(1) OVER x IS NOT NULL THEN z - lag(z) OVER x END
      / (0.01 * 111320.0 * cos(radians(43.0::DOUBLE))) AS gx,
  CASE WHEN lag(1) OVER y IS NOT NULL AND lead(1) OVER y IS NOT NULL THEN (lead(z) OVER y - lag(z) OVER y) / 2
    WHEN lead(1) OVER y IS NOT NULL THEN lead(z) OVER y - z WHEN lag(1) OVER y IS NOT NULL THEN z - lag(z) OVER y END / (0.01 * 111320.0::DOUBLE) AS gy
  FROM z WINDOW x AS (PARTITION BY cell_row ORDER BY cell_col), y AS (PARTITION BY cell_col ORDER BY cell_row)),
d AS (SELECT *, sqrt(gx*gx + gy*gy) AS s, degrees(atan2(-gx, gy)) AS a FROM g)
SELECT cell_row, cell_col, round(CASE WHEN z IS NULL THEN 4097 ELSE degrees(atan(s)) END, 6) AS slope,
  round(CASE WHEN z IS NULL THEN 4097 WHEN s < 0.01 THEN 0 WHEN a < 0 THEN a + 360 ELSE a END, 6) AS aspect FROM d
""",
)
def slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    px, py = rasters.pixel_metres(0.01, -0.01, 43.0)
    return rounded(rasters.slope_aspect(view(spark, d, "raster_cells"), px, py, nodata=4097.0), ["slope", "aspect"])


@query("clip_raster", "R-4", cte("raster_cells") + "SELECT * FROM raster_cells WHERE cell_row BETWEEN 5 AND 20 AND cell_col BETWEEN 10 AND 30")
def clip_raster(spark: SparkSession, d: str) -> DataFrame:
    return rasters.clip_cells(view(spark, d, "raster_cells"), (5, 20), (10, 30))


@query(
    "mosaic_tiles",
    "R-5",
    """
WITH t AS (SELECT CAST(l_partkey // 50 AS INT) AS cell_row, CAST(l_partkey % 50 AS INT) AS cell_col, l_linenumber AS tile, max(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT cell_row, cell_col, arg_max(value, tile) AS value FROM t WHERE value <> 50 GROUP BY 1, 2
""",
)
def mosaic_tiles(spark: SparkSession, d: str) -> DataFrame:
    from terrasift.sources.surrogates import table

    t = (
        table(spark, d, "lineitem")
        .groupBy(
            F.floor(F.col("l_partkey") / 50).cast("int").alias("cell_row"),
            (F.col("l_partkey") % 50).cast("int").alias("cell_col"),
            F.col("l_linenumber").alias("tile"),
        )
        .agg(F.max("l_quantity").alias("value"))
    )
    return rasters.mosaic(t, nodata=50.0)


@query(
    "land_cover_histogram",
    "A19 P14",
    cte("obs")
    + """
, h AS (SELECT CAST(land_cover_code AS INT) AS code, count(*) AS n FROM obs GROUP BY 1)
SELECT code, n, round(n / sum(n) OVER () * 100, 6) AS pct, CASE code WHEN 41 THEN 'Deciduous Forest' WHEN 42 THEN 'Evergreen Forest' WHEN 43 THEN 'Mixed Forest'
    WHEN 52 THEN 'Shrub/Scrub' WHEN 71 THEN 'Grassland/Herbaceous' WHEN 81 THEN 'Pasture/Hay' WHEN 90 THEN 'Woody Wetlands'
    WHEN 95 THEN 'Emergent Herbaceous Wetlands' WHEN 11 THEN 'Open Water' ELSE 'Unknown' END AS class_name FROM h
""",
)
def land_cover_histogram(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "obs").select(F.col("land_cover_code").alias("value"))
    return rounded(rasters.class_histogram(cells, nlcd_class(F.col("code"))), ["pct"])


@query(
    "canopy_bands",
    "A19",
    cte("obs")
    + ", r(low, high) AS (VALUES (0::DOUBLE, 0::DOUBLE), (1, 10), (11, 20), (21, 40), (41, 60), (61, 80), (81, 100))"
    " SELECT low, high, count(*) FILTER (canopy_cover_percent BETWEEN low AND high) AS n,"
    " round(count(*) FILTER (canopy_cover_percent BETWEEN low AND high) / count(*) * 100, 6) AS pct FROM obs, r GROUP BY low, high",
)
def canopy_bands(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "obs").select(F.col("canopy_cover_percent").alias("value"))
    return rounded(rasters.range_bands(cells, rasters.CANOPY_RANGES), ["pct"])


@query(
    "elevation_percentiles",
    "A19",
    cte("raster_cells")
    + " SELECT p AS prob, round(v, 6) AS value FROM (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS p,"
    " unnest(quantile_cont(value, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM raster_cells)",
)
def elevation_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.value_percentiles(view(spark, d, "raster_cells")), ["value"])


@query(
    "raster_profile",
    "A19 R-3",
    cte("raster_cells")
    + "SELECT count(nullif(value, 4097)) AS valid, min(nullif(value, 4097)) AS min, max(nullif(value, 4097)) AS max, round(avg(nullif(value, 4097)), 6) AS mean,"
    " round(count(nullif(value, 4097)) / count(*) * 100, 6) AS coverage_pct FROM raster_cells",
)
def raster_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.raster_profile(view(spark, d, "raster_cells"), nodata=4097.0), ["mean", "coverage_pct"])
