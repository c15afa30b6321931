"""Domain views derived from the driver's tables, as SQL both engines understand.

Each view is (source table, select list, optional GROUP BY). ``view`` builds the Spark
DataFrame; ``cte`` renders the same text for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str], str]] = {
    "obs": (
        "orders",
        [
            "o_orderkey AS obs_id",
            "41 + CAST(o_orderkey * 7919 % 4000 AS DOUBLE) / 1000 AS latitude",
            "-111 + CAST(o_orderkey * 104729 % 7000 AS DOUBLE) / 1000 AS longitude",
            "CAST(o_orderdate AS DATE) AS date",
            "CAST(o_custkey % 2 AS INT) AS elk_present",
            "CASE o_custkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'refuge' ELSE 'gye' END AS dataset",
            "CAST(4000 + o_orderkey * 31 % 9000 AS DOUBLE) AS elevation_ft",
            "CAST(o_orderkey * 17 % 61 AS DOUBLE) AS slope_degrees",
            "CAST(o_orderkey * 53 % 360 AS DOUBLE) AS aspect_degrees",
            "CAST(o_orderkey * 13 % 101 AS DOUBLE) AS canopy_cover_percent",
            "CASE o_orderkey % 10 WHEN 0 THEN 41 WHEN 1 THEN 42 WHEN 2 THEN 43 WHEN 3 THEN 52 WHEN 4 THEN 71"
            " WHEN 5 THEN 81 WHEN 6 THEN 90 WHEN 7 THEN 95 WHEN 8 THEN 11 ELSE 99 END AS land_cover_code",
            "CAST(o_orderkey * 61 % 300 AS DOUBLE) / 100 AS water_distance_miles",
            "CAST(o_orderkey * 37 % 400 AS DOUBLE) / 100 AS road_distance_miles",
            "CAST(o_orderkey * 41 % 300 AS DOUBLE) / 100 AS trail_distance_miles",
            "CAST(o_orderkey * 29 % 101 AS DOUBLE) AS security_habitat_percent",
            "CAST(o_orderkey * 23 % 45 AS DOUBLE) AS snow_depth_inches",
            "o_orderkey % 11 = 0 AS snow_crust_detected",
            "CAST(-10 + o_orderkey * 19 % 90 AS DOUBLE) AS temperature_f",
            "CAST(o_orderkey * 11 % 200 AS DOUBLE) / 100 AS precip_last_7_days_inches",
            "CAST(o_orderkey * 7 % 101 AS DOUBLE) AS cloud_cover_percent",
            "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE -0.1 + CAST(o_orderkey * 43 % 1000 AS DOUBLE) / 1000 END AS ndvi",
            "CAST(o_orderkey * 3 % 30 AS DOUBLE) AS ndvi_age_days",
            "CAST(o_orderkey * 47 % 61 - 30 AS DOUBLE) / 1000 AS irg",
            "40 + CAST(o_orderkey * 59 % 400 AS DOUBLE) / 10 AS summer_integrated_ndvi",
            "CAST(o_orderkey * 67 % 100 AS DOUBLE) / 10 AS wolves_per_1000_elk",
            "CAST(o_orderkey * 71 % 60 AS DOUBLE) / 10 AS bear_activity_distance_miles",
            "CASE WHEN o_orderkey % 3 = 0 THEN 'estimate' ELSE 'station' END AS snow_data_source",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('station ', CAST(o_orderkey % 40 AS VARCHAR(10))) END AS snow_station_name",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 90 AS DOUBLE) END AS snow_station_distance_km",
            "CAST(o_orderkey * 5 % 12 AS DOUBLE) AS snow_water_equiv_inches",
            "CASE WHEN o_orderkey % 6 = 0 THEN 0.4 ELSE 0.7 + CAST(o_orderkey % 4 AS DOUBLE) / 10 END AS water_reliability",
        ],
        "",
    ),
    "water_features": (
        "part",
        [
            "p_partkey AS feature_id",
            "41 + CAST(p_partkey * 2741 % 4000 AS DOUBLE) / 1000 AS lat",
            "-111 + CAST(p_partkey * 6007 % 7000 AS DOUBLE) / 1000 AS lon",
            "CASE p_size % 6 WHEN 0 THEN 'spring' WHEN 1 THEN 'lake' WHEN 2 THEN 'pond' WHEN 3 THEN 'stream'"
            " WHEN 4 THEN 'creek' ELSE 'ephemeral' END AS water_type",
        ],
        "",
    ),
    "stations": (
        "supplier",
        [
            "s_suppkey AS station_id",
            "s_name AS name",
            "41 + CAST(s_suppkey * 389 % 4000 AS DOUBLE) / 1000 AS lat",
            "-111 + CAST(s_suppkey * 613 % 7000 AS DOUBLE) / 1000 AS lon",
            "s_suppkey % 7 <> 0 AS has_data",
        ],
        "",
    ),
    "station_series": (
        "lineitem",
        [
            "l_suppkey AS station_id",
            "CAST(l_shipdate AS DATE) AS date",
            "MAX(l_quantity) AS depth_in",
            "MAX(l_quantity) * MAX(l_discount) * 5 AS swe_in",
            "-10 + CAST(MAX(l_partkey) % 60 AS DOUBLE) AS temperature_f",
        ],
        "l_suppkey, CAST(l_shipdate AS DATE)",
    ),
    "scenes": (
        "lineitem",
        [
            "l_orderkey * 10 + l_linenumber AS scene_id",
            "l_suppkey AS tile_id",
            "CAST(l_shipdate AS DATE) AS scene_date",
            "l_quantity * 2 AS cloud_cover",
            "l_discount * 8 AS ndvi",
        ],
        "",
    ),
    "climate_cells": (
        "lineitem",
        [
            "CAST(FLOOR(CAST(l_suppkey AS DOUBLE) / 10) AS INT) AS cell_row",
            "CAST(l_suppkey % 10 AS INT) AS cell_col",
            "CAST(l_shipdate AS DATE) AS date",
            "CASE WHEN MAX(l_linenumber) = 7 THEN -9999.0 ELSE MAX(l_quantity) - 20 END AS tmean",
            "CASE WHEN MIN(l_linenumber) = 7 THEN -9999.0 ELSE MAX(l_quantity) * MAX(l_discount) * 10 END AS ppt",
            "CASE WHEN MAX(l_orderkey) % 2 = 0 THEN 'bil' ELSE 'cog' END AS source_format",
        ],
        "CAST(FLOOR(CAST(l_suppkey AS DOUBLE) / 10) AS INT), CAST(l_suppkey % 10 AS INT), CAST(l_shipdate AS DATE)",
    ),
    "cloud_cube": (
        "lineitem",
        [
            "41.0 + 0.25 * CAST(l_suppkey % 17 AS DOUBLE) AS grid_lat",
            "249.0 + 0.25 * CAST(l_suppkey % 29 AS DOUBLE) AS grid_lon",
            "CAST(l_shipdate AS DATE) AS date",
            "CAST((l_linenumber % 4) * 6 AS INT) AS hour",
            "MAX(l_discount) * 10 AS tcc",
        ],
        "41.0 + 0.25 * CAST(l_suppkey % 17 AS DOUBLE), 249.0 + 0.25 * CAST(l_suppkey % 29 AS DOUBLE),"
        " CAST(l_shipdate AS DATE), CAST((l_linenumber % 4) * 6 AS INT)",
    ),
    "raster_cells": (
        "part",
        [
            "CAST(FLOOR(CAST(p_partkey AS DOUBLE) / 50) AS INT) AS cell_row",
            "CAST(p_partkey % 50 AS INT) AS cell_col",
            "CAST(4000 + p_partkey * 97 % 6000 AS DOUBLE) AS value",
        ],
        "",
    ),
    "fixes": (
        "events",
        [
            "event_id AS fix_id",
            "user_id AS animal_id",
            "ts",
            "41 + CAST(event_id * 3571 % 4000 AS DOUBLE) / 1000 AS latitude",
            "-111 + CAST(event_id * 8803 % 7000 AS DOUBLE) / 1000 AS longitude",
        ],
        "",
    ),
    "areas": (
        "nation",
        [
            "n_nationkey AS area_id",
            "n_name AS name",
            "41 + CAST(n_nationkey * 157 % 350 AS DOUBLE) / 100 AS min_lat",
            "41.5 + CAST(n_nationkey * 157 % 350 AS DOUBLE) / 100 AS max_lat",
            "-111 + CAST(n_nationkey * 263 % 650 AS DOUBLE) / 100 AS min_lon",
            "-110.5 + CAST(n_nationkey * 263 % 650 AS DOUBLE) / 100 AS max_lon",
            "4 + n_regionkey AS pack_size",
            "1500 + n_nationkey * 100 AS elk_count",
        ],
        "",
    ),
    "route_ends": (
        "part",
        [
            "p_partkey AS route_id",
            "-111 + CAST(p_partkey * 6007 % 7000 AS DOUBLE) / 1000 AS lon0",
            "41 + CAST(p_partkey * 2741 % 4000 AS DOUBLE) / 1000 AS lat0",
            "0.005 + CAST(p_partkey % 17 AS DOUBLE) / 1000 AS dlon",
            "0.004 - CAST(p_partkey % 13 AS DOUBLE) / 1000 AS dlat",
            "CAST(2 + p_partkey % 3 AS INT) AS n_points",
        ],
        "",
    ),
    "hydro": (
        "part",
        [
            "p_partkey AS feature_id",
            "CASE p_size % 8 WHEN 0 THEN 460 WHEN 1 THEN 558 WHEN 2 THEN 336 WHEN 3 THEN 334"
            " WHEN 4 THEN 390 WHEN 5 THEN 436 WHEN 6 THEN 388 ELSE 999 END AS ftype",
            "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS gnis_name",
            "p_brand AS gnis_name_alt",
            "41 + CAST(p_partkey * 2741 % 4000 AS DOUBLE) / 1000 AS lat",
            "-111.2 + CAST(p_partkey * 6007 % 7400 AS DOUBLE) / 1000 AS lon",
        ],
        "",
    ),
    "road_lines": (
        "part",
        [
            "p_partkey AS road_id",
            "CASE p_size % 10 WHEN 0 THEN 'S1100' WHEN 1 THEN 'S1200' WHEN 2 THEN 'S1400' WHEN 3 THEN 'S1500'"
            " WHEN 4 THEN 'S1710' WHEN 5 THEN 'S1730' WHEN 6 THEN 'S1820' WHEN 7 THEN 'S1830' WHEN 8 THEN 'S1780'"
            " ELSE 'S9999' END AS mtfcc",
            "p_name AS fullname",
            "-111.3 + CAST(p_partkey * 4409 % 7600 AS DOUBLE) / 1000 AS lon1",
            "40.8 + CAST(p_partkey * 3461 % 4400 AS DOUBLE) / 1000 AS lat1",
            "-111.3 + CAST(p_partkey * 4409 % 7600 AS DOUBLE) / 1000 + 0.01 AS lon2",
            "40.8 + CAST(p_partkey * 3461 % 4400 AS DOUBLE) / 1000 + CAST(p_partkey % 9 AS DOUBLE) / 1000 AS lat2",
        ],
        "",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs, group = VIEWS[name]
    df = table(spark, sf_dir, source)
    if not group:
        return df.selectExpr(*[e.replace("VARCHAR(10)", "STRING") for e in exprs])
    handle = f"terrasift_{source}"
    return spark.sql(f"SELECT {', '.join(exprs)} FROM {{{handle}}} GROUP BY {group}", **{handle: df})


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views."""
    parts = []
    for name in names:
        source, exprs, group = VIEWS[name]
        tail = f" GROUP BY {group}" if group else ""
        parts.append(f"{name} AS (SELECT {', '.join(exprs)} FROM {source}{tail})")
    return "WITH " + ",\n".join(parts)
