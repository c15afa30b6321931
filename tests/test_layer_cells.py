"""Raster cells meet points in a merge join: no table of cells passes through the driver."""

from pyspark.sql import functions as F

from terrasift.operators.gridlookup import sample_layers

GRID = {"origin_lat": 45.0, "origin_lon": -111.0, "d_lat": -0.1, "d_lon": 0.14}


def test_cells_are_not_broadcast_and_values_stay(spark):
    rows = [(r, c, n, float(100 * r + c + s)) for r in range(3) for c in range(3) for n, s in (("a", 0.0), ("b", 0.5))]
    layers = spark.createDataFrame([*rows, (None, 1, "a", 7.0)], "cell_row int, cell_col int, layer string, value double")
    points = spark.createDataFrame(
        [(1, 44.95, -110.9), (2, 44.85, -110.8), (3, 44.85, -110.8), (4, 10.0, 10.0), (5, None, -110.9), (6, 44.95, None), (7, None, None)],
        "id int, latitude double, longitude double",
    )
    out = sample_layers(points, layers, GRID, {"a": -1.0, "b": None})
    assert out.columns == ["id", "latitude", "longitude", "a", "b"]
    got = {r["id"]: (r["a"], r["b"]) for r in out.collect()}
    assert got == {1: (0.0, 0.5), 2: (101.0, 101.5), 3: (101.0, 101.5), **{k: (-1.0, None) for k in (4, 5, 6, 7)}}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_points_without_a_cell_are_spread(spark):
    layers = spark.range(1).select(F.lit(0).alias("cell_row"), F.lit(0).alias("cell_col"), F.lit("a").alias("layer"), F.lit(1.0).alias("value"))
    points = spark.range(4000).select("id", F.lit(None).cast("double").alias("latitude"), F.lit(-110.9).alias("longitude"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = sample_layers(points, layers, GRID, {"a": 0.0}).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 4000
