"""Batching, resumable enrichment and the fix stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import batching, lineage
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.context import Layers, assemble_context
from terrasift.plans.join_queries import GRID
from terrasift.plans.registry import query
from terrasift.plans.spatial_queries import _areas
from terrasift.sources.feeds import write_table
from terrasift.sources.surrogates import VIEWS, cte, table, view
from terrasift.streaming import incremental


@query(
    "request_batches",
    "I3",
    cte("obs")
    + """
, g AS (SELECT obs_id, (date - DATE '1970-01-01') // 11 AS date_group FROM obs),
b AS (SELECT *, (row_number() OVER (PARTITION BY date_group ORDER BY md5(CAST(obs_id AS VARCHAR)), obs_id) - 1) // 20 AS batch_no FROM g)
SELECT date_group, batch_no, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS key_sum FROM b GROUP BY 1, 2
""",
)
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    b = batching.request_batches(view(spark, d, "obs").select("obs_id", "date"), "obs_id", 5, 20)
    return b.groupBy("date_group", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("obs_id").alias("key_sum"))


@query(
    "batch_sweep",
    "I7",
    cte("obs")
    + """
, p AS (SELECT b AS buffer_days, s AS batch_size FROM (SELECT unnest([5,7,10,14,21,30]) AS b), (SELECT unnest([100,200,500,1000]) AS s)),
g AS (SELECT buffer_days, batch_size, (date - DATE '1970-01-01') // (2 * buffer_days + 1) AS g, count(*) AS n FROM obs, p GROUP BY 1, 2, 3)
SELECT buffer_days, batch_size, CAST(sum(ceil(n / batch_size)) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS points, count(*) AS date_groups,
  count(*) FILTER (n >= batch_size) AS at_capacity, round(sum(n) / sum(ceil(n / batch_size)), 6) AS mean_points,
  round(sum(n) / sum(ceil(n / batch_size)) / batch_size * 100, 6) AS utilization_pct, round(sum(n) / sum(ceil(n / batch_size)), 6) AS speedup FROM g GROUP BY 1, 2
""",
)
def batch_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batching.batch_sweep(view(spark, d, "obs")), ["mean_points", "utilization_pct", "speedup"])


@query(
    "place_groups",
    "I4",
    cte("obs")
    + """
, g AS (SELECT CAST(floor(latitude / (0.7::DOUBLE / 111.2)) AS BIGINT) AS cell_y, CAST(floor(longitude / (0.7::DOUBLE / 111.2)) AS BIGINT) AS cell_x, latitude, longitude FROM obs)
SELECT cell_y, cell_x, count(*) AS n, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM g GROUP BY 1, 2
""",
)
def place_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batching.place_groups(view(spark, d, "obs")).drop("extent_km"), ["lat", "lon"])


_GOOD = "o_orderkey % 17 <> 0"


@query(
    "resumable_enrichment",
    "I1 I2 J23",
    cte("obs", "raster_cells", "areas")
    + f"""
, o AS (SELECT obs_id, latitude, longitude, date FROM obs JOIN orders ON o_orderkey = obs_id WHERE {_GOOD}),
p AS (SELECT obs_id, arg_min(pack_size / elk_count * 1000, area_id) AS wolves FROM o JOIN areas ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat GROUP BY 1),
x AS (SELECT o.*, coalesce(value, 8500) AS elevation_ft, month(date) AS m FROM o LEFT JOIN raster_cells v
   ON v.cell_row = CAST(floor((latitude - 45) / -0.1) AS INT) AND v.cell_col = CAST(floor((longitude + 111) / 0.14) AS INT))
SELECT obs_id, date, elevation_ft, round(coalesce(wolves, 0.5), 6) AS wolves_per_1000_elk,
  round(greatest(0, CASE WHEN m IN (12,1,2) THEN (elevation_ft - 6000) / 100 WHEN m IN (3,4) THEN (elevation_ft - 7000) / 150
    WHEN m IN (10,11) THEN (elevation_ft - 9000) / 200 ELSE (elevation_ft - 10000) / 100 END), 6) AS snow_depth_inches
FROM x LEFT JOIN p USING (obs_id)
""",
)
def resumable_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Observations enriched with their context as a stream of files, run twice; the second run finds nothing left."""
    base = f"{lineage.shared_folder(spark)}/enrichment-{uuid.uuid4().hex}"
    schema = table(spark, d, "orders").schema
    cells = view(spark, d, "raster_cells").select("cell_row", "cell_col", F.lit("elevation_ft").alias("layer"), "value")
    layers = Layers(rasters=cells, grid=GRID, packs=_areas(spark, d))

    def enrich(batch: DataFrame) -> DataFrame:
        points = batch.selectExpr(*[e.replace("VARCHAR(10)", "STRING") for e in VIEWS["obs"][1]])
        out = assemble_context(points.select("obs_id", "latitude", "longitude", "date"), layers)
        out = out.select("obs_id", "date", "elevation_ft", "wolves_per_1000_elk", "snow_depth_inches")
        return rounded(out, ["wolves_per_1000_elk", "snow_depth_inches"])

    for _ in range(2):
        incremental.enrich_available(
            spark, d, schema, enrich, F.expr(_GOOD), f"{base}/out", f"{base}/bad", f"{base}/state",
            max_bad=None, file_filter="orders.parquet",
        )
    return spark.read.parquet(f"{base}/out").drop("batch")


@query(
    "written_table",
    "S12",
    cte("obs") + "SELECT dataset, obs_id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, date, elk_present FROM obs",
)
def written_table(spark: SparkSession, d: str) -> DataFrame:
    """The observation table written as headed CSV by dataset, and read back."""
    path = f"{lineage.shared_folder(spark)}/table-{uuid.uuid4().hex}"
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date", "elk_present", "dataset")
    write_table(rounded(o, ["latitude", "longitude"], 3), path, "csv")
    schema = "obs_id bigint, latitude double, longitude double, date date, elk_present int, dataset string"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.select("dataset", "obs_id", "latitude", "longitude", "date", "elk_present")


@query(
    "quarantined_rows",
    "I2",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0",
)
def quarantined_rows(spark: SparkSession, d: str) -> DataFrame:
    _, bad = incremental.split_bad_rows(table(spark, d, "orders"), F.expr(_GOOD))
    return bad.select("o_orderkey")


@query(
    "fix_counts_daily",
    "I6 S4",
    cte("fixes")
    + "SELECT animal_id, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT animal_id, ts FROM fixes) GROUP BY 1, 2",
)
def fix_counts_daily(spark: SparkSession, d: str) -> DataFrame:
    return incremental.daily_fix_counts_batch(view(spark, d, "fixes"))


@query(
    "fix_stream",
    "I6",
    cte("fixes")
    + """SELECT animal_id, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT animal_id, ts FROM fixes)
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM fixes) GROUP BY 1, 2""",
)
def fix_stream(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form over the events file; open windows stay out until the watermark passes."""
    base = f"{lineage.shared_folder(spark)}/fixes-{uuid.uuid4().hex}"
    events = (
        spark.readStream.schema(table(spark, d, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(d)
        .select(F.col("user_id").alias("animal_id"), F.col("ts").cast("timestamp").alias("ts"))
    )
    incremental.run_available(incremental.daily_fix_counts(events), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").withColumn("day", F.to_date("day"))


@query(
    "fix_stream_finished",
    "I6",
    cte("fixes")
    + "SELECT animal_id, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT animal_id, ts FROM fixes) GROUP BY 1, 2",
)
def fix_stream_finished(spark: SparkSession, d: str) -> DataFrame:
    """The stream over the events file at the end of its input, open windows included."""
    base = f"{lineage.shared_folder(spark)}/fixes-{uuid.uuid4().hex}"
    events = (
        spark.readStream.schema(table(spark, d, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(d)
        .select(F.col("user_id").alias("animal_id"), F.col("ts").cast("timestamp").alias("ts"))
    )
    return incremental.run_to_the_end(events, f"{base}/out", f"{base}/state").withColumn("day", F.to_date("day"))
