"""Request batching by date window and by place, and the batch-size sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import haversine_km
from terrasift.operators.sampling import hash_digits, with_group_rank


def date_bucket(date: Column, buffer_days: int) -> Column:
    """Days of one bucket lie within twice the buffer, so their windows all overlap."""
    return F.floor(F.datediff(date, F.to_date(F.lit("1970-01-01"))) / (2 * buffer_days + 1))


def request_batches(
    points: DataFrame, key: str, buffer_days: int = 5, size: int = 100, date_col: str = "date"
) -> DataFrame:
    """Adds ``date_group`` and ``batch_no`` (0-based within the group, at most ``size`` points).

    Groups are numbered through hash slices; one busy window is spread over tasks.
    """
    grouped = points.withColumn("date_group", date_bucket(F.col(date_col), buffer_days))
    mixed = F.md5(F.col(key).cast("string"))
    slices = F.substring(mixed, 1, hash_digits(points.count()))
    ranked = with_group_rank(grouped, ["date_group"], slices, [mixed, F.col(key)])
    return ranked.withColumn("batch_no", F.floor((F.col("rank") - 1) / size)).drop("rank", "rank_total")


def batch_statistics(points: DataFrame, buffer_days: int = 5, size: int = 100, date_col: str = "date") -> DataFrame:
    """Batches, fill and speed-up over one request per point, from counts per group."""
    groups = points.groupBy(date_bucket(F.col(date_col), buffer_days).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return _sweep_stats(groups.withColumns({"buffer_days": F.lit(buffer_days), "batch_size": F.lit(size)}))


def _sweep_stats(groups: DataFrame) -> DataFrame:
    n, size = F.col("n"), F.col("batch_size")
    out = groups.groupBy("buffer_days", "batch_size").agg(
        F.sum(F.ceil(n / size)).alias("batches"),
        F.sum("n").alias("points"),
        F.count(F.lit(1)).alias("date_groups"),
        F.count(F.when(n >= size, 1)).alias("at_capacity"),
    )
    mean = F.col("points") / F.col("batches")
    return out.withColumns(
        {"mean_points": mean, "utilization_pct": mean / F.col("batch_size") * 100, "speedup": F.col("points") / F.col("batches")}
    )


# Swept buffers (days) and batch sizes.
BUFFERS = [5, 7, 10, 14, 21, 30]
SIZES = [100, 200, 500, 1000]


def batch_sweep(points: DataFrame, buffers: list[int] = BUFFERS, sizes: list[int] = SIZES, date_col: str = "date") -> DataFrame:
    """Statistics for every buffer and size, from the counts per day only."""
    days = points.groupBy(F.col(date_col).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    buckets = F.array(
        *[F.struct(F.lit(b).alias("buffer_days"), date_bucket(F.col("d"), b).alias("g")) for b in buffers]
    )
    groups = days.select("k", F.inline(buckets)).groupBy("buffer_days", "g").agg(F.sum("k").alias("n"))
    with_sizes = groups.select("buffer_days", "n", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("batch_size"))
    return _sweep_stats(with_sizes).orderBy("batches", F.desc("utilization_pct"))


# a cell of this edge has a diagonal below one kilometre
CELL_DEGREES = 0.7 / 111.2


def place_groups(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Grid groups whose members lie within one kilometre, with size, centre and extent."""
    cy = F.floor(F.col(lat) / CELL_DEGREES)
    cx = F.floor(F.col(lon) / CELL_DEGREES)
    g = points.groupBy(cy.alias("cell_y"), cx.alias("cell_x")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"),
        F.min(lat).alias("_a"), F.max(lat).alias("_b"), F.min(lon).alias("_c"), F.max(lon).alias("_d"),
    )
    return g.withColumn("extent_km", haversine_km(F.col("_a"), F.col("_c"), F.col("_b"), F.col("_d"))).drop("_a", "_b", "_c", "_d")
