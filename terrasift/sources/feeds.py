"""Station, forecast and vegetation-index feeds; table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.vegetation import scale_ndvi

SERIES_SCHEMA = (
    "array<struct<stationTriplet:string, data:array<struct<stationElement:struct<elementCode:string>,"
    " values:array<struct<date:string, value:double>>>>>>"
)
STATIONS_SCHEMA = (
    "array<struct<stationId:string, name:string, latitude:double, longitude:double, elevation:double, stationTriplet:string>>"
)
FORECAST_SCHEMA = (
    "daily struct<time:array<string>, temperature_2m_max:array<double>, temperature_2m_min:array<double>,"
    " temperature_2m_mean:array<double>, precipitation_sum:array<double>, cloud_cover_mean:array<double>>"
)


def station_series(documents: DataFrame, column: str = "json", parts: int | None = None) -> DataFrame:
    """(station, date, swe_in, depth_in): the union of days of both elements.

    ``parts`` is the number of tasks that collect the days; the session's if it is left out.
    """
    s = documents.select(F.explode(F.from_json(column, SERIES_SCHEMA)).alias("s"))
    e = s.select(F.col("s.stationTriplet").alias("station"), F.explode("s.data").alias("e"))
    v = e.select("station", F.col("e.stationElement.elementCode").alias("code"), F.explode("e.values").alias("v"))
    days = v.select("station", F.to_date("v.date").alias("date"), "code", "v.value")
    if parts:
        days = days.repartition(parts, "station", "date")
    of = lambda code: F.max(F.when(F.col("code") == code, F.col("value")))
    return days.groupBy("station", "date").agg(of("WTEQ").alias("swe_in"), of("SNWD").alias("depth_in"))


def station_list(documents: DataFrame, column: str = "json", state: str = "WY") -> DataFrame:
    """Stations with coordinates; a missing triplet is built from id and state."""
    s = documents.select(F.explode(F.from_json(column, STATIONS_SCHEMA)).alias("s")).select("s.*")
    return s.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("stationId").alias("station_id"),
        F.coalesce("stationTriplet", F.concat("stationId", F.lit(f":{state}:SNTL"))).alias("triplet"),
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.coalesce("elevation", F.lit(0.0)).alias("elevation_ft"),
        F.lit(state).alias("state"),
    )


def daily_forecast(documents: DataFrame, column: str = "json", keep: list[str] | None = None) -> DataFrame:
    """One row per forecast day from parallel arrays; short arrays leave nulls."""
    keep = keep or []
    d = documents.select(*keep, F.from_json(column, FORECAST_SCHEMA)["daily"].alias("d"))
    zipped = F.arrays_zip(
        F.col("d.time"),
        *[
            F.coalesce(F.col(f"d.{f}"), F.array().cast("array<double>")).alias(f)
            for f in ("temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "precipitation_sum", "cloud_cover_mean")
        ],
    )
    rows = d.select(*keep, F.explode(zipped).alias("z"))
    return rows.filter(F.col("z.time").isNotNull()).select(
        *keep,
        F.to_date("z.time").alias("date"),
        F.col("z.temperature_2m_max").alias("temp_max_f"),
        F.col("z.temperature_2m_min").alias("temp_min_f"),
        F.col("z.temperature_2m_mean").alias("temp_mean_f"),
        F.col("z.precipitation_sum").alias("precipitation_inches"),
        F.col("z.cloud_cover_mean").alias("cloud_cover_percent"),
    )


def _ndvi_column(columns: list[str]) -> str | None:
    return next((c for c in columns if "NDVI" in c.upper() and "QUALITY" not in c.upper()), None)


def _qa_column(columns: list[str]) -> str | None:
    skip = ("DESCRIPTION", "BITMASK", "MODLAND")
    return next(
        (c for c in columns if ("QUALITY" in c.upper() or "QA" in c.upper()) and not any(s in c.upper() for s in skip)),
        None,
    )


def ndvi_results(df: DataFrame) -> DataFrame:
    """(latitude, longitude, date, ndvi, qa_flags) from a product table whose NDVI and
    quality columns are found by name; fill and impossible values are dropped."""
    ndvi, qa = _ndvi_column(df.columns), _qa_column(df.columns)
    if ndvi is None:
        raise ValueError(f"no NDVI column among {df.columns}")
    name = lambda n: F.col(n.title() if n.title() in df.columns else n)
    out = df.select(
        name("latitude").try_cast("double").alias("latitude"),
        name("longitude").try_cast("double").alias("longitude"),
        F.to_date(name("date").cast("string")).alias("date"),
        scale_ndvi(F.col(f"`{ndvi}`").try_cast("double")).alias("ndvi"),
        (F.col(f"`{qa}`").try_cast("int") if qa else F.lit(0)).alias("qa_flags"),
    )
    return out.dropna(subset=["latitude", "longitude", "date", "ndvi"])


def read_ndvi_results(spark: SparkSession, path: str) -> DataFrame:
    return ndvi_results(spark.read.option("header", True).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "dataset", mode: str = "overwrite") -> None:
    """Parquet or headed CSV, partitioned by dataset when that column exists."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.save(path)
