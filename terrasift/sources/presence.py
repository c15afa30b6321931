"""GPS fixes and migration routes as normalised presence points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.functions.temporal import parse_date

# Accepted column names, in order of preference.
LAT_NAMES = ["latitude", "Lat", "Latitude", "LAT", "y", "Y"]
LON_NAMES = ["longitude", "Longitude", "Lon", "LONG", "Long", "x", "X"]
DATE_NAMES = ["firstdate", "lastdate", "Date_Time_MST", "DT", "timestamp"]


def first_present(df: DataFrame, names: list[str]) -> str | None:
    """Exact-case match first, in list order."""
    return next((n for n in names if n in df.columns), None)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def normalise_fixes(df: DataFrame, utm_zone: int = 12) -> DataFrame:
    """``latitude``/``longitude`` from any accepted naming; UTM columns take precedence.

    Rows with missing or impossible coordinates are dropped.
    """
    east = first_present(df, ["Easting", "easting"])
    north = first_present(df, ["Northing", "northing"])
    if east and north:
        # the inverse projection of any finite pair is a valid position, so the test stays
        # on the inputs, where the optimizer need not copy the series into the filter
        e, n = F.col(east).try_cast("double"), F.col(north).try_cast("double")
        finite = F.abs(e) + F.abs(n) < 1e12  # false for NaN, null for null
        return geo.with_wgs84(df.filter(finite), e, n, utm_zone)
    lat_name, lon_name = first_present(df, LAT_NAMES), first_present(df, LON_NAMES)
    if lat_name is None or lon_name is None:
        raise ValueError(f"no coordinate columns among {df.columns}")
    rest = [c for c in df.columns if c not in (lat_name, lon_name)]
    out = df.select(
        *rest,
        F.col(lat_name).try_cast("double").alias("latitude"),
        F.col(lon_name).try_cast("double").alias("longitude"),
    )
    return out.filter(valid_coordinates(F.col("latitude"), F.col("longitude")))


def read_fixes(spark: SparkSession, path: str, utm_zone: int = 12) -> DataFrame:
    """CSV fixes; values stay text until cast, so no inference pass reads the files."""
    return normalise_fixes(spark.read.option("header", True).csv(path), utm_zone)


def route_points(routes: DataFrame, route_id: str = "route_id", geometry: str = "parts") -> DataFrame:
    """One row per vertex of ``array<array<struct<lon,lat>>>`` lines.

    Single-vertex geometries are points and carry no ``point_index``.
    """
    rest = [c for c in routes.columns if c not in (route_id, geometry)]
    vertices = F.flatten(geometry)
    return routes.select(
        route_id, *rest, F.size(vertices).alias("_n"), F.posexplode(vertices).alias("point_index", "v")
    ).select(
        route_id,
        *rest,
        F.when(F.col("_n") > 1, F.col("point_index")).alias("point_index"),
        F.col("v.lat").alias("latitude"),
        F.col("v.lon").alias("longitude"),
    )


def resample_routes(
    routes: DataFrame, points_per_route: int = 100, route_id: str = "route_id", geometry: str = "parts"
) -> DataFrame:
    """Equally spaced points along each line part, in planar degrees as drawn.

    A line is one row, so its cumulative lengths and positions are array expressions of
    that row; nothing is shuffled.
    """
    rest = [c for c in routes.columns if c not in (route_id, geometry)]
    parts = routes.select(route_id, *rest, F.posexplode(geometry).alias("part_index", "line"))

    def step(i: Column) -> Column:
        a, b = F.element_at("line", i), F.element_at("line", i + 1)
        return F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"])

    steps = F.transform(F.sequence(F.lit(1), F.size("line") - 1), step)
    running = F.aggregate(
        "_steps", F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
    )
    last = points_per_route - 1
    lines = (
        parts.filter(F.size("line") >= 2)
        .withColumn("_steps", steps)
        .withColumn("_cum", running)
        .withColumn("_total", F.element_at("_cum", -1))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("sample_index"))
        .withColumn("distance_along_route", F.col("_total") * F.col("sample_index") / float(max(last, 1)))
    )
    # segment whose start is the last cumulative length not beyond the position
    seg = F.least(
        F.greatest(F.size(F.filter("_cum", lambda c: c <= F.col("distance_along_route"))), F.lit(1)), F.size("_steps")
    )
    lines = lines.withColumn("_seg", seg)
    a, b = F.element_at("line", F.col("_seg")), F.element_at("line", F.col("_seg") + 1)
    length = F.element_at("_steps", F.col("_seg"))
    f = F.coalesce((F.col("distance_along_route") - F.element_at("_cum", F.col("_seg"))) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    return lines.select(
        route_id,
        *rest,
        "part_index",
        "sample_index",
        "distance_along_route",
        (a["lat"] + (b["lat"] - a["lat"]) * f).alias("latitude"),
        (a["lon"] + (b["lon"] - a["lon"]) * f).alias("longitude"),
    )


def with_standard_date(df: DataFrame) -> DataFrame:
    """``date`` from itself or the first parseable candidate column; others stay."""
    names = ["date"] if "date" in df.columns else [n for n in DATE_NAMES if n in df.columns]
    if not names:
        return df.withColumn("date", F.lit(None).cast("date"))
    return df.withColumn("date", parse_date(*[F.col(n) for n in names]))


def assemble_dataset(df: DataFrame, dataset: str, limit: int | None = None) -> DataFrame:
    """Tagged, dated presence table; ``limit`` is the test mode's head count."""
    out = with_standard_date(df).withColumn("dataset", F.lit(dataset))
    return out.limit(limit) if limit else out
