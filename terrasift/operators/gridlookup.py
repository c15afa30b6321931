"""Cell lookups: rasters, daily climate grids, cloud cube, focal shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.units import celsius_to_fahrenheit, mm_to_inches


NO_CELL = -(2**62)  # no cell has this number


def cell_of(lat: Column, lon: Column, origin_lat: float, origin_lon: float, d_lat: float, d_lon: float) -> tuple[Column, Column]:
    """(row, col) on a grid; a negative ``d_lat`` counts rows southward."""
    row = F.floor((lat - origin_lat) / d_lat).cast("int")
    col = F.floor((lon - origin_lon) / d_lon).cast("int")
    return row, col


def sample_raster(
    points: DataFrame,
    cells: DataFrame,
    grid: dict[str, float],
    out: str,
    default: float | None = None,
    nodata: float | None = None,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Value of the cell holding each point; nodata and missing cells give ``default``."""
    row, col = cell_of(F.col(lat), F.col(lon), **grid)
    value = F.col("value") if nodata is None else F.nullif(F.col("value"), F.lit(nodata))
    c = cells.select("cell_row", "cell_col", F.nanvl(value, F.lit(None).cast("double")).alias(out))
    joined = points.withColumns({"cell_row": row, "cell_col": col}).join(c, ["cell_row", "cell_col"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(default))).drop("cell_row", "cell_col")


def sample_layers(points: DataFrame, layers: DataFrame, grid: dict[str, float], defaults: dict[str, float | None]) -> DataFrame:
    """Several layers of one grid at once: pivot the cells, join the points once.

    A raster has as many cells as it likes, however small its file, so cells and points are sorted
    and merged: the cells never travel through the driver. Points without a cell number are spread
    over the tasks by a key that no cell has.
    """
    wide = layers.groupBy("cell_row", "cell_col").pivot("layer", list(defaults)).agg(F.first("value"))
    # wider keys than the groups had: both sides are dealt out anew, so that hot cells can be split
    cells = wide.withColumns({c: F.col(c).cast("bigint") for c in ("cell_row", "cell_col")}).hint("merge")
    row, col = cell_of(F.col("latitude"), F.col("longitude"), **grid)
    spread = F.xxhash64(*[c for c, t in points.dtypes if "map<" not in t])
    placed = row.isNotNull() & col.isNotNull()
    keys = {"cell_row": F.when(placed, row.cast("bigint")).otherwise(spread), "cell_col": F.when(placed, col.cast("bigint")).otherwise(NO_CELL)}
    joined = points.withColumns(keys).join(cells, ["cell_row", "cell_col"], "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()}).drop("cell_row", "cell_col")


CLIMATE_NODATA = -9000.0


def climate_value(value: Column, source_format: Column) -> Column:
    """Null below -9000; the older integer format stores hundredths."""
    return F.when(value >= CLIMATE_NODATA, F.when(source_format == "bil", value / 100.0).otherwise(value))


def sample_climate(points: DataFrame, climate: DataFrame, grid: dict[str, float], variables: list[str]) -> DataFrame:
    """Daily grid values per point and date by equi-join on (row, col, date)."""
    row, col = cell_of(F.col("latitude"), F.col("longitude"), **grid)
    c = climate.select(
        "cell_row", "cell_col", "date", *[climate_value(F.col(v), F.col("source_format")).alias(v) for v in variables]
    )
    keyed = points.withColumns({"cell_row": row, "cell_col": col})
    return keyed.join(c, ["cell_row", "cell_col", "date"], "left").drop("cell_row", "cell_col")


NIGHT_HOURS, DAY_HOURS = [0, 6], [12, 18]


def cloud_cover(points: DataFrame, cube: DataFrame, when: str | int = "daily_mean", step: float = 0.25, out: str = "cloud_cover_percent") -> DataFrame:
    """Cloud percent at the nearest grid node, averaged over the day, night, day hours
    or one hour. Node longitudes are 0-360; fractions up to 1 become percent.

    Hours are averaged per node and day before the points are joined.
    """
    hours = F.col("hour")
    if when == "night":
        rows = cube.filter(hours.isin(NIGHT_HOURS))
    elif when == "day":
        rows = cube.filter(hours.isin(DAY_HOURS))
    elif isinstance(when, int):
        rows = cube.filter(hours == when)
    else:
        rows = cube
    node = lambda c: F.rint(c / step).cast("int")
    mean = rows.groupBy(node(F.col("grid_lat")).alias("_ny"), node(F.col("grid_lon")).alias("_nx"), "date").agg(
        F.avg("tcc").alias("_m")
    )
    wrapped = F.when(F.col("longitude") < 0, F.col("longitude") + 360.0).otherwise(F.col("longitude"))
    keyed = points.withColumns({"_ny": node(F.col("latitude")), "_nx": node(wrapped)})
    m = F.col("_m")
    return (
        keyed.join(mean, ["_ny", "_nx", "date"], "left")
        .withColumn(out, F.when(m <= 1, m * 100.0).otherwise(m))
        .drop("_ny", "_nx", "_m")
    )


def focal_share(cells: DataFrame, condition: Column, radius: int, out: str = "share") -> DataFrame:
    """Percent of cells meeting ``condition`` in a disc around every cell.

    The denominator is the disc's whole bounding box clipped to the raster, corners
    included, since a masked crop keeps its corner cells. Each grid line
    is windowed once per half-width; a cell then receives one value per line offset,
    2r + 1 rows instead of the (2r + 1)^2 of a full neighbourhood.
    """
    widths = {dy: math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}
    line = Window.partitionBy("cell_row").orderBy("cell_col")
    hit = F.when(condition, 1).otherwise(0)
    runs = cells.select("cell_row", "cell_col", hit.alias("_hit"))
    for w in sorted(set(widths.values())):
        runs = runs.withColumn(f"_w{w}", F.sum("_hit").over(line.rangeBetween(-w, w)))
    parts = F.explode(
        F.array(*[F.struct((F.col("cell_row") + dy).alias("cell_row"), F.col(f"_w{w}").alias("n")) for dy, w in widths.items()])
    )
    counts = runs.select("cell_col", parts.alias("p")).groupBy(F.col("p.cell_row").alias("cell_row"), "cell_col").agg(
        F.sum("p.n").alias("_n")
    )
    edge = lambda f, n: cells.agg(f(n)).scalar()
    r, c = F.col("cell_row"), F.col("cell_col")
    rows = F.least(r + radius, edge(F.max, "cell_row")) - F.greatest(r - radius, edge(F.min, "cell_row")) + 1
    cols = F.least(c + radius, edge(F.max, "cell_col")) - F.greatest(c - radius, edge(F.min, "cell_col")) + 1
    return (
        cells.select("cell_row", "cell_col")
        .join(counts, ["cell_row", "cell_col"])
        .select("cell_row", "cell_col", (F.col("_n") / (rows * cols) * 100).alias(out))
    )


FORECAST_DEFAULTS = {"temp": 45.0, "temp_high": 55.0, "temp_low": 35.0, "precip_7d": 0.3, "cloud_cover": 30.0, "wind_mph": 10.0}
HISTORY_DEFAULTS = {"temp": 42.0, "temp_high": 52.0, "temp_low": 32.0, "precip_7d": 0.5, "cloud_cover": 40.0, "wind_mph": 12.0}


def with_weather(requests: DataFrame, history: DataFrame, forecast: DataFrame, as_of: Column, key: list[str]) -> DataFrame:
    """Weather per (key, date): forecast rows after ``as_of``, history up to it.

    ``history`` has tmean_c, tmax_c, tmin_c, ppt_7d_mm and cloud_percent per key and
    date; ``forecast`` has temp_mean_f, temp_max_f, temp_min_f, precip_in and
    cloud_percent per key and date. The forecast precipitation is the sum of the first
    seven forecast days of the key.
    """
    first = Window.partitionBy(*key).orderBy("date")
    week = (
        forecast.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= 7)
        .groupBy(*key)
        .agg(F.sum("precip_in").alias("_week"))
    )
    f = forecast.join(week, key).select(
        *key, "date", F.struct("temp_mean_f", "temp_max_f", "temp_min_f", "_week", "cloud_percent").alias("_f")
    )
    h = history.select(
        *key, "date", F.struct("tmean_c", "tmax_c", "tmin_c", "ppt_7d_mm", "cloud_percent").alias("_h")
    )
    ahead = F.col("date") > as_of
    joined = requests.join(f, [*key, "date"], "left").join(h, [*key, "date"], "left")

    def pick(name: str, ahead_value: Column, past_value: Column) -> Column:
        return F.when(ahead, F.coalesce(ahead_value, F.lit(FORECAST_DEFAULTS[name]))).otherwise(
            F.coalesce(past_value, F.lit(HISTORY_DEFAULTS[name]))
        )

    to_f = celsius_to_fahrenheit
    return joined.withColumns(
        {
            "temp": pick("temp", F.col("_f.temp_mean_f"), to_f(F.col("_h.tmean_c"))),
            "temp_high": pick("temp_high", F.col("_f.temp_max_f"), to_f(F.col("_h.tmax_c"))),
            "temp_low": pick("temp_low", F.col("_f.temp_min_f"), to_f(F.col("_h.tmin_c"))),
            "precip_7d": pick("precip_7d", F.col("_f._week"), mm_to_inches(F.col("_h.ppt_7d_mm"))),
            "cloud_cover": pick("cloud_cover", F.col("_f.cloud_percent"), F.col("_h.cloud_percent")),
            "wind_mph": F.when(ahead, FORECAST_DEFAULTS["wind_mph"]).otherwise(HISTORY_DEFAULTS["wind_mph"]),
            "weather_source": F.when(ahead, "forecast").otherwise("historical"),
        }
    ).drop("_f", "_h")
