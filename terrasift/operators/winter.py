"""Winter severity from daily snow and temperature series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.snow import temperature_severity


def daily_severity(series: DataFrame) -> DataFrame:
    return series.withColumn("daily_wsi", F.col("depth_in") * temperature_severity(F.col("temperature_f")))


def _winter(date):
    """Year in which the winter of ``date`` began (1 November)."""
    return F.when(F.month(date) >= 11, F.year(date)).otherwise(F.year(date) - 1)


def running_severity(series: DataFrame, location: list[str]) -> DataFrame:
    """Cumulative index per location and winter (1 November to 30 April)."""
    m = F.month("date")
    days = daily_severity(series).filter((m >= 11) | (m <= 4)).withColumn("winter", _winter(F.col("date")))
    w = Window.partitionBy(*location, "winter").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("wsi", F.coalesce(F.sum("daily_wsi").over(w), F.lit(0.0)))


def severity_at(requests: DataFrame, series: DataFrame, location: list[str]) -> DataFrame:
    """``winter_severity_index`` from 1 November to the request day; from May to
    October the whole previous winter.

    Every running sum is spread over the days until the next one, at most a winter's 181 per
    location, and a request meets one row by location and day.
    """
    run = running_severity(series, location)
    following = F.lead("date").over(Window.partitionBy(*location, "winter").orderBy("date"))
    last = F.coalesce(F.date_sub(following, 1), F.make_date(F.col("winter") + 1, F.lit(4), F.lit(30)))
    spans = run.withColumn("_last", last).filter(F.col("_last") >= F.col("date"))
    days = spans.select(*location, "wsi", F.explode(F.sequence("date", "_last")).alias("_upto"))
    upto = F.when(F.month("date").between(5, 10), F.make_date(F.year("date"), F.lit(4), F.lit(30))).otherwise(F.col("date"))
    joined = requests.withColumn("_upto", upto).join(days, [*location, "_upto"], "left")
    return joined.withColumn("winter_severity_index", F.coalesce("wsi", F.lit(0.0))).drop("_upto", "wsi")
