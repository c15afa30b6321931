"""Incremental enrichment and live fixes as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_bad_rows(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined); a null verdict counts as bad."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


class TooManyBadRows(RuntimeError):
    """More quarantined rows than the job tolerates."""


def enrich_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    enrich: Callable[[DataFrame], DataFrame],
    valid: Column,
    target: str,
    quarantine: str,
    checkpoint: str,
    max_bad: int | None = 100,
    file_filter: str | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Enrich every file not yet processed, then stop.

    The checkpoint remembers finished files, so a restart continues where a lost run
    ended. Each micro-batch writes its own folder in overwrite mode, which makes the
    replay of a half-written batch harmless. The job fails once one batch quarantines
    more than ``max_bad`` rows; the batch is then retried by the next run.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad_rows(batch, valid)
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        if max_bad is not None:
            n = spark.read.schema(batch.schema).parquet(f"{quarantine}/batch={batch_id}").count()
            if n > max_bad:
                raise TooManyBadRows(f"batch {batch_id}: {n} bad rows")
        enrich(good).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run = (
        reader.load(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def deduplicated_fixes(fixes: DataFrame, late: str = "1 day") -> DataFrame:
    """First fix per animal and timestamp; state is dropped once the watermark passes."""
    return fixes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["animal_id", "ts"])


def daily_fix_counts(fixes: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Distinct fixes per animal and day on a stream."""
    return (
        deduplicated_fixes(fixes, late)
        .groupBy(F.window("ts", window).alias("w"), "animal_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("animal_id", F.col("w.start").alias("day"), "n")
    )


def daily_fix_counts_batch(fixes: DataFrame) -> DataFrame:
    """The same counts on a finished table."""
    distinct = fixes.select("animal_id", "ts").distinct()
    return distinct.groupBy("animal_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Write a streaming frame to parquet until the input present now is used up."""
    (
        df.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(animal_id, day, n) of the windows that a stopped ``daily_fix_counts`` job still holds in its state."""
    stored = spark.read.format("state-metadata").load(checkpoint)
    # the counting operator saves its state; the other one only remembers fixes
    counting = stored.filter(F.col("operatorName").startswith("stateStoreSave")).select("operatorId").first()
    state = spark.read.format("statestore").option("operatorId", counting["operatorId"]).load(checkpoint)
    key, value = (state.schema[c].dataType.names for c in ("key", "value"))
    window, animal, n = F.col(f"key.`{key[0]}`"), F.col(f"key.`{key[1]}`"), F.col(f"value.`{value[0]}`")
    return state.select(animal.alias("animal_id"), window["start"].alias("day"), n.cast("bigint").alias("n"))


def run_to_the_end(fixes: DataFrame, target: str, checkpoint: str, late: str = "1 day") -> DataFrame:
    """Daily counts of a stream whose input present now is used up, the last days included.

    Closed windows are appended to ``target``. Those still open are read from the state that the
    checkpoint holds and belong to this result only: a later run goes on counting them.
    """
    spark = fixes.sparkSession
    run_available(daily_fix_counts(fixes, late), target, checkpoint)
    closed = spark.read.schema("animal_id bigint, day timestamp, n bigint").parquet(target)
    still = open_windows(spark, checkpoint)
    return closed.unionByName(still.select(F.col("animal_id").cast("bigint").alias("animal_id"), "day", "n"))
