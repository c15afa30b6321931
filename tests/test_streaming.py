import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrasift.streaming import incremental


def job(spark, tmp_path, **kw):
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    incremental.enrich_available(
        spark, str(tmp_path / "in"), schema, lambda b: b.withColumn("twice", F.col("v") * 2), F.col("v") >= 0,
        str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state"), **kw,
    )
    return spark.read.parquet(str(tmp_path / "out"))


def test_resumes_with_new_files_only(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    assert job(spark, tmp_path).count() == 10
    spark.range(10, 15).select(F.col("id").alias("v")).write.mode("append").parquet(str(tmp_path / "in"))
    out = job(spark, tmp_path)
    assert out.count() == 15 and out.agg(F.sum("twice")).first()[0] == 2 * sum(range(15))
    assert out.select("batch").distinct().count() == 2


def test_bad_rows_are_set_apart(spark, tmp_path):
    spark.range(-3, 5).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    assert job(spark, tmp_path).count() == 5
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_too_many_bad_rows_stop_the_job(spark, tmp_path):
    spark.range(-5, 5).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="bad rows"):
        job(spark, tmp_path, max_bad=2)


def test_fix_stream_equals_batch_for_closed_days(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(hours=i // 2)) for i in range(24 * 2 * 6)]
    df = spark.createDataFrame(rows + rows[:20], "animal_id int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental.run_available(incremental.daily_fix_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["animal_id"], r["day"].date()): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["animal_id"], r["day"]): r["n"] for r in incremental.daily_fix_counts_batch(df).collect()}
    assert len(got) >= 3 * 4
    assert all(want[k] == n for k, n in got.items())


def test_a_finished_stream_counts_every_day(spark, tmp_path):
    """Closed and open windows together are the batch's; a second run goes on from the open ones."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(hours=i // 2)) for i in range(24 * 2 * 6)]
    df = spark.createDataFrame(rows + rows[:20], "animal_id bigint, ts timestamp")
    parts = [df.filter("ts < '2024-01-04'"), df.filter("ts >= '2024-01-04'")]
    seen = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = part if seen is None else seen.union(part)
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = incremental.run_to_the_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        got = sorted((r["animal_id"], r["day"].date(), r["n"]) for r in out.collect())
        assert got == sorted(tuple(r) for r in incremental.daily_fix_counts_batch(seen).collect())
