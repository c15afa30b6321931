"""Rows are ranked without passing through the driver, however small their estimate."""

from pyspark.sql import functions as F

from terrasift.operators.sampling import with_hash_rank


def test_ranked_rows_are_not_broadcast(spark, tmp_path):
    # a file whose size says little of its rows, as repeated values give
    spark.range(60_000).select("id", F.lit(None).cast("string").alias("group")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).withColumn("group", F.when(F.col("id") % 3 == 0, "a"))
    out = with_hash_rank(rows, ["id"], 7, "draw", ["group"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") and "BuildLeft" not in plan
    got = out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("last"), F.max("rank_total").alias("total")).collect()
    assert {r["group"]: tuple(r)[1:] for r in got} == {"a": (20_000,) * 4, None: (40_000,) * 4}
