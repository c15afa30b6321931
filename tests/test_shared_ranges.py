"""The mix searches a range once; station series are gathered in one aggregate."""

from pyspark.sql import functions as F

from terrasift.operators import absence
from terrasift.sources import feeds


def test_shared_range(spark, monkeypatch):
    """Strategies that filter one range take the rows they would find alone, after one search."""
    presence = spark.range(40).select(
        F.col("id").alias("obs_id"), (41 + F.col("id") % 8 / 2).alias("latitude"), (-111 + F.col("id") % 5).cast("double").alias("longitude")
    )
    monkeypatch.setattr(absence, "candidates", lambda s, low, high, seed: _grid(s, low, high))
    searches, measured = [], absence.with_distance
    monkeypatch.setattr(absence, "with_distance", lambda *a: searches.append(1) or measured(*a))
    contexts = []
    context = lambda df: contexts.append(1) or df.withColumn("elevation_ft", F.lit(7000.0))
    shared = absence.SharedRanges(presence, context, 42, 100, near_m=500.0, far_m=2000.0)
    for metres in (2000.0, 500.0, 500.0):
        alone = {r["candidate_id"] for r in absence._far_ranges(presence, 42, metres)(0, 100).collect()}
        assert {r["candidate_id"] for r in shared.far(0, 100, metres).collect()} == alone
        rows = shared.rows(0, 100, metres)
        assert {r["candidate_id"] for r in rows.collect()} == alone and rows.columns[-1] == "elevation_ft"
    assert 0 < len(alone) < 100
    assert len(searches) == 1 and len(contexts) == 2


def _grid(spark, low, high):
    """Points 0 to 4.4 km north of a presence."""
    step = F.col("id") % 40 / 1000
    return spark.range(low, high).select(F.col("id").alias("candidate_id"), (41 + step).alias("latitude"), F.lit(-111.0).alias("longitude"))


def test_station_series_in_one_aggregate(spark):
    values = lambda *v: "[" + ",".join(f'{{"date":"{d}","value":{x}}}' for d, x in v) + "]"
    element = lambda code, v: f'{{"stationElement":{{"elementCode":{code}}},"values":{v}}}'
    docs = [
        '[{"stationTriplet":"A","data":[' + element('"WTEQ"', values(("2024-01-01", 1.5), ("2024-01-01", 2.5))) + ","
        + element('"SNWD"', values(("2024-01-02", 9.0))) + "," + element('"PREC"', values(("2024-01-03", 4.0))) + ","
        + element("null", values(("2024-01-04", 5.0))) + "]}]"
    ]
    out = feeds.station_series(spark.createDataFrame([(d,) for d in docs], "json string"), parts=3)
    got = sorted((r["station"], str(r["date"]), r["swe_in"], r["depth_in"]) for r in out.collect())
    assert got == [("A", "2024-01-01", 2.5, None), ("A", "2024-01-02", None, 9.0), ("A", "2024-01-03", None, None), ("A", "2024-01-04", None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
