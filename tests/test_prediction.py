import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrasift.plans import predict
from terrasift.plans.prediction_queries import requests, scored_grid

SF = "/root/testdata/sf0.001"


def greedy(points, top, radius):
    """Reference selection: best first, skip what an earlier seed covers."""
    order = sorted(points, key=lambda p: (-p["total_score"], p["date"], p["longitude"], p["latitude"]))
    seeds = []
    for p in order:
        if len(seeds) == top:
            break
        if all(math.hypot(p["latitude"] - s["latitude"], p["longitude"] - s["longitude"]) > radius for s in seeds):
            seeds.append(p)
    return seeds


def test_hotspots_match_the_greedy_walk(spark):
    scored = scored_grid(spark, SF).filter("request_id < 3").withColumn("total_score", F.round("total_score", 6))
    got = predict.hotspots(scored, top=5, radius=0.05).collect()
    rows = [r.asDict() for r in scored.select("request_id", "latitude", "longitude", "date", "total_score").collect()]
    for request in {r["request_id"] for r in rows}:
        mine = [r for r in rows if r["request_id"] == request]
        expected = greedy(mine, 5, 0.05)
        found = sorted((g for g in got if g["request_id"] == request), key=lambda g: g["rank"])
        assert [(g["latitude"], g["longitude"]) for g in found] == [(e["latitude"], e["longitude"]) for e in expected]
        for g, e in zip(found, expected):
            near = [
                r["total_score"] for r in mine
                if math.hypot(r["latitude"] - e["latitude"], r["longitude"] - e["longitude"]) <= 0.05
            ]
            assert g["area_acres"] == len(near) * 0.25
            assert abs(g["score"] - sum(near) / len(near)) < 1e-9
            assert 1 <= g["elk_min"] <= g["elk_max"]


@pytest.mark.parametrize("prefix, radius", [(4096, 0.02), (7, 0.02), (1, 0.3), (30, 5.0)])
def test_seeds_of_crowded_places(spark, prefix, radius):
    """However few locations a walk holds, and wherever they crowd, the seeds are those of the greedy walk."""
    rng = random.Random(4)
    rows = []
    for request, n in ((1, 400), (2, 3), (3, 60)):
        for _ in range(n):
            spot = (0.0, 0.0) if rng.random() < 0.6 else (rng.random(), rng.random())
            at = (43 + spot[0] + 0.01 * rng.random(), -107 + spot[1] + 0.01 * rng.random())
            rows.append((request, *at, dt.date(2026, 10, rng.randrange(1, 4)), float(rng.randrange(20)), "a", "b", "c"))
    names = ["request_id", "latitude", "longitude", "date", "total_score", "limiting_factor", "best_factor", "description"]
    got = predict.hotspot_seeds(spark.createDataFrame(rows, names), top=6, radius=radius, prefix=prefix).collect()
    for request in (1, 2, 3):
        expected = greedy([dict(zip(names, r)) for r in rows if r[0] == request], 6, radius)
        found = sorted((g["rank"], g["latitude"], g["longitude"], g["date"]) for g in got if g["request_id"] == request)
        assert found == [(k + 1, e["latitude"], e["longitude"], e["date"]) for k, e in enumerate(expected)]


def test_days_whose_means_differ_by_a_sums_last_digits_tie(spark):
    ring = [(-107.0, 43.0), (-106.0, 43.0), (-106.0, 44.0), (-107.0, 44.0)]
    asked = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring])], "request_id int, ring array<struct<lon:double,lat:double>>")
    means = {1: 70.0, 2: 70.00000000000003, 3: 70.0001, 4: 69.99999999999997, 5: None}
    scored = spark.createDataFrame([(1, dt.date(2026, 10, k), m, m) for k, m in means.items()], "request_id int, date date, total_score double, road_score double")
    got = predict.day_ranking(scored, asked, ["road"], F.lit("2026-10-05").cast("date")).collect()
    assert [r["date"].day for r in sorted(got, key=lambda r: r["rank"])] == [3, 1, 2, 4, 5]


def test_grid_lies_inside_the_ring(spark):
    g = predict.grid_points(requests(spark, SF), 5000.0)
    assert g.count() > 0
    assert g.groupBy("request_id", "i", "j").count().filter("count > 1").count() == 0


def test_triangle_keeps_half_of_the_box(spark):
    ring = [(-107.0, 43.0), (-106.0, 43.0), (-106.0, 44.0)]
    df = spark.createDataFrame(
        [(1, [{"lon": x, "lat": y} for x, y in ring], dt.date(2026, 10, 1), dt.date(2026, 10, 3))],
        "request_id int, ring array<struct<lon:double,lat:double>>, start date, end date",
    )
    n = predict.grid_points(df, 2000.0).count()
    assert abs(n / 56**2 - 0.5) < 0.02
    assert predict.with_dates(predict.grid_points(df, 2000.0)).count() == 3 * n


def test_december_counts_to_the_same_year(spark):
    df = spark.createDataFrame([(dt.date(2026, 12, 5),), (dt.date(2026, 2, 1),)], "date date")
    got = [r["s"]["days_until_migration"] for r in df.select(predict.migration_status(F.col("date")).alias("s")).collect()]
    assert got == [None, 424]
