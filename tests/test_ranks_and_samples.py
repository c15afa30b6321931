import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import batching, quantiles, sampling
from terrasift.operators.quantiles import average_ranks, exact_quantiles


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 700), np.full(350, 0.25), rng.normal(50, 20, 150)])
    rows = [(i, float(x), int(i % 3 == 0)) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "id int, v double, y int")


PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("sketch, most", [(10_000, 10**6), (10_000, 5), (20, 40), (8, 1)])
def test_exact_quantiles(values, monkeypatch, sketch, most):
    """However coarse the sketch and however often the bounds close in, the quantile is exact."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    v, df = values
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["v"], PROBS, most=most).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(v, p))


@pytest.mark.parametrize("most", [10**6, 3])
def test_quantiles_of_groups_and_odd_columns(spark, values, most):
    v, df = values
    odd = df.withColumns(
        {
            "k": F.when(F.col("id") % 5 > 0, F.col("id") % 5), "gap": F.when(F.col("id") % 7 == 0, F.col("v")), "none": F.lit(None).cast("double"),
            "nan": F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("v")), "same": F.lit(3),
        }
    )
    names = ["v", "gap", "none", "nan", "same"]
    got = {(r["k"], r["column"], r["prob"]): r["value"] for r in exact_quantiles(odd, names, [0.25, 0.5, 0.9], by=["k"], most=most).collect()}
    ids = np.arange(len(v))
    want = {}
    for k in range(5):
        here = ids % 5 == k
        kinds = {"v": v[here], "gap": v[here & (ids % 7 == 0)], "nan": v[here & (ids % 2 == 1)], "same": np.full(here.sum(), 3.0)}
        want |= {(k or None, c, p): np.quantile(x, p) for c, x in kinds.items() for p in (0.25, 0.5, 0.9)}
    assert set(got) == set(want)
    assert {x: got[x] for x in got} == pytest.approx(want)
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_average_ranks(values):
    v, df = values
    got = {r["value"]: r["avg_rank"] for r in average_ranks(df, "v", {}).collect()}
    order = np.sort(v)
    for x in (0.25, float(order[0]), float(order[-1])):
        assert got[x] == (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def test_sample_is_exact_and_independent_of_partitions(values):
    _, df = values
    a = {r["id"] for r in sampling.sample_rows(df.repartition(1), 100, ["id"]).collect()}
    b = {r["id"] for r in sampling.sample_rows(df.repartition(7), 100, ["id"]).collect()}
    assert len(a) == 100 and a == b


def test_split_keeps_class_shares(values):
    _, df = values
    s = sampling.stratified_split(df, "y", ["id"])
    got = {(r["y"], r["is_train"]): r["count"] for r in s.groupBy("y", "is_train").count().collect()}
    assert got == {(0, True): 640, (0, False): 160, (1, True): 320, (1, False): 80}


def test_batches_respect_the_size(spark):
    df = spark.range(1000).select(F.col("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"))
    b = batching.request_batches(df, "id", 5, 64).groupBy("date_group", "batch_no").count().collect()
    assert sum(r["count"] for r in b) == 1000 and max(r["count"] for r in b) <= 64


def test_place_groups_stay_within_a_kilometre(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(41, 41.1, 500), rng.uniform(-107, -106.9, 500))]
    g = batching.place_groups(spark.createDataFrame(rows, "latitude double, longitude double"))
    assert g.agg(F.max("extent_km")).first()[0] <= 1.0
    assert g.agg(F.sum("n")).first()[0] == 500
