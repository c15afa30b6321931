"""Validations fit on all rows; a table in blocks grows the trees of one in a single task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import blockfit, boosting, models


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 66, 200, 1001])
def test_cuts_by_rank_are_those_of_the_values(n):
    values = np.unique(np.random.default_rng(n).normal(size=n))
    cuts = blockfit.cuts_at(len(values), {int(k): values[k] for k in blockfit._wanted(len(values))})
    assert np.array_equal(cuts, boosting.cuts_of(values[:, None])[0])


def test_streams_go_on_where_others_end():
    whole, part = np.random.default_rng(5), np.random.default_rng(5)
    for _ in range(4):
        draws, order = whole.random(1000), whole.permutation(6)
        state = part.bit_generator.state
        assert np.array_equal(blockfit._stream(state, 300).random(700), draws[300:])
        part.bit_generator.state = blockfit._skip(state, 1000)
        assert np.array_equal(part.permutation(6), order)


@pytest.fixture(scope="module")
def rows(spark):
    """Three features (one with many values, one with few, one with gaps), a label, five groups, keys that come twice."""
    k = F.col("id")
    u = lambda m: F.xxhash64(k, F.lit(m)) % 100_000 / 100_000.0
    df = spark.range(6000).select(
        (k % 5000).alias("key"), u(1).alias("a"), F.round(u(2) * 5).alias("b"), F.when(k % 7 != 0, F.round(u(3), 2)).alias("c"),
        F.when(k % 11 == 0, None).otherwise((k % 5).cast("string")).alias("group"), u(4).alias("noise"),
    )
    return df.withColumn("y", F.when(F.col("key") % 500 != 499, F.expr("cast(a + abs(b) / 5 + coalesce(c, 0.3) + noise > 0.4 as int)"))).drop("noise")


def test_blocks_grow_the_same_trees(rows, monkeypatch):
    jobs = [boosting.job(g, rounds=7, seed=3, least=5.0, tune=t) for g, t in (("0", False), ("1", True), ("2", True), ("none", False), ("2", False))]
    jobs += [boosting.job(None, rounds=4, depth=3, seed=8)]
    args = rows, ["a", "b", "c"], "y", ["key"], F.col("group"), jobs
    alone = blockfit.fitted_on_all(*args)
    monkeypatch.setattr(blockfit, "ONE_TASK", 100)
    monkeypatch.setattr(blockfit, "PART_ROWS", 1700)
    monkeypatch.setattr(blockfit, "BLOCK_ROWS", 600)
    monkeypatch.setattr(blockfit, "CHECKPOINT", 2)
    monkeypatch.setattr(boosting, "fitted", None)
    blocks = blockfit.fitted_on_all(*args)
    for x, y in zip(alone, blocks, strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(x["cuts"], y["cuts"], strict=True))
        assert x["threshold"] == y["threshold"]
        for part in ("feature", "cut", "missing_left"):
            assert np.array_equal(getattr(x["trees"], part), getattr(y["trees"], part))
        assert np.allclose(x["trees"].value, y["trees"].value, rtol=1e-9, atol=1e-12)
        assert np.allclose(x["trees"].gain, y["trees"].gain)
    assert (alone[0]["trees"].feature >= 0).sum() > 20


def test_validations_fit_on_all_rows(spark, monkeypatch):
    k = F.col("id")
    df = spark.range(20_400).select(
        "id", (k * 37 % 101).cast("double").alias("a"), (k % 2).cast("int").alias("elk_present"),
        (41 + k % 4).cast("double").alias("latitude"), (-111 + k % 7).cast("double").alias("longitude"),
    )
    seen, fitted = [], boosting.fitted
    monkeypatch.setattr(boosting, "fitted", lambda s, sample, jobs: seen.append(len(sample.y)) or fitted(s, sample, jobs))
    assert models.fold_validation(df, ["a"], ["id"], folds=2, rounds=1).count() == 2
    assert models.region_validation(df, ["a"], ["id"], threshold=None, rounds=1).count() > 1
    assert seen == [20_400, 20_400]
