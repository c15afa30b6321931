"""Exactness of the adaptive grid against brute force, with crowded cells."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrasift.operators.nearest import Layer, beyond_distance, nearest, nearest_layers


def hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))


def check(spark, points, feats, cap, **kw):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, latitude double, longitude double")
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(feats)], "feature_id int, lat double, lon double")
    rows = nearest(p, f, cap, **kw).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(points)))
    for r in rows:
        best = min((round(hav(points[r["id"]], q), 6), i) for i, q in enumerate(feats))
        if best[0] > cap:
            assert r["nearest"] is None
        else:
            assert r["nearest"]["distance_km"] == pytest.approx(best[0], abs=2e-6)
            # equally near features may only differ within the compared resolution
            assert abs(hav(points[r["id"]], feats[r["nearest"]["feature_id"]]) - best[0]) < 2e-6


def test_hot_cell(spark):
    """A third of all points and of all features share a few hundred metres."""
    rng = random.Random(3)
    wide = lambda: (rng.uniform(41, 45), rng.uniform(-111, -104))
    tight = lambda: (43 + rng.uniform(0, 0.002), -107 + rng.uniform(0, 0.002))
    points = [wide() for _ in range(200)] + [tight() for _ in range(100)]
    feats = [wide() for _ in range(300)] + [tight() for _ in range(150)]
    check(spark, points, feats, 100.0, max_candidates=8)


def test_far_features_and_caps(spark):
    check(spark, [(41.0, -111.0), (45.0, -104.0), (43.0, -107.0)], [(41.5, -110.5)], 100.0)


def test_negative_and_southern_coordinates(spark):
    check(spark, [(-0.01, 0.01), (-33.9, 18.4), (60.2, 24.9)], [(0.02, -0.02), (-33.7, 18.9), (60.5, 24.0)], 120.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.sampled_from([2.0, 30.0, 100.0]))
def test_random(spark, seed, cap):
    rng = random.Random(seed)
    grid = lambda n: [(41 + rng.randint(0, 400) / 100, -111 + rng.randint(0, 700) / 100) for _ in range(n)]
    check(spark, grid(40), grid(60), cap, max_candidates=4)


def test_null_coordinates_keep_their_row(spark):
    p = spark.createDataFrame([(1, None, -107.0), (2, 43.0, -107.0)], "id int, latitude double, longitude double")
    f = spark.createDataFrame([(7, 43.0, -107.0)], "feature_id int, lat double, lon double")
    got = {r["id"]: r["nearest"] for r in nearest(p, f).collect()}
    assert got[1] is None and got[2]["feature_id"] == 7


def test_identical_features_take_the_smallest_id(spark):
    p = spark.createDataFrame([(1, 43.0, -107.0)], "id int, latitude double, longitude double")
    f = spark.createDataFrame([(9, 43.1, -107.0), (4, 43.1, -107.0)], "feature_id int, lat double, lon double")
    assert nearest(p, f).first()["nearest"]["feature_id"] == 4


def test_long_segment_is_found_beside_its_middle(spark):
    p = spark.createDataFrame([(1, 43.01, -107.5)], "id int, latitude double, longitude double")
    f = spark.createDataFrame(
        [(1, 43.0, -109.0, 43.0, -106.0), (2, 43.2, -107.5, 43.3, -107.5)],
        "feature_id int, lat1 double, lon1 double, lat2 double, lon2 double",
    )
    best = nearest(p, f, 50.0).first()["nearest"]
    assert best["feature_id"] == 1
    assert best["distance_km"] == pytest.approx(0.01 * math.pi / 180 * 6371, rel=1e-3)


def test_separation(spark):
    c = spark.createDataFrame([(1, 43.0, -107.0), (2, 43.1, -107.0)], "id int, latitude double, longitude double")
    o = spark.createDataFrame([(43.005, -107.0)], "lat double, lon double")
    assert [r["id"] for r in beyond_distance(c, o, 2000.0).collect()] == [2]


def test_crowds_below_the_last_metre(spark):
    """Distinct coordinates micrometres apart, far more than a list holds, are still told apart or tie."""
    rng = random.Random(6)
    near = lambda: (43 + rng.random() * 1e-8, -107 + rng.random() * 1e-8)
    check(spark, [near() for _ in range(40)] + [(43.001, -107.0)], [near() for _ in range(300)] + [(43.0, -107.0)] * 50, 100.0, max_candidates=4)


def test_layers_share_a_walk(spark):
    """Points and segments side by side give what each gives alone, also where a layer is empty."""
    rng = random.Random(7)
    at = lambda: (rng.uniform(42, 44), rng.uniform(-108, -106))
    p = spark.createDataFrame([(i, *at()) for i in range(60)] + [(60, None, 1.0)], "id int, latitude double, longitude double")
    dense = spark.createDataFrame([(f"d{i}", *at(), "x") for i in range(400)], "name string, lat double, lon double, kind string")
    sparse = spark.createDataFrame([(i, *at()) for i in range(5)], "feature_id int, lat double, lon double")
    roads = spark.createDataFrame([(i, *at(), *at()) for i in range(30)], "feature_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    layers = [Layer(dense, "a", "name", ["kind"]), Layer(sparse, "b"), Layer(roads, "c"), Layer(sparse.limit(0), "d")]
    rows = {r["id"]: r for r in nearest_layers(p, layers, 50.0, max_candidates=6).collect()}
    assert len(rows) == 61 and all(rows[60][x.out] is None for x in layers)
    for x in layers:
        alone = nearest(p, x.features, 50.0, x.feature_id, x.payload, max_candidates=6)
        assert {r["id"]: r["nearest"] for r in alone.collect()} == {i: r[x.out] for i, r in rows.items()}


def test_points_without_a_feature_are_spread(spark):
    """No null join keys: points that meet nothing, or have no place, aren't all put in one task."""
    far = [(i, 44.0 + i / 1e4, -105.0) for i in range(300)]
    p = spark.createDataFrame([*far, *((k, None, -105.0) for k in range(300, 600)), (600, 41.0, -111.0)], "id int, latitude double, longitude double")
    f = spark.createDataFrame([(7, 41.0, -111.0)], "feature_id int, lat double, lon double")
    out = nearest(p, f, 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(own" in plan and "LeftOuter, ((_ix" in plan and "strategy=merge" in plan
    got = {r["id"]: r["nearest"] for r in out.collect()}
    assert len(got) == 601 and [k for k, v in got.items() if v is not None] == [600]


def test_equal_millimetres_take_the_smallest_id_and_its_own_distance(spark):
    """Unrounded distances belong to the feature that wins by millimetres, not to the nearest one of all."""
    p = spark.createDataFrame([(1, 43.0, -107.0)], "id int, latitude double, longitude double")
    edge = lambda i, d: (i, 43.0 + d, -107.1, 43.0 + d, -106.9)
    f = spark.createDataFrame([edge(9, 0.01), edge(4, 0.01 + 1e-9)], "feature_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    best = nearest_layers(p, [Layer(f, "hit", unrounded=True)]).first()["hit"]
    k = 6371.0 * math.pi / 180
    assert best["feature_id"] == 4 and best["distance_km"] == pytest.approx((0.01 + 1e-9) * k, abs=1e-9)
