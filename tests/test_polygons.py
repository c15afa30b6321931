"""Coverings against a plain ray cast on random shapes, and the hunt-area fallback."""

import math
import random

import pytest

from terrasift.operators import polygons

RINGS = "array<array<struct<lon:double,lat:double>>>"


def star(rng, x, y, r, n):
    """A simple ring around (x, y) with ``n`` vertices at random distances: mostly concave."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * d * math.cos(t), y + r * d * math.sin(t)) for t, d in ((t, rng.uniform(0.3, 1)) for t in turns)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.05, 0.25, 3.0])
def test_coverings_match_the_ray_cast(spark, size):
    rng = random.Random(int(size * 100))
    shapes = {}
    for k in range(12):
        x, y = rng.uniform(-108, -106), rng.uniform(42, 44)
        shapes[k] = [star(rng, x, y, 0.8, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 4))]
    shapes[12] = [[(-107.5, 42.5), (-107.0, 42.5), (-107.0, 43.0), (-107.5, 43.0)], [(-107.25, 42.75), (-107.0, 42.75), (-107.0, 43.0), (-107.25, 43.0), (-107.25, 42.75)]]
    shapes[13] = [[(-107.0, 43.0), (-106.0, 43.0), (-106.5, 43.5)], []]
    at = [(rng.uniform(-109, -105), rng.uniform(41, 45)) for _ in range(300)]
    at += [(-107.5, 42.75), (-107.25, 42.75), (-107.0, 43.0), (-106.5, 43.0), (-107.3, 42.6), (-106.5, 43.25), (-107.1, 42.9), (-106.5, 43.5)]  # edges, corners, holes
    areas = spark.createDataFrame([(k, f"n{k}", [[{"lon": a, "lat": b} for a, b in r] for r in v]) for k, v in shapes.items()], f"area_id int, name string, rings {RINGS}")
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)] + [(-1, None, None)], "id int, latitude double, longitude double")
    got = {r["id"]: r["area"] for r in polygons.first_containing(points, areas, "area_id", ["name"], size=size).collect()}
    assert len(got) == len(at) + 1 and got.pop(-1) is None
    for i, (x, y) in enumerate(at):
        held = [k for k, v in shapes.items() if inside(x, y, v)]
        assert (got[i] and (got[i]["area_id"], got[i]["name"])) == ((held[0], f"n{held[0]}") if held else None), (x, y)
    assert {r["area"] for r in polygons.first_containing(points, areas.limit(0), "area_id", ["name"]).collect()} == {None}


def test_hunt_area_with_and_without_polygon(spark):
    points = spark.createDataFrame([(1, 43.0707, -107.5), (2, 43.5, -107.5), (3, 43.8, -107.5), (4, None, None)], "id int, latitude double, longitude double")
    found = lambda **kw: {r["id"]: r["in_hunt_area"] for r in polygons.with_hunt_area(points, **kw).collect()}
    assert found() == {1: True, 2: True, 3: False, 4: None}
    ring = [{"lon": x, "lat": y} for x, y in ((-108.0, 43.4), (-107.0, 43.4), (-107.0, 43.9), (-108.0, 43.9))]
    areas = spark.createDataFrame([(48.0, ring), (7.0, ring)], "hunt_area double, ring array<struct<lon:double,lat:double>>")
    assert found(areas=areas) == {1: False, 2: True, 3: True, 4: False}
    assert found(areas=areas.filter("hunt_area = 7")) == found()
