"""Exact nearest features of any number of layers in one walk over an adaptive grid.

A fixed grid breaks down where points or features crowd: one cell may hold a third of
both. Here only *cells* are compared first. Starting at the reach of the search, every query
cell keeps, layer by layer, the feature cells whose lower distance bound does not exceed the
best upper bound; cells whose surviving feature count is still above ``max_candidates`` are
split and compared again, and nothing but these open cells is looked at again. Splitting goes
on until distinct coordinates lie in distinct cells, so a candidate list stays short wherever
features crowd (what can exceed it is features at the same millimetre from a point).

All layers share the query cells: each is given the finest level that a layer needs there, and
one row with a short list per layer. A point is joined once by its cell and once with that
row: no pairs are emitted, and a hot cell is an ordinary skewed equi-join against a unique
key, which AQE splits. Distances to a list are measured in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.geo import EARTH_KM, point_segment_distance_m
from terrasift.functions.vegetation import lookup
from terrasift.operators.lineage import cut_lineage

STEP = 2  # levels between rounds: a cell splits into 4 x 4
MAX_LEVEL = 46  # 1 degree / 2**46 tells all coordinates apart that a double tells apart
FINEST = 2**MAX_LEVEL
NOWHERE = -(2**62)  # no cell has this index
KM_PER_DEGREE = 110.57
LEVELS = range(0, MAX_LEVEL + 1, STEP)


def _up(index: Column, level: int) -> Column:
    """Cell index at ``level`` from the finest one."""
    return F.shiftright(index, MAX_LEVEL - level)


def _finest(value: Column) -> Column:
    return F.floor(value * FINEST).cast("bigint")


def _size(level: int) -> float:
    return 1.0 / 2**level


def _by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by key. Its size is that of points or features, however small
    the files that it is derived from let it look, so it must not travel through the driver."""
    return df.hint("merge")


def _arc_km(hav: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(hav, F.lit(1.0))))


def _bounds_km(level: int) -> tuple[Column, Column]:
    """(lower, upper) distance between points of cell (qx, qy) and of cell (fx, fy)."""
    s = _size(level)
    gap_x = F.greatest(F.abs(F.col("qx") - F.col("fx")) - 1, F.lit(0)) * s
    gap_y = F.greatest(F.abs(F.col("qy") - F.col("fy")) - 1, F.lit(0)) * s
    far_x = (F.abs(F.col("qx") - F.col("fx")) + 1) * s
    far_y = (F.abs(F.col("qy") - F.col("fy")) + 1) * s
    south = F.least("qy", "fy") * s
    north = (F.greatest("qy", "fy") + 1) * s
    polar = F.greatest(F.abs(south), F.abs(north))
    tropic = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))

    def hav(dy: Column, dx: Column, lat: Column) -> Column:
        c = F.cos(F.radians(F.least(lat, F.lit(90.0))))
        return F.pow(F.sin(F.radians(dy) / 2), 2) + c * c * F.pow(F.sin(F.radians(F.least(dx, F.lit(180.0))) / 2), 2)

    return _arc_km(hav(gap_y, gap_x, polar)), _arc_km(hav(far_y, far_x, tropic))


def _survivors(pairs: DataFrame, level: int, cap_km: float) -> DataFrame:
    lower, upper = _bounds_km(level)
    bounded = pairs.withColumns({"lower": F.greatest(lower - F.col("half_km"), F.lit(0.0)), "upper": upper})
    cell = Window.partitionBy("layer", "qx", "qy")
    best = F.least(F.min("upper").over(cell), F.lit(cap_km))
    # segments are measured on a plane at the point, which bends away from the sphere with distance
    steep = F.greatest(F.lit(1.0), F.tan(F.radians(F.least(F.abs(F.col("qy") * _size(level)), F.lit(85.0)))))
    bend = F.when(F.max("half_km").over(cell) > 0, 2 * steep * best / EARTH_KM).otherwise(0.0)
    # small slack keeps boundary candidates despite rounding
    reach = best * (1 + 1e-9 + bend) + 2e-6
    # where the bend exceeds the cell many times over, splitting it leaves no fewer
    fixed = best * bend > 4 * KM_PER_DEGREE * _size(level)
    return bounded.withColumns({"reach": reach, "fixed": fixed}).filter(F.col("lower") <= F.col("reach")).drop("lower", "upper", "reach")


def _start_level(reach_km: float) -> int:
    """Finest level at which the reach spans at most four cells per side."""
    fits = [k for k in LEVELS if reach_km <= 4 * KM_PER_DEGREE * _size(k)]
    return max(fits, default=0)


def candidate_cells(
    q_cells: DataFrame, f_cells: DataFrame, cap_km: float, max_candidates: int, slack_km: float = 0.0
) -> DataFrame:
    """(layer, level, qx, qy, fx, fy): final query cells of each layer with their feature cells.

    ``f_cells`` has (layer, ix, iy, n, half_km). Cells without a feature in reach have no rows.
    Features may extend up to ``slack_km`` from the cell they are filed under. A round reads
    the children of the cells that are still open, and only those.
    """
    reach = cap_km + slack_km
    level = _start_level(reach)
    s = _size(level)
    q = q_cells.select(_up(F.col("ix"), level).alias("qx"), _up(F.col("iy"), level).alias("qy")).distinct()
    ky = math.ceil(reach / (KM_PER_DEGREE * s))
    edge = F.greatest(F.abs(F.col("qy") * s), F.abs((F.col("qy") + 1) * s)) + ky * s
    shrink = F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01))
    kx = F.ceil(reach / (KM_PER_DEGREE * s * shrink)).cast("int")
    around = q.select(
        "qx",
        "qy",
        F.explode(F.sequence(F.lit(-ky), F.lit(ky))).alias("dy"),
        F.sequence(-kx, kx).alias("dxs"),
    ).select("qx", "qy", (F.col("qy") + F.col("dy")).alias("fy"), F.explode("dxs").alias("dx"))
    held = [F.sum("n").alias("n"), F.max("half_km").alias("half_km")]
    counts = f_cells.groupBy("layer", _up(F.col("ix"), level).alias("fx"), _up(F.col("iy"), level).alias("fy")).agg(*held)
    pairs = around.withColumn("fx", F.col("qx") + F.col("dx")).join(_by_key(counts), ["fx", "fy"])
    finals = None
    while True:
        kept = _survivors(pairs.select("layer", "qx", "qy", "fx", "fy", "n", "half_km"), level, cap_km)
        load = F.sum("n").over(Window.partitionBy("layer", "qx", "qy"))
        state = cut_lineage(
            kept.withColumn("done", (load <= max_candidates) | F.col("fixed") | F.lit(level == MAX_LEVEL)).select("layer", "qx", "qy", "fx", "fy", "done")
        )
        done = state.filter("done").select("layer", F.lit(level).alias("level"), "qx", "qy", "fx", "fy")
        finals = done if finals is None else finals.unionByName(done)
        open_pairs = state.filter(~F.col("done"))
        if level == MAX_LEVEL or open_pairs.isEmpty():
            return finals
        below = level + STEP
        open_q = open_pairs.select("layer", F.col("qx").alias("px"), F.col("qy").alias("py")).distinct()
        open_f = open_pairs.select("layer", F.col("fx").alias("gx"), F.col("fy").alias("gy")).distinct()
        children = lambda cells, x, y: cells.withColumns({x: _up(F.col("ix"), level), y: _up(F.col("iy"), level)})
        at = lambda x, y: [_up(F.col("ix"), below).alias(x), _up(F.col("iy"), below).alias(y)]
        q_next = (
            children(q_cells, "px", "py")
            .join(_by_key(open_q), ["px", "py"], "left_semi")
            .select("px", "py", *at("qx", "qy"))
            .distinct()
        )
        f_next = (
            children(f_cells, "gx", "gy")
            .join(_by_key(open_f), ["layer", "gx", "gy"], "left_semi")
            .groupBy("layer", "gx", "gy", *at("fx", "fy"))
            .agg(*held)
        )
        parents = open_pairs.select(
            "layer", F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("fx").alias("gx"), F.col("fy").alias("gy")
        )
        pairs = parents.join(_by_key(q_next), ["px", "py"]).join(_by_key(f_next), ["layer", "gx", "gy"])
        level = below


@dataclass
class Layer:
    """Features with ``lat``/``lon``, or segments with ``lat1, lon1, lat2, lon2``; ``out`` names the result."""

    features: DataFrame
    out: str
    feature_id: str = "feature_id"
    payload: list[str] = field(default_factory=list)
    unrounded: bool = False  # distances as computed; they are compared in millimetres all the same

    @property
    def segments(self) -> bool:
        return "lat1" in self.features.columns

    @property
    def geometry(self) -> list[str]:
        return ["lat1", "lon1", "lat2", "lon2"] if self.segments else ["lat", "lon"]


def _xyz(la: str, lo: str) -> list[Column]:
    p, q = F.radians(la), F.radians(lo)
    return [(F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z")]


def _pieces(layer: Layer) -> DataFrame:
    """(lat, lon, half_km, geometry..., who): equal geometries collapse to the smallest id."""
    feats = layer.features
    if layer.segments:
        long_way = point_segment_distance_m(
            F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), F.col("lat2"), F.col("lon2")
        )
        # long segments are cut into pieces of at most 10 km
        pieces = F.greatest(F.ceil(long_way / 10000.0).cast("int"), F.lit(1))
        cut = feats.withColumn("_k", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_k")
        cut = cut.select(
            layer.feature_id,
            *layer.payload,
            at("lat1", "lat2", F.col("_i")).alias("lat1"),
            at("lon1", "lon2", F.col("_i")).alias("lon1"),
            at("lat1", "lat2", F.col("_i") + 1).alias("lat2"),
            at("lon1", "lon2", F.col("_i") + 1).alias("lon2"),
            (long_way / F.col("_k") / 2000.0 * 1.01 + 1e-6).alias("half_km"),
        )
        feats = cut.withColumns({"lat": (F.col("lat1") + F.col("lat2")) / 2, "lon": (F.col("lon1") + F.col("lon2")) / 2})
    else:
        feats = feats.withColumn("half_km", F.lit(0.0))
    who = F.min(F.struct(layer.feature_id, *layer.payload)).alias("who")
    located = feats.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.groupBy(*dict.fromkeys(["lat", "lon", "half_km", *layer.geometry])).agg(who)


def _flat(items: pa.Array) -> np.ndarray:
    return items.flatten().to_numpy(zero_copy_only=False)


def _first_best(km: np.ndarray, own: np.ndarray, lengths: np.ndarray, unrounded: bool) -> pa.Array:
    """(place, km) of the first of each list's items nearest in millimetres; null for empty lists.

    Unrounded, the nearest one of those that share its ``own`` hash.
    """
    place, best = np.zeros(len(lengths), np.int32), np.zeros(len(lengths))
    held = lengths > 0
    if held.any():
        mm = np.rint(km * 1e6)
        mm[np.isnan(mm)] = np.inf
        starts = (np.cumsum(lengths) - lengths)[held]
        row, at = np.repeat(np.arange(len(starts)), lengths[held]), np.arange(len(mm))
        least = np.minimum.reduceat(mm, starts)
        hit = mm == least[row]
        first = np.minimum.reduceat(np.where(hit, at, len(mm)), starts)
        if unrounded:
            exact = np.where(hit & (own == own[first][row]), km, np.inf)
            hit = exact == np.minimum.reduceat(exact, starts)[row]
            first = np.minimum.reduceat(np.where(hit, at, len(mm)), starts)
        place[held] = first - starts
        best[held] = np.where(np.isinf(least), np.inf, km[first] if unrounded else least / 1e6)
    return pa.StructArray.from_arrays([pa.array(place), pa.array(best)], ["place", "km"], mask=pa.array(~held))


def _best_of_points(unrounded: bool):
    @F.arrow_udf("place int, km double")
    def best(px: pa.Array, py: pa.Array, pz: pa.Array, x: pa.Array, y: pa.Array, z: pa.Array, own: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
        at = lambda c: np.repeat(c.to_numpy(zero_copy_only=False), lengths)
        dx, dy, dz = _flat(x) - at(px), _flat(y) - at(py), _flat(z) - at(pz)
        km = np.arcsin(np.sqrt(dx * dx + dy * dy + dz * dz) / 2) * (2 * EARTH_KM)
        return _first_best(km, _flat(own), lengths, unrounded)

    return best


def _best_of_segments(unrounded: bool):
    """Distances as ``point_segment_distance_m`` has them."""

    @F.arrow_udf("place int, km double")
    def best(
        lat: pa.Array, lon: pa.Array, shrink: pa.Array, lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array, own: pa.Array
    ) -> pa.Array:
        lengths = pc.list_value_length(lat1).fill_null(0).to_numpy(zero_copy_only=False)
        at = lambda c: np.repeat(c.to_numpy(zero_copy_only=False), lengths)
        k = EARTH_KM * 1000.0 * math.pi / 180.0
        y, x, s = at(lat), at(lon), at(shrink)
        ax, ay, bx, by = (_flat(lon1) - x) * s * k, (_flat(lat1) - y) * k, (_flat(lon2) - x) * s * k, (_flat(lat2) - y) * k
        dx, dy = bx - ax, by - ay
        len2 = dx * dx + dy * dy
        t = np.divide(-(ax * dx + ay * dy), len2, out=np.zeros_like(len2), where=len2 > 0)
        t = np.minimum(np.maximum(t, 0.0), 1.0)
        return _first_best(np.hypot(ax + t * dx, ay + t * dy) / 1000, _flat(own), lengths, unrounded)

    return best


def nearest_layers(
    points: DataFrame, layers: list[Layer], cap_km: float = 100.0, lat: str = "latitude", lon: str = "longitude", max_candidates: int = 24
) -> DataFrame:
    """Adds a struct per layer (distance_km, feature id, payload...), null beyond ``cap_km``.

    Distances are compared at one-millimetre resolution and ties go to the smallest id.
    Points without coordinates keep null structs.
    """
    pieces = [_pieces(x).withColumns({"ix": _finest(F.col("lon")), "iy": _finest(F.col("lat"))}) for x in layers]
    filed = None
    for k, (x, feats) in enumerate(zip(layers, pieces)):
        shape = x.geometry if x.segments else _xyz("lat", "lon")
        own = feats.select(F.lit(k).alias("layer"), "ix", "iy", "half_km", F.struct("who", *shape, F.xxhash64("who").alias("own")).alias(f"item{k}"))
        filed = own if filed is None else filed.unionByName(own, allowMissingColumns=True)
    filed = cut_lineage(filed)
    f_cells = cut_lineage(filed.groupBy("layer", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.max("half_km").alias("half_km")))
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    q_cells = cut_lineage(
        points.filter(located)
        .select(_finest(F.col(lon)).alias("ix"), _finest(F.col(lat)).alias("iy"))
        .distinct()
    )
    slack = 6.0 if any(x.segments for x in layers) else 0.0
    finals = candidate_cells(q_cells, f_cells, cap_km, max_candidates, slack)
    levels = sorted(r["level"] for r in finals.select("level").distinct().collect())  # at most MAX_LEVEL / STEP + 1

    def keys(x: str, y: str) -> Column:
        at = [F.struct(F.lit(k).alias("level"), _up(F.col(x), k).alias("cx"), _up(F.col(y), k).alias("cy")) for k in levels]
        return F.array(*at) if at else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")

    # every finest query cell lies in one final cell of each layer; the finest of these is its own
    final_cells = finals.select("layer", "level", F.col("qx").alias("cx"), F.col("qy").alias("cy")).distinct()
    placed = (
        q_cells.select("ix", "iy", F.explode(keys("ix", "iy")).alias("k"))
        .select("ix", "iy", "k.level", "k.cx", "k.cy")
        .join(_by_key(final_cells), ["level", "cx", "cy"])
    )
    own_level = cut_lineage(placed.groupBy("ix", "iy").agg(F.max("level").alias("own")))
    up_to = lambda c: F.expr(f"shiftright({c}, {MAX_LEVEL} - own)")
    parts = placed.join(_by_key(own_level), ["ix", "iy"]).select("own", up_to("ix").alias("ox"), up_to("iy").alias("oy"), "layer", "level", "cx", "cy").distinct()
    by_cell = filed.select("layer", *[f"item{k}" for k in range(len(layers))], F.explode(keys("ix", "iy")).alias("k")).select(
        "layer", *[f"item{k}" for k in range(len(layers))], "k.level", F.col("k.cx").alias("fx"), F.col("k.cy").alias("fy")
    )
    lists = finals.withColumnsRenamed({"qx": "cx", "qy": "cy"}).join(_by_key(parts), ["layer", "level", "cx", "cy"])
    lists = lists.join(_by_key(by_cell), ["layer", "level", "fx", "fy"])
    index = lists.groupBy("own", "ox", "oy").agg(*[F.sort_array(F.collect_list(f"item{k}")).alias(f"_c{k}") for k in range(len(layers))])
    # what depends on the point alone is computed once, outside the candidate walk
    keyed = points.withColumns({"_ix": _finest(F.col(lon)), "_iy": _finest(F.col(lat)), "_shrink": F.cos(F.radians(lat))})
    keyed = keyed.withColumns(dict(zip(("_px", "_py", "_pz"), _xyz(lat, lon))))
    settled = own_level.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "own", up_to("ix").alias("ox"), up_to("iy").alias("oy"))
    # points without coordinates, or without a feature in reach, meet nothing: their keys spread them over the tasks
    spread = F.xxhash64(*[c for c, t in points.dtypes if "map<" not in t])
    keyed = keyed.withColumns({"_ix": F.when(located, F.col("_ix")).otherwise(spread), "_iy": F.when(located, F.col("_iy")).otherwise(NOWHERE)})
    joined = keyed.join(_by_key(settled), ["_ix", "_iy"], "left")
    alone = {"own": F.lit(-1), "ox": F.col("_ix"), "oy": F.col("_iy")}
    joined = joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in alone.items()}).join(_by_key(index), ["own", "ox", "oy"], "left")

    def best_of(k: int, x: Layer) -> Column:
        items = lambda *names: [F.col(f"_c{k}.{n}") for n in names]
        if x.segments:
            return _best_of_segments(x.unrounded)(F.col(lat), F.col(lon), F.col("_shrink"), *items(*x.geometry, "own"))
        return _best_of_points(x.unrounded)(F.col("_px"), F.col("_py"), F.col("_pz"), *items("x", "y", "z", "own"))

    joined = joined.withColumns({f"_b{k}": best_of(k, x) for k, x in enumerate(layers)})

    def result(k: int, x: Layer) -> Column:
        km, who = F.col(f"_b{k}.km"), F.get(f"_c{k}", F.col(f"_b{k}.place"))["who"]
        return F.when(km <= cap_km, F.struct(km.alias("distance_km"), *[who[c].alias(c) for c in (x.feature_id, *x.payload)])).alias(x.out)

    return joined.select(*points.columns, *[result(k, x) for k, x in enumerate(layers)])


def nearest(
    points: DataFrame,
    features: DataFrame,
    cap_km: float = 100.0,
    feature_id: str = "feature_id",
    payload: list[str] | None = None,
    lat: str = "latitude",
    lon: str = "longitude",
    out: str = "nearest",
    max_candidates: int = 24,
) -> DataFrame:
    """``nearest_layers`` for a single layer."""
    return nearest_layers(points, [Layer(features, out, feature_id, payload or [])], cap_km, lat, lon, max_candidates)


def with_distance(
    candidates: DataFrame, obstacles: DataFrame, metres: float, out: str, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Adds the metres to the nearest obstacle (``lat``/``lon`` columns), null beyond ``metres``."""
    ids = obstacles.select("lat", "lon", F.lit(0).alias("obstacle_id"))
    near = nearest(candidates, ids, metres / 1000.0, "obstacle_id", lat=lat, lon=lon, out="_near")
    return near.withColumn(out, F.col("_near.distance_km") * 1000).drop("_near")


def beyond_distance(
    candidates: DataFrame, obstacles: DataFrame, metres: float, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Candidates at least ``metres`` away from every obstacle (``lat``/``lon`` columns)."""
    ids = obstacles.select("lat", "lon", F.lit(0).alias("obstacle_id"))
    near = nearest(candidates, ids, metres / 1000.0, "obstacle_id", lat=lat, lon=lon, out="_near")
    return near.filter(F.col("_near").isNull() | (F.col("_near.distance_km") * 1000 >= metres)).drop("_near")


# Reliability of a water source by type, per consumer.
WATER_RELIABILITY = {
    "context": {"spring": 1.0, "lake": 1.0, "pond": 0.9, "stream": 0.7, "creek": 0.7, "ephemeral": 0.4},
    "hydrography": {"spring": 1.0, "lake": 1.0, "reservoir": 1.0, "stream": 0.7, "canal": 0.9},
}
RELIABILITY_DEFAULT = 0.7
NO_FEATURE_MILES = 10.0
NO_WATER_RELIABILITY = 0.5
KM_TO_MILES = 1000.0 / 1609.34


def water_layer(water: DataFrame) -> Layer:
    return Layer(water, "_water", payload=["water_type"])


def add_water(df: DataFrame) -> DataFrame:
    """``water_distance_miles`` and ``water_reliability`` (10 mi / 0.5 without water in reach) from ``_water``."""
    kind = F.lower(F.coalesce(F.col("_water.water_type"), F.lit("stream")))
    reliability = F.coalesce(lookup(WATER_RELIABILITY["context"], kind), F.lit(RELIABILITY_DEFAULT))
    return df.withColumns(
        {
            "water_distance_miles": F.coalesce(F.col("_water.distance_km") * KM_TO_MILES, F.lit(NO_FEATURE_MILES)),
            "water_reliability": F.when(F.col("_water").isNull(), NO_WATER_RELIABILITY).otherwise(reliability),
        }
    ).drop("_water")


def with_water(points: DataFrame, water: DataFrame, **kw) -> DataFrame:
    return add_water(nearest_layers(points, [water_layer(water)], **kw))


def add_distance(df: DataFrame, layer: str, out: str) -> DataFrame:
    """Miles from a layer's struct; 10 without a feature in reach."""
    return df.withColumn(out, F.coalesce(F.col(f"{layer}.distance_km") * KM_TO_MILES, F.lit(NO_FEATURE_MILES))).drop(layer)


def with_feature_distance(points: DataFrame, features: DataFrame, out: str, **kw) -> DataFrame:
    """Miles to the nearest road, trail or activity record; 10 beyond 100 km."""
    return add_distance(nearest(points, features, out="_feature", **kw), "_feature", out)


def station_layers(stations: DataFrame) -> list[Layer]:
    """Stations with data and those without, each a layer of its own."""
    return [
        Layer(stations.filter("has_data"), "_mapped", "station_id", ["name"]),
        Layer(stations.filter("NOT has_data"), "_unmapped", "station_id", ["name"]),
    ]


def add_station(df: DataFrame) -> DataFrame:
    """Nearest station with data, else nearest of any kind, as struct ``station``."""
    pick = F.coalesce(
        F.when(F.col("_mapped").isNotNull(), F.col("_mapped").withField("has_data", F.lit(True))),
        F.when(F.col("_unmapped").isNotNull(), F.col("_unmapped").withField("has_data", F.lit(False))),
    )
    return df.withColumn("station", pick).drop("_mapped", "_unmapped")


def with_station(points: DataFrame, stations: DataFrame, cap_km: float = 100.0) -> DataFrame:
    return add_station(nearest_layers(points, station_layers(stations), cap_km))
