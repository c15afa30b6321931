"""Points against tables of polygons: covering cells, containment and boundary distance.

A polygon of any number of rings (parts and holes, even-odd) is covered by grid cells. Cells
that no edge enters lie inside or outside as a whole, so most points need no geometry at all;
a cell that edges cross carries those of its band of latitude, never a whole ring. Boundary
distances are a nearest search over the edges of all polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators.nearest import Layer, nearest_layers

CELL_DEGREES = 0.25
SLACK = 1e-9  # degrees by which an edge's cells reach out, against rounding


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def boundary(areas: DataFrame, area_id: str) -> DataFrame:
    """(area id, x1, y1, x2, y2): every edge of ``ring``, or of all ``rings``; rings need not be closed."""
    rings = F.col("rings") if "rings" in areas.columns else F.array("ring")
    r = areas.select(area_id, F.explode(rings).alias("r")).select(area_id, "r", F.posexplode("r").alias("i", "a"))
    b = F.element_at("r", F.when(F.col("i") + 1 == F.size("r"), 1).otherwise(F.col("i") + 2))
    e = r.withColumn("b", b).select(
        area_id, F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2")
    )
    return e.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Strictly inside by the even-odd rule; ``edges`` are those whose latitudes reach the point's."""

    def flips(e: Column) -> Column:
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(((e["y1"] > y) != (e["y2"] > y)) & (x < at), 1).otherwise(0)

    def touches(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        beside = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        return (turn == 0) & beside & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return (F.aggregate(edges, F.lit(0), lambda n, e: n + flips(e)) % 2 == 1) & ~F.exists(edges, touches)


def covering(areas: DataFrame, area_id: str, size: float = CELL_DEGREES) -> DataFrame:
    """(area id, cy, cx, edges): cells inside (null edges) and cells that the boundary crosses.

    A crossed cell's edges are those of its band, all that a ray from a point in it can meet.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = boundary(areas, area_id).withColumn("cy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    edge = F.struct("x1", "y1", "x2", "y2")
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    bottom, top = at(F.greatest(low, F.col("cy") * size)), at(F.least(high, (F.col("cy") + 1) * size))
    level = F.col("y1") == F.col("y2")
    left = F.when(level, F.least("x1", "x2")).otherwise(F.least(bottom, top)) - SLACK
    right = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(bottom, top)) + SLACK
    e = e.withColumns({"left": _cell(left, size), "right": _cell(right, size)})
    bands = e.groupBy(area_id, "cy").agg(F.collect_list(edge).alias("edges"), F.min("left").alias("first"), F.max("right").alias("last"))
    crossed = e.select(area_id, "cy", F.explode(F.sequence("left", "right")).alias("cx")).distinct()
    between = bands.select(area_id, "cy", "edges", F.explode(F.sequence("first", "last")).alias("cx"))
    x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    whole = between.join(crossed, [area_id, "cy", "cx"], "left_anti").filter(inside_edges(x, y, F.col("edges")))
    return crossed.join(bands.select(area_id, "cy", "edges"), [area_id, "cy"]).unionByName(whole.withColumn("edges", F.lit(None).cast(bands.schema["edges"].dataType)))


def first_containing(
    points: DataFrame, areas: DataFrame, area_id: str, payload: list[str], lat: str = "latitude", lon: str = "longitude", out: str = "area",
    size: float = CELL_DEGREES,
) -> DataFrame:
    """Adds struct ``out`` of the first area (smallest id) that strictly holds the point.

    Areas have unique ids and a ``ring`` or ``rings``. A point meets the one row of its cell,
    which lists areas up to the first that holds the whole cell.
    """
    cells = covering(areas, area_id, size).join(areas.select(area_id, *payload), area_id)
    item = F.struct(area_id, *payload, "edges")
    per_cell = cells.groupBy("cy", "cx").agg(
        F.sort_array(F.collect_list(item)).alias("_areas"), F.min(F.when(F.col("edges").isNull(), F.col(area_id))).alias("_whole")
    )
    per_cell = per_cell.select(
        F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), F.filter("_areas", lambda a: F.coalesce(a[area_id] <= F.col("_whole"), F.lit(True))).alias("_areas")
    )
    x, y = F.col(lon), F.col(lat)
    joined = points.withColumns({"_cy": _cell(y, size), "_cx": _cell(x, size)}).join(per_cell, ["_cy", "_cx"], "left")
    holds = F.filter("_areas", lambda a: a["edges"].isNull() | inside_edges(x, y, a["edges"]))
    joined = joined.withColumn("_hit", F.try_element_at(holds, F.lit(1)))
    found = F.when(F.col("_hit").isNotNull(), F.struct(*[F.col(f"_hit.{c}").alias(c) for c in (area_id, *payload)]))
    return joined.select(*points.columns, found.alias(out))


def nearest_area(
    points: DataFrame, areas: DataFrame, area_id: str, cap_km: float = 400.0, lat: str = "latitude", lon: str = "longitude", out: str = "area",
    size: float = CELL_DEGREES,
) -> DataFrame:
    """Adds struct ``out`` (distance_km, area id): the area that holds the point at distance 0, else
    the one whose boundary is nearest; null beyond ``cap_km`` from all."""
    edges = boundary(areas, area_id).select(
        area_id, F.col("x1").alias("lon1"), F.col("y1").alias("lat1"), F.col("x2").alias("lon2"), F.col("y2").alias("lat2")
    )
    near = nearest_layers(points, [Layer(edges, "_edge", area_id, unrounded=True)], cap_km, lat, lon, max_candidates=64)
    held = first_containing(near, areas, area_id, [], lat, lon, "_held", size)
    inside = F.struct(F.lit(0.0).alias("distance_km"), F.col(f"_held.{area_id}").alias(area_id))
    beyond = F.struct(F.col("_edge.distance_km").alias("distance_km"), F.col(f"_edge.{area_id}").alias(area_id))
    result = F.when(F.col("_held").isNotNull(), inside).when(F.col("_edge").isNotNull(), beyond)
    return held.withColumn(out, result).drop("_edge", "_held")


# Bounds of a hunt area (south, north, west, east) for want of its polygon.
HUNT_BOXES = {"048": (43.0707, 43.7503, -107.9076, -107.1333)}


def with_hunt_area(
    points: DataFrame, areas: DataFrame | None = None, code: str = "048", lat: str = "latitude", lon: str = "longitude", out: str = "in_hunt_area"
) -> DataFrame:
    """Whether a point lies in hunt area ``code``: strictly in its polygons (``hunt_area`` code, ``ring``
    or ``rings``), or within the area's bounds, edges included, where no polygon of it is given."""
    own = None if areas is None else areas.filter(F.col("hunt_area").cast("double") == float(code))
    if own is None or own.isEmpty():
        south, north, west, east = HUNT_BOXES[code]
        return points.withColumn(out, F.col(lat).between(south, north) & F.col(lon).between(west, east))
    numbered = own.withColumn("_part", F.xxhash64("rings" if "rings" in own.columns else "ring"))
    held = first_containing(points, numbered, "_part", [], lat, lon, "_held")
    return held.withColumn(out, F.col("_held").isNotNull()).drop("_held")
