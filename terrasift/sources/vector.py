"""GeoJSON, hydrography, road and trail layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.geo import line_length_km
from terrasift.functions.vegetation import lookup
from terrasift.operators.features import STUDY_AREA, inside_box
from terrasift.operators.nearest import RELIABILITY_DEFAULT, WATER_RELIABILITY

# Feature-type codes of hydrography layers and their water type.
FLOWLINE_TYPES = {460: "stream", 558: "canal", 336: "stream", 334: "stream"}
WATERBODY_TYPES = {390: "lake", 436: "reservoir"}
SPRING_TYPES = {388: "spring"}

# Road class codes; walkways (S1830) are not roads.
ROAD_TYPES = {
    "S1100": "primary",
    "S1200": "primary",
    "S1400": "secondary",
    "S1500": "tertiary",
    "S1710": "unclassified",
    "S1720": "unclassified",
    "S1730": "unclassified",
    "S1740": "unclassified",
    "S1750": "unclassified",
    "S1780": "unclassified",
    "S1820": "unclassified",
}

FEATURE_SCHEMA = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(properties, geometry_type, coordinates as JSON text) per feature.

    A feature collection is one JSON value and is read by one task per file; large
    layers should come as newline-delimited features (``lines=True``), which split.
    """
    if lines:
        f = spark.read.schema(FEATURE_SCHEMA).json(path)
    else:
        doc = spark.read.schema(f"features array<struct<{_struct(FEATURE_SCHEMA)}>>").option("multiLine", True).json(path)
        f = doc.select(F.explode("features").alias("f")).select("f.*")
    return f.select("properties", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def _struct(ddl: str) -> str:
    return ddl.replace("type string", "type:string").replace("properties map", "properties:map").replace("geometry struct", "geometry:struct")


def flat_vertices(geometry_type: Column, coordinates: Column) -> Column:
    """All vertices of any geometry type as ``array<struct<lon,lat>>``."""

    def at(depth: int) -> Column:
        value = F.from_json(coordinates, "array<" * depth + "array<double>" + ">" * depth)
        for _ in range(depth - 1):
            value = F.flatten(value)
        return value

    single = F.array(F.from_json(coordinates, "array<double>"))
    nested = (
        F.when(geometry_type == "Point", single)
        .when(geometry_type.isin("LineString", "MultiPoint"), at(1))
        .when(geometry_type.isin("Polygon", "MultiLineString"), at(2))
        .when(geometry_type == "MultiPolygon", at(3))
    )
    return F.transform(nested, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def classify_water(df: DataFrame, types: dict[int, str], default_type: str, default_reliability: float = RELIABILITY_DEFAULT) -> DataFrame:
    """Keep the layer's feature types and add water_type, reliability and name."""
    kind = F.coalesce(lookup(types, F.col("ftype")), F.lit(default_type))
    names = [F.col(c) for c in ("gnis_name", "gnis_name_alt") if c in df.columns]
    out = df.filter(F.col("ftype").isin(*types)).withColumn("water_type", kind)
    reliability = F.coalesce(lookup(WATER_RELIABILITY["hydrography"], F.col("water_type")), F.lit(default_reliability))
    return out.withColumns(
        {"reliability": reliability, "name": F.coalesce(*names) if names else F.lit(None).cast("string")}
    )


def classify_flowlines(df: DataFrame) -> DataFrame:
    return classify_water(df, FLOWLINE_TYPES, "stream")


def classify_waterbodies(df: DataFrame) -> DataFrame:
    """Water bodies and water areas share their codes."""
    return classify_water(df, WATERBODY_TYPES, "lake", 1.0)


def classify_springs(df: DataFrame) -> DataFrame:
    return classify_water(df, SPRING_TYPES, "spring", 1.0)


def combine_water(layers: list[DataFrame], columns: list[str], bounds: dict[str, float] | None = STUDY_AREA) -> DataFrame:
    """Union of classified layers, clipped to the study box, kept to ``columns``."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
    if bounds is not None:
        merged = merged.filter(inside_box(F.col("lat"), F.col("lon"), bounds))
    return merged.select(*columns)


def classify_roads(df: DataFrame, road_types: list[str] | None = None, bounds: dict[str, float] | None = None) -> DataFrame:
    """Road classes by code (unknown codes are unclassified), optionally clipped by first vertex."""
    keep = road_types or list(ROAD_TYPES)
    out = df.filter(F.col("mtfcc").isin(*keep)) if road_types is not None else df.filter(F.col("mtfcc") != "S1830")
    out = out.withColumn("road_type", F.coalesce(lookup(ROAD_TYPES, F.col("mtfcc")), F.lit("unclassified")))
    if bounds is not None:
        first = F.element_at("vertices", 1)
        out = out.filter(inside_box(first["lat"], first["lon"], bounds))
    return out


def clip_lines(df: DataFrame, bounds: dict[str, float] = STUDY_AREA) -> DataFrame:
    """Lines with at least one vertex inside the box."""
    return df.filter(
        F.exists("vertices", lambda v: inside_box(v["lat"], v["lon"], bounds))
    )


def total_length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(line_length_km(F.col("vertices"))).alias("length_km"))


WAYS_SCHEMA = (
    "elements array<struct<type:string, id:bigint, tags:map<string,string>,"
    " geometry:array<struct<lat:double, lon:double>>>>"
)


def trail_ways(documents: DataFrame, column: str = "json") -> DataFrame:
    """Trail lines from map-way documents: ways with two or more vertices and their tags."""
    e = documents.select(F.explode(F.from_json(column, WAYS_SCHEMA)["elements"]).alias("e")).select("e.*")
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    return e.filter((F.col("type") == "way") & (F.size("geometry") >= 2)).select(
        F.col("id").alias("osm_id"),
        tag("name").alias("name"),
        tag("highway").alias("highway"),
        tag("route").alias("route"),
        F.transform("geometry", lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat"))).alias("vertices"),
    )


def simplify_lines(df: DataFrame, key: str, tolerance: float = 0.0001) -> DataFrame:
    """Douglas-Peucker per line row in Arrow batches; lines never meet each other."""
    from terrasift.sources.simplify import simplify_batches

    schema = f"{key} {df.schema[key].dataType.simpleString()}, vertices array<struct<lon:double,lat:double>>"
    return df.select(key, "vertices").mapInPandas(simplify_batches(key, tolerance), schema)
