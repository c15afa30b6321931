"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import forget, keep


def _mark(edges: DataFrame) -> tuple:
    """Size and content mark of an edge set; equal marks end the rounds."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's smallest node.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of
    them, so paths shorten geometrically. Rounds are joins and aggregates on the node; the
    edge set never grows and each round is written to the shared folder.
    """
    spark = edges.sparkSession
    edges, path = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned, new_path = keep(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        forget(spark, path)
        edges, path, before, mark = turned, new_path, mark, _mark(turned)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
