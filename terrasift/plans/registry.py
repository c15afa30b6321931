"""Registry of runnable queries: builder, covered inventory ids and the SQL twin."""

from __future__ import annotations

import functools
import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrasift.session import apply_runtime_defaults

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register ``fn(spark, sf_dir)``; ``ops`` lists inventory ids separated by spaces."""

    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_defaults(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, tuple(ops.split()), build, sql)
        return fn

    return wrap


MODULES = [
    "scalar_queries",
    "scoring_queries",
    "aggregate_queries",
    "quality_queries",
    "stats_queries",
    "join_queries",
    "spatial_queries",
    "prediction_queries",
    "absence_queries",
    "raster_queries",
    "source_queries",
    "feature_queries",
    "model_queries",
    "incremental_queries",
]


def load() -> dict[str, Query]:
    for module in MODULES:
        if importlib.util.find_spec(f"terrasift.plans.{module}") is None:
            continue
        importlib.import_module(f"terrasift.plans.{module}")
    return QUERIES
