"""Session defaults shared by tests, bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators rely on; anything already set on the cluster wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Runtime settings applied where the session leaves them unset. Wide CASE projections
# compile to methods the JVM refuses to optimise past 8000 bytes of bytecode; above the
# limit Spark evaluates them as split functions instead, two to three times faster.
RUNTIME = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def apply_runtime_defaults(spark: SparkSession) -> None:
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME.items():
        if key not in explicit:
            spark.conf.set(key, value)


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("terrasift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TERRASIFT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
