"""Tables kept in the cluster's shared folder, and small helpers for Arrow tasks."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.lineage import shared_folder


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet under ``spark.checkpoint.dir`` and reads it back.

    Unlike ``checkpoint()`` it computes the plan once, compresses and keeps column pruning.
    Returns the table and its path; ``forget`` removes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a kept table through the file system it lives in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver's JVM collect, so Spark's cleaner drops the shuffle files of queries that are over.

    Twice, as the last plan is let go of by what the first pass finalises.
    """
    collect = spark.sparkContext._jvm.java.lang.System.gc
    collect()
    time.sleep(1)
    collect()


def join_dealt(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, salt: list[str], hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``unique``, one row a key, whose column ``count`` tells the rows of each key.

    Keys that hold more than one in ``hot`` rows, so fewer than ``hot`` keys, are broadcast to
    both sides: their rows are dealt out by a hash of ``salt``, their row of ``unique`` repeated.
    """
    total = unique.agg(F.sum(count)).first()[0] or 1
    often = unique.where(F.col(count) * hot > total)
    often = F.broadcast(often.select(*keys, F.least(F.lit(hot), F.ceil(F.col(count) * hot / total)).cast("int").alias("deal_parts")))
    dealt = rows.join(often, keys, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("deal_parts")), F.lit(0).cast("bigint")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("deal_parts", F.lit(1)).cast("bigint") - 1))
    repeated = unique.join(often, keys, "left").withColumn("deal", every)
    return dealt.drop("deal_parts").join(repeated.drop("deal_parts"), [*keys, "deal"]).drop("deal")


def released(run):
    """An Arrow function that hands its freed memory back when a task is over; workers live on for others."""

    def run_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run_once


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A batch's texts; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
