"""Embedding whitening with weighted multiplicity covariance.

Entries become integers, so equal vectors meet in a grouping. Every distinct vector counts
once, or as often as it occurs, in the fit. The covariance is a weighted product of centred
blocks, summed over tasks; its eigenvectors, a table as small as the dimension squared, are
found on the driver. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import join_dealt, keep

SHIFT, SCALE = 1_000_000, 64
LARGEST = 2.0**62  # scaled entries beyond it fit no long
TINY = 1e-12  # eigenvalues below this share of the largest are rounding


def fixed_point(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of every entry; null where any is null, not finite or fits no long."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    whole = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(whole, F.transform(scaled, lambda c: F.floor(c) + SHIFT))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights and weighted sums of a task, one row a dimension; dimension -1 holds the weights."""
    n, total = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, w = _matrix(batch, "x"), batch.column("weight").to_numpy()
        if float(np.abs(x.astype(np.float64)).max()) * float(w.astype(np.float64).sum()) < 2.0**62:
            own = (x * w[:, None]).sum(axis=0).tolist()
        else:
            own = [sum(int(a) * int(b) for a, b in zip(column, w)) for column in x.T]
        n, total = n + int(w.sum()), own if total is None else [a + b for a, b in zip(total, own)]
    rows = [(-1, str(n)), *((i, str(s)) for i, s in enumerate(total or []))]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["dim", "s"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles: whole parts exactly first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _gram(n: int, sums: list[int] | None):
    """Arrow function: a task's sum of weighted outer products, centred first where sums are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z = centred(_matrix(part, "x"), n, sums) if sums else _matrix(part, "z")
                own = (z * part.column("weight").to_numpy()[:, None]).T @ z
                total = own if total is None else total + own
        size = 0 if total is None else len(total)
        row, col = np.divmod(np.arange(size * size), max(size, 1))
        values = total.ravel() if size else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(values)], ["i", "j", "v"])

    return run


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The tasks' matrices added up; ``size`` squared numbers reach the driver."""
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2; null where it fits no long."""
    s = np.array(sums, np.float64)
    rough = ((n * x.astype(np.float64) - s) ** 2).sum(axis=1)
    if n * float(np.abs(x).max(initial=0)) < 2.0**62 and np.abs(s).max(initial=0) < 2.0**62 and rough.max(initial=0) < 2.0**62:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1))
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _whitened(n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            z = centred(x, n, sums) @ vectors / np.sqrt(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("copies"), batch.column("weight"), lists, deviation(x, n, sums)], ["x", "copies", "weight", "z", "deviation"]
            )

    return run


def whiten(
    vectors: DataFrame, components: int = 16, by_count: bool = False, id_column: str = "vec_id", vector_column: str = "embedding",
    dimensions: int | None = None,
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of rows and components.

    Rows whose vector is null, empty or holds null or non-finite entries go, as do entries of
    2^62 / 64 and more, and vectors of another length than ``dimensions`` (default: the commonest
    length, of equally common ones the larger). Each distinct vector weighs one in the fit, or
    its number of rows if ``by_count``; n is the sum of weights. Components are numbered by
    falling eigenvalue; those without variance (all vectors alike in their direction) have no
    rows. Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    ``deviation`` is null where it fits no long. Dimensions squared numbers reach the driver.
    """
    spark = vectors.sparkSession
    own = vectors.select(vectors[id_column].alias("vec_id"), fixed_point(vectors[vector_column]).alias("x")).where(F.size("x") > 0)
    id_type = own.schema["vec_id"].dataType.simpleString()
    nothing = spark.createDataFrame(
        [], f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    lengths = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    size = dimensions or next((r["d"] for r in lengths.collect()), 0)
    own = own.where(F.size("x") == size)
    weight = F.col("copies") if by_count else F.lit(1).cast("bigint")
    fit, _ = keep(own.groupBy("x").agg(F.count("*").alias("copies")).withColumn("weight", weight))
    sums = {r["dim"]: int(r["s"]) for r in fit.mapInArrow(_sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()}
    n = sums.pop(-1, 0)
    if not n:
        return nothing
    sums = [sums[i] for i in range(size)]
    covariance = _summed(fit.mapInArrow(_gram(n, sums), "i int, j int, v double"), size) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > TINY * max(values.max(), 0)]
    if not len(order):
        return nothing
    schema = "x array<bigint>, copies bigint, weight bigint, z array<double>, deviation bigint"
    done, _ = keep(fit.mapInArrow(_whitened(n, sums, axes[:, order], values[order]), schema))
    gram = _summed(done.mapInArrow(_gram(n, None), "i int, j int, v double"), len(order)) / n
    means = done.select(F.posexplode("z").alias("i", "v"), "weight").groupBy("i").agg(F.sum(F.col("v") * F.col("weight")).alias("v")).collect()
    mean = np.array([r["v"] / n for r in sorted(means, key=lambda r: r["i"])])
    error = float(np.abs(gram - np.outer(mean, mean) - np.eye(len(order))).max())
    explained = F.element_at(F.array(*[F.lit(float(v / np.trace(covariance))) for v in values[order]]), F.col("component"))
    rows = join_dealt(own, done, ["x"], "copies", ["vec_id"])
    out = rows.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return out.select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
