"""Deterministic sampling, splits and global numbering that scale past one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.rng import hash_hex, hash_uniform

BUCKET_ROWS = 100_000  # rows numbered in one bucket, about


def hash_digits(rows: int) -> int:
    """Hex digits of a hash that cut so many rows into buckets of ``BUCKET_ROWS``."""
    return max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))


def _before(df: DataFrame, group: list[str], order: str, n: str, out: str) -> DataFrame:
    """Adds the sum of ``n`` over the rows before each one in its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def with_group_rank(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str = "rank", coarse: Column | None = None
) -> DataFrame:
    """Row number per group ordered by (coarse, bucket, order...), without one task per group.

    Rows are numbered inside their bucket only. Offsets come from prefix sums in two levels:
    over the buckets of a ``coarse`` part, and over the parts, so no task sees all buckets.
    Also adds ``<out>_total``, the group size.
    """
    keyed = df.withColumns({"_coarse": F.lit(0) if coarse is None else coarse, "_bucket": bucket})
    keys = [*group, "_coarse", "_bucket"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_m"))
    total = F.sum("_m").over(Window.partitionBy(*group))
    parts = _before(parts, group, "_coarse", "_m", "_above").withColumn(f"{out}_total", total).drop("_m")
    inside = _before(counts, [*group, "_coarse"], "_bucket", "_n", "_inside").drop("_n")
    same = lambda l, r, on: reduce(lambda a, b: a & b, [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in on])
    offsets = inside.alias("i").join(parts.alias("p"), same("i", "p", [*group, "_coarse"]))
    offsets = offsets.select("i.*", (F.col("p._above") + F.col("i._inside")).alias("_offset"), f"p.{out}_total").drop("_inside")
    numbered = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # every row finds its bucket; a left join can't send the rows through the driver in place of the buckets
    joined = numbered.alias("l").join(offsets.alias("r"), same("l", "r", keys), "left").select("l.*", "r._offset", f"r.{out}_total")
    return joined.withColumn(out, F.col("_offset") + F.col("_rn")).drop("_coarse", "_bucket", "_rn", "_offset")


def with_hash_rank(
    df: DataFrame, key: list[str], seed: int = 42, stream: str = "sample", group: list[str] | None = None, out: str = "rank"
) -> DataFrame:
    """Rank in seeded shuffle order, per group or overall; the table is counted once for its buckets."""
    digits = hash_digits(df.count())
    hashed = df.withColumn("_hash", hash_hex(seed, stream, *[F.col(k) for k in key]))
    order = [F.col("_hash"), *[F.col(k) for k in key]]
    part = F.substring("_hash", 1, digits // 2) if digits > 1 else None
    return with_group_rank(hashed, group or [], F.substring("_hash", 1, digits), order, out, part).drop("_hash")


def sample_rows(
    df: DataFrame, n: int, key: list[str], seed: int = 42, stream: str = "sample", group: list[str] | None = None
) -> DataFrame:
    """Exactly ``n`` rows (per group) without replacement, or all when there are fewer."""
    return with_hash_rank(df, key, seed, stream, group).filter(F.col("rank") <= n).drop("rank", "rank_total")


def sample_with_replacement(
    df: DataFrame, n: int, key: list[str], seed: int = 42, stream: str = "draw"
) -> DataFrame:
    """``n`` draws numbered ``draw_id``; each picks a row by hashed rank.

    The draw list is generated inside executors; the join key is the rank, which is
    unique on the row side, so no draw or row can become a hot key.
    """
    ranked = with_hash_rank(df, key, seed, stream)
    total = ranked.agg(F.count(F.lit(1)).alias("_size"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw_id")
    u = hash_uniform(seed, f"{stream}_pick", F.col("draw_id"))
    picks = draws.withColumn("rank", (F.floor(u * total.scalar()) + 1).cast("bigint"))
    return picks.join(ranked, "rank").drop("rank", "rank_total")


def stratified_split(
    df: DataFrame, label: str, key: list[str], train_share: float = 0.8, seed: int = 42
) -> DataFrame:
    """Adds ``is_train``: the first ``train_share`` of each class in seeded order."""
    ranked = with_hash_rank(df, key, seed, "split", [label])
    cut = F.floor(F.col("rank_total") * train_share + 1e-9)
    return ranked.withColumn("is_train", F.col("rank") <= cut).drop("rank", "rank_total")


def with_folds(df: DataFrame, label: str, key: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within each class."""
    ranked = with_hash_rank(df, key, seed, "fold", [label])
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "rank_total")


def numbered_batches(df: DataFrame, date_col: str, key: str, size: int, out: str = "batch_id") -> DataFrame:
    """Fixed-size batches in (date, hash, key) order, numbered from 0.

    Days are cut into slices of a hash, as many as the rows ask for, so one day holding most
    rows is not one task.
    """
    digits = hash_digits(df.count())
    mixed = F.md5(F.col(key).cast("string"))
    ranked = with_group_rank(df, [], F.substring(mixed, 1, digits), [mixed, F.col(key)], coarse=F.col(date_col).cast("string"))
    return ranked.withColumn(out, F.floor((F.col("rank") - 1) / size)).drop("rank", "rank_total")


def shuffle_order(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Globally sorted by a seeded hash: a range-partitioned sort."""
    return df.orderBy(hash_hex(seed, "order", *[F.col(k) for k in key]), *key)


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
