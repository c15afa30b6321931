"""Exact ranks and percentiles without putting a column into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and an
unpartitioned window sorts the table in one task. Quantiles are selected by closing brackets
around them; only values inside are ranked. Where every value needs its rank, the value axis
is cut into buckets at approximate quantiles, as many as the rows ask for, counts per bucket
are prefix-summed, and exact ranks are formed inside buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERYTHING = (-math.inf, math.inf)
SKETCH = 10_000  # a sketch's rank error is one in so many
INSIDE = 1_000_000  # values between two bounds that are ranked in one task
BUCKET_ROWS = 1_000_000  # rows of a bucket, about
MOST_BUCKETS = 10_000


def value_counts_long(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value, n): one shuffle of pre-aggregated distinct values."""
    by = by or []
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = df.select(*by, pairs.alias("kv")).select(*by, "kv.column", "kv.value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def bucket_count(rows: int) -> int:
    """Buckets that hold ``BUCKET_ROWS`` rows each, 8 at least."""
    return min(MOST_BUCKETS, max(8, -(-rows // BUCKET_ROWS)))


def bucket_edges(df: DataFrame, columns: list[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate quantile edges of every column, one less than buckets (default: as the rows ask for)."""
    names = dict(enumerate(columns))
    buckets = buckets or bucket_count(df.count())
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, max(1000, 4 * buckets)).alias(f"c{i}") for i, c in names.items()]).first()
    return {c: sorted(set(row[f"c{i}"] or [])) for i, c in names.items()}


def bucket_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open interval a value falls in, as a balanced comparison tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= edges[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges)) if edges else F.lit(0)


def with_cumulative(
    counts: DataFrame, edges: dict[str, list[float]], by: list[str], n_columns: list[str]
) -> DataFrame:
    """Adds ``<n>_before`` (rows with a smaller value) and ``<n>_total`` per (by, column)."""
    key = [*by, "column"]
    cut = {c: e for c, e in edges.items() if e}
    bucket = F.lit(0)
    if cut:
        table = F.create_map(*[x for c, e in cut.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in e]))])
        mine = F.try_element_at(table, F.col("column"))
        bucket = F.when(mine.isNull(), 0).otherwise(F.size(F.filter(mine, lambda e: e < F.col("value"))))
    counts = counts.withColumn("bucket", bucket)
    totals = counts.groupBy(*key, "bucket").agg(*[F.sum(n).alias(f"{n}_b") for n in n_columns])
    order = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    totals = totals.select(
        *key,
        "bucket",
        *[F.coalesce(F.sum(f"{n}_b").over(order), F.lit(0)).alias(f"{n}_offset") for n in n_columns],
        *[F.sum(f"{n}_b").over(whole).alias(f"{n}_total") for n in n_columns],
    )
    inside = Window.partitionBy(*key, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_inside") for n in n_columns]
    ).join(totals, [*key, "bucket"])
    return out.withColumns(
        {f"{n}_before": F.col(f"{n}_offset") + F.col(f"{n}_inside") for n in n_columns}
    ).drop(*[f"{n}_{s}" for n in n_columns for s in ("offset", "inside")], "bucket")


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


class _Brackets:
    """Bounds around every wanted quantile, a row for each group; ``low`` and ``high`` are columns."""

    def __init__(self, df: DataFrame, by: list[str], size: int, probs: list[float]):
        self.df, self.by, self.size, self.probs = df, by, size, probs
        self.rows: dict[tuple, dict] = {}

    def beside(self) -> tuple[DataFrame, Callable[[int, int], tuple[Column, Column]]]:
        """The values with the bounds of their group, and a function that gives them as columns."""
        if not self.by:
            own = self.rows.get((), {})
            return self.df, lambda i, j: tuple(F.lit(float(x)) for x in own.get((i, j), (1.0, 0.0))[:2])
        places = [(i, j) for i in range(self.size) for j in range(len(self.probs))]
        keys = [self.df.schema[c] for c in self.by]
        bounds = [T.StructField(f"_{e}{i}_{j}", T.DoubleType()) for i, j in places for e in "lh"]
        rows = [(*g, *[float(x) for at in places for x in row.get(at, (1.0, 0.0))[:2]]) for g, row in self.rows.items()]
        table = self.df.sparkSession.createDataFrame(rows, T.StructType([*keys, *bounds]))
        same = reduce(lambda a, b: a & b, [self.df[c].eqNullSafe(table[c]) for c in self.by])
        beside = self.df.join(table, same).select(self.df["*"], *[table[f.name] for f in bounds])
        return beside, lambda i, j: (F.col(f"_l{i}_{j}"), F.col(f"_h{i}_{j}"))

    def collect(self, df: DataFrame, aggregates: list[Column]) -> dict[tuple, Row]:
        return {tuple(r[c] for c in self.by): r for r in df.groupBy(*self.by).agg(*aggregates).collect()}


def _around(place: float, n: int) -> tuple[float, float]:
    """Shares of n values that enclose a place among them, and the next, beyond the sketch's error."""
    return max(0.0, place / n - 4.0 / SKETCH), min(1.0, (place + 2) / n + 4.0 / SKETCH)


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None, most: int = INSIDE
) -> DataFrame:
    """(by..., column, prob, value) with linear interpolation between order statistics.

    Selection by brackets: a sketch of all columns in one scan bounds every quantile, exact
    counts tell what lies below and between the bounds, and only values between them are ranked.
    Where more than ``most`` rows remain, the bounds close in by another sketch of what lies
    between them. Groups, columns and probabilities bound what reaches the driver.
    """
    by = by or []
    values = df.select(*by, *[_clean(c).alias(f"v{i}") for i, c in enumerate(columns)])
    brackets = _Brackets(values, by, len(columns), probs)
    places = [(i, j) for i in range(len(columns)) for j in range(len(probs))]
    sides = {p: (max(0.0, p - 4.0 / SKETCH), min(1.0, p + 4.0 / SKETCH)) for p in probs}
    shares = sorted({x for side in sides.values() for x in side})
    first = brackets.collect(
        values,
        [F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]
        + [F.percentile_approx(F.col(f"v{i}"), shares, SKETCH).alias(f"s{i}") for i in range(len(columns))],
    )
    for group, r in first.items():
        # as few values as a sketch holds lie between any bounds
        ends = {(i, j): [r[f"s{i}"][shares.index(x)] for x in sides[probs[j]]] if r[f"n{i}"] > SKETCH else EVERYTHING for i, j in places if r[f"n{i}"]}
        brackets.rows[group] = {(i, j): (*e, r[f"n{i}"]) for (i, j), e in ends.items()}
    open_, counts, final = set(places), {}, set()
    while open_:
        beside, ends = brackets.beside()
        wanted = []
        for i, j in sorted(open_):
            (low, high), v = ends(i, j), F.col(f"v{i}")
            wanted += [F.count(F.when(v < low, 1)).alias(f"b{i}_{j}"), F.count(F.when((v >= low) & (v <= high), 1)).alias(f"m{i}_{j}")]
        for group, r in brackets.collect(beside, wanted).items():
            for i, j in open_ & brackets.rows[group].keys():
                counts[group, i, j] = r[f"b{i}_{j}"], r[f"m{i}_{j}"]
        missed = set()
        for (g, i, j), (below, m) in counts.items():
            low, high, n = brackets.rows[g][i, j]
            place = probs[j] * (n - 1)
            if not below <= math.floor(place) or not math.ceil(place) < below + m:
                brackets.rows[g][i, j] = (*EVERYTHING, n)  # a sketch went astray: take all
                missed.add((i, j))
        final |= missed
        open_ = missed or {(i, j) for (g, i, j), (_, m) in counts.items() if m > most and brackets.rows[g][i, j][0] < brackets.rows[g][i, j][1]} - final
        if missed or not open_:
            continue
        # close in on the wanted places among the values inside
        inner = {}
        for g, i, j in counts:
            if (i, j) in open_ and (i, j) in brackets.rows[g]:
                below, m = counts[g, i, j]
                n = brackets.rows[g][i, j][2]
                inner[g, i, j] = _around(math.floor(probs[j] * (n - 1)) - below, m)
        sketches = []
        grid = {at_: sorted({x for (g, i, j), e in inner.items() if (i, j) == at_ for x in e}) for at_ in open_}
        for i, j in sorted(open_):
            (low, high), v = ends(i, j), F.col(f"v{i}")
            sketches.append(F.percentile_approx(F.when((v >= low) & (v <= high), v), grid[i, j], SKETCH).alias(f"s{i}_{j}"))
        moved = set()
        for group, r in brackets.collect(beside, sketches).items():
            for i, j in open_ & brackets.rows[group].keys():
                low, high, n = brackets.rows[group][i, j]
                new = tuple(r[f"s{i}_{j}"][grid[i, j].index(x)] for x in inner[group, i, j])
                brackets.rows[group][i, j] = (*new, n)
                if new != (low, high):
                    moved.add((i, j))
        open_ &= moved
    beside, ends = brackets.beside()
    between = []
    for i, j in places:
        (low, high), v = ends(i, j), F.col(f"v{i}")
        between.append(F.when((v >= low) & (v <= high), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))))
    few = beside.select(*by, F.explode(F.filter(F.array(*between), lambda s: s.isNotNull())).alias("s"))
    few = few.groupBy(*by, "s.i", "s.j", F.col("s.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    key = [*by, "i", "j"]
    ranked = few.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("v")))
    fields = [*[values.schema[c] for c in by], *[T.StructField(n, T.IntegerType()) for n in "ij"]]
    fields += [T.StructField("below", T.LongType()), T.StructField("total", T.LongType())]
    rows = [(*g, i, j, b, brackets.rows[g][i, j][2]) for (g, i, j), (b, _) in counts.items()]
    known = df.sparkSession.createDataFrame(rows, T.StructType(fields))
    same = reduce(lambda a, b: a & b, [ranked[c].eqNullSafe(known[c]) for c in key])
    joined = ranked.join(known, same).select(*[ranked[c] for c in key], "v", "n", "upto", "below", "total")
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1)
    place = prob * (F.col("total") - 1)
    before = F.col("below") + F.col("upto") - F.col("n")
    hit = lambda r: (before <= r) & (r < F.col("below") + F.col("upto"))
    low, high = F.max(F.when(hit(F.floor(place)), F.col("v"))), F.max(F.when(hit(F.ceil(place)), F.col("v")))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    found = joined.groupBy(*by, name.alias("column"), prob.alias("prob")).agg(low.alias("a"), high.alias("b"), F.max(place - F.floor(place)).alias("rest"))
    return found.select(*by, "column", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("rest")).alias("value"))


def average_ranks(df: DataFrame, column: str, weights: dict[str, Column]) -> DataFrame:
    """One row per distinct value with counts, counts before it, and its average rank.

    ``weights`` adds conditional counts, e.g. ``{"pos": (label == 1).cast("int")}``.
    """
    edges = bucket_edges(df, [column])
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.lit(column).alias("column"), F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(k) for k, w in weights.items()])
    )
    ranked = with_cumulative(counts, edges, [], ["n", *weights])
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
