"""Boosted trees on all labelled rows, however many, the same trees that ``boosting`` grows.

A table of up to ``ONE_TASK`` rows is fitted as ``boosting`` fits a sample, each job in a task of its
own. A larger one is sorted by key and cut into blocks of binned rows, which stay in the cluster.
Tasks send histograms of gradients, which are summed for every level of a tree; all jobs share a pass.
Rows are drawn by their place in the order of the keys, from the same random stream as in one task.
Cuts are quantiles of all distinct values, taken by rank from a sorted table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators import boosting
from terrasift.operators.boosting import BINS, MISSING, WIDTH, Settings, Trees
from terrasift.operators.lineage import cut_lineage, shared_folder

ONE_TASK = 200_000  # rows that a single task fits
BLOCK_ROWS = 250_000  # binned rows handled at once
SLICE_ROWS = 32_768  # of these, rows whose gradients are computed together
PART_ROWS = 100_000  # rows of a task's part of the table, about ...
MOST_PARTS = 128  # ... as every part sends histograms to the driver
CHECKPOINT = 25  # rounds between lineage cuts
ASIDE = 0.2  # share of the training rows that chooses the threshold


def fitted_on_all(df: DataFrame, features: list[str], label: str, key: list[str], group: Column, jobs: list[dict]) -> list[dict]:
    """The models of ``jobs``, each fitted on every row with a label outside its held-out group."""
    xs = [f"x_{i}" for i in range(len(features))]
    rows = df.filter(F.col(label).isNotNull()).select(
        *[F.col(k).alias(f"k_{i}") for i, k in enumerate(key)], *[F.col(c).cast("double").alias(x) for x, c in zip(xs, features)],
        F.col(label).cast("double").alias("y_"), group.cast("string").alias("group_"),
    )
    order = [*[f"k_{i}" for i in range(len(key))], *xs, "y_", "group_"]
    n = rows.count()
    if n <= ONE_TASK:
        table = rows.orderBy(*order).select(*xs, "y_", "group_").toPandas()
        whole = boosting.Sample(features, table[xs].to_numpy(np.float64), table["y_"].to_numpy(np.float64), table["group_"].to_numpy(object))
        return boosting.fitted(df.sparkSession, whole, jobs)
    held = F.coalesce(*[F.when(F.col("group_") == g, k) for k, g in enumerate(_groups(jobs))], F.lit(-1))
    parts = min(MOST_PARTS, -(-n // PART_ROWS))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return _Blocks(cut_lineage(placed.select(*xs, "y_", held.alias("held"))), features, jobs).models()


def _groups(jobs: list[dict]) -> list[str]:
    """The groups that jobs hold out; their places stand for them in the table."""
    return list(dict.fromkeys(j["held_out"] for j in jobs if j["held_out"] is not None))


@dataclass
class _Plan:
    """What tasks know of the jobs: (held-out group, tuned, seed) and where each part of the table begins."""

    jobs: list[tuple[int, bool, int]]
    trained: np.ndarray  # (part, job): training rows in the parts before
    own: np.ndarray | None = None  # the same without the rows aside
    cuts: list[list[np.ndarray]] | None = None

    def members(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(features, labels, rows to fit and rows aside of every job) of each batch."""
        at = self.trained[TaskContext.get().partitionId()]
        draws = [_stream(np.random.default_rng(seed).bit_generator.state, int(a)) for (_, _, seed), a in zip(self.jobs, at)]
        for batch in batches:
            *x, y, held = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.stack([np.asarray(c, np.float64) for c in x], axis=1)
            marks = []
            for (group, tuned, _), rng in zip(self.jobs, draws):
                train = held != group
                aside = np.zeros(len(y), bool)
                if tuned:
                    aside[train] = rng.random(int(train.sum())) < ASIDE
                marks.append((train & ~aside, aside))
            yield x, np.asarray(y, np.float64), marks


def _skip(state: dict, n: int) -> dict:
    """State of a bit generator after ``n`` doubles; a kept half of a number stays, as drawing doubles leaves it."""
    g = np.random.PCG64()
    g.state = state
    g.advance(n)
    return g.state | {k: state[k] for k in ("has_uint32", "uinteger")}


def _stream(state: dict, skipped: int) -> np.random.Generator:
    g = np.random.PCG64()
    g.state = _skip(state, skipped)
    return np.random.Generator(g)


def quantile_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank below, share of the way to the next) of the cuts among ``n`` sorted values, as ``np.quantile`` has them."""
    at = np.arange(1, BINS + 1) / (BINS + 1) * (n - 1)
    return np.floor(at).astype(np.int64), at - np.floor(at)


def cuts_at(n: int, value: dict[int, float]) -> np.ndarray:
    """A feature's cuts from its number of distinct values and those at the wanted ranks."""
    if n <= BINS:
        seen = np.array([value[k] for k in range(n)])
    else:
        low, t = quantile_places(n)
        a, b = (np.array([value[int(k)] for k in ks]) for ks in (low, np.minimum(low + 1, n - 1)))
        seen = np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return seen[:-1] if 0 < len(seen) < BINS else seen


def _wanted(n: int) -> np.ndarray:
    if n <= BINS:
        return np.arange(n)
    low, _ = quantile_places(n)
    return np.unique([low, np.minimum(low + 1, n - 1)])


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))


class _Blocks:
    """A sorted table (features, ``y_``, ``held``) and the jobs to fit on it."""

    def __init__(self, table: DataFrame, features: list[str], jobs: list[dict]):
        self.table, self.features, self.jobs = table, features, jobs
        self.settings = [Settings(**j["settings"]) for j in jobs]
        self.spark, self.parts = table.sparkSession, table.rdd.getNumPartitions()

    def _counts(self, plan: _Plan) -> np.ndarray:
        """(part, job, 2): rows to fit, and the positives among them."""
        shared = self.spark.sparkContext.broadcast(plan)

        def run(batches):
            total = np.zeros((len(shared.value.jobs), 2), np.int64)
            for _, y, marks in shared.value.members(batches):
                total += [[own.sum(), (own & (y == 1)).sum()] for own, _ in marks]
            part = TaskContext.get().partitionId()
            yield _batch({"part": pa.int32(), "job": pa.int32(), "n": pa.int64(), "positive": pa.int64()}, [(part, j, int(a), int(b)) for j, (a, b) in enumerate(total)])

        out = np.zeros((self.parts, len(self.jobs), 2), np.int64)
        for r in self.table.mapInArrow(run, "part int, job int, n long, positive long").collect():
            out[r["part"], r["job"]] = r["n"], r["positive"]
        return out

    def _plan(self) -> tuple[_Plan, np.ndarray]:
        before = lambda counts: np.cumsum(counts[:, :, 0], axis=0) - counts[:, :, 0]
        place = {g: k for k, g in enumerate(_groups(self.jobs))}
        jobs = [(place.get(j["held_out"], -2), j["tune"], s.seed) for j, s in zip(self.jobs, self.settings)]
        start = np.zeros((self.parts, len(jobs)), np.int64)
        counts = self._counts(_Plan([(group, False, seed) for group, _, seed in jobs], start))
        plan = _Plan(jobs, before(counts))
        if any(tuned for _, tuned, _ in jobs):
            counts = self._counts(plan)
        plan = replace(plan, own=before(counts))
        return replace(plan, cuts=self._cuts(plan)), counts.sum(axis=0)

    def _cuts(self, plan: _Plan) -> list[list[np.ndarray]]:
        """Cuts of every feature for each job. Distinct values are sorted with a bit for each job whose rows
        have them; counts of the sorted parts say where the wanted ranks lie, and only these are collected."""
        shared = self.spark.sparkContext.broadcast(plan)
        jobs, width = len(self.jobs), len(self.features)

        def values(batches):
            for x, _, marks in shared.value.members(batches):
                bits = sum((own.astype(np.int64) << j for j, (own, _) in enumerate(marks)), np.zeros(len(x), np.int64))
                for f in range(width):
                    held = ~np.isnan(x[:, f]) & (bits > 0)
                    seen, place = np.unique(x[held, f], return_inverse=True)
                    mask = np.zeros(len(seen), np.int64)
                    np.bitwise_or.at(mask, place, bits[held])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), f, np.int32)), pa.array(seen), pa.array(mask)], ["f", "value", "mask"])

        distinct = self.table.mapInArrow(values, "f int, value double, mask long").groupBy("f", "value").agg(F.bit_or("mask").alias("mask"))
        ranked = cut_lineage(distinct.orderBy("f", "value"))

        def here(batch, f):
            """Values of feature ``f`` in a batch, and for each job which of them are its own."""
            mine = batch.column("f").to_numpy() == f
            mask = batch.column("mask").to_numpy()[mine]
            return batch.column("value").to_numpy()[mine], [(mask >> j) & 1 == 1 for j in range(jobs)]

        def count(batches):
            total = np.zeros((width, jobs), np.int64)
            for batch in batches:
                for f in range(width):
                    total[f] += [int(own.sum()) for own in here(batch, f)[1]]
            part = TaskContext.get().partitionId()
            yield _batch({"part": pa.int32(), "f": pa.int32(), "job": pa.int32(), "n": pa.int64()}, [(part, f, j, int(total[f, j])) for f in range(width) for j in range(jobs)])

        before = np.zeros((ranked.rdd.getNumPartitions() + 1, width, jobs), np.int64)
        for r in ranked.mapInArrow(count, "part int, f int, job int, n long").collect():
            before[r["part"] + 1, r["f"], r["job"]] = r["n"]
        before = np.cumsum(before, axis=0)
        total = before[-1]
        wanted = {(f, j): _wanted(int(total[f, j])) for f in range(width) for j in range(jobs)}
        places = self.spark.sparkContext.broadcast((before, wanted))

        def pick(batches):
            starts, ranks = places.value
            seen = starts[TaskContext.get().partitionId()].copy()
            for batch in batches:
                rows = []
                for f in range(width):
                    value, owns = here(batch, f)
                    for j, own in enumerate(owns):
                        mine, first = value[own], int(seen[f, j])
                        k = ranks[f, j]
                        k = k[(k >= first) & (k < first + len(mine))]
                        rows += [(f, j, int(r), float(mine[r - first])) for r in k]
                        seen[f, j] += len(mine)
                yield _batch({"f": pa.int32(), "job": pa.int32(), "rank": pa.int64(), "value": pa.float64()}, rows)

        found: dict[tuple[int, int], dict[int, float]] = {k: {} for k in wanted}
        for r in ranked.mapInArrow(pick, "f int, job int, rank long, value double").collect():
            found[r["f"], r["job"]][r["rank"]] = r["value"]
        return [[cuts_at(int(total[f, j]), found[f, j]) for f in range(width)] for j in range(jobs)]

    def _blocks(self, plan: _Plan, aside: bool) -> RDD:
        """(job, first place, bins by feature, positives, margins) of the rows to fit, or of those aside."""
        shared = self.spark.sparkContext.broadcast(plan)
        most = BLOCK_ROWS

        def run(batches):
            plan = shared.value
            first = [int(a) for a in plan.own[TaskContext.get().partitionId()]]
            kept: list[list[tuple]] = [[] for _ in plan.jobs]

            def block(j):
                bins, y = (np.concatenate([k[i] for k in kept[j]], axis=-1) for i in (0, 1))
                state, kept[j] = (j, first[j], bins, y, np.zeros(len(y))), []
                first[j] += len(y)
                return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state, 5)], pa.binary())], ["state"])

            for x, y, marks in plan.members(batches):
                for j, pair in enumerate(marks):
                    mine = pair[aside]
                    if mine.any():
                        kept[j].append((boosting.binned(x[mine], plan.cuts[j]).T.astype(np.uint8), y[mine] == 1))
                        if sum(len(k[1]) for k in kept[j]) >= most:
                            yield block(j)
            for j in range(len(kept)):
                if kept[j]:
                    yield block(j)

        return self.table.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r[0]))

    def models(self) -> list[dict]:
        plan, counts = self._plan()
        trees = self._boost(self._blocks(plan, False), counts)
        cut = [0.5] * len(self.jobs)
        if any(j["tune"] for j in self.jobs):
            cut = self._thresholds(self._blocks(plan, True), trees)
        return [{"features": self.features, "cuts": c, "trees": t, "threshold": x} for c, t, x in zip(plan.cuts, trees, cut)]

    def _boost(self, blocks: RDD, counts: np.ndarray) -> list[Trees]:
        width, jobs = len(self.features), range(len(self.jobs))
        fits = [_Fit(s, int(n), int(positive), width) for s, (n, positive) in zip(self.settings, counts)]
        shared_folder(self.spark)
        state, before, saved = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, None
        for number in range(max((s.rounds for s in self.settings), default=0)):
            for fit in fits:
                fit.begin(number)
            while any(fit.growing for fit in fits):
                asked = [fit.asked() for fit in fits]
                sums = [0.0 for _ in jobs]
                for j, hist in state.mapPartitions(lambda own, asked=asked: _histograms(own, asked)).collect():
                    sums[j] = sums[j] + hist
                for j in jobs:
                    if fits[j].growing:
                        fits[j].split(sums[j])
                if before is not None:
                    before.unpersist()
                    before = None
            if number % CHECKPOINT == 0 and number and state.getCheckpointFile():
                _delete(self.spark, saved)
                saved = state.getCheckpointFile()
            grown = [fit.end() for fit in fits]
            before, state = state, state.map(lambda b, grown=grown: _moved(b, grown)).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % CHECKPOINT == 0:
                state.checkpoint()
        for rdd in (state, before):
            if rdd is not None:
                rdd.unpersist()
        _delete(self.spark, saved)
        return [fit.trees() for fit in fits]

    def _thresholds(self, aside: RDD, trees: list[Trees]) -> list[float]:
        """The threshold that ``best_threshold`` finds on the rows aside, from counts between thresholds."""
        shared = self.spark.sparkContext.broadcast(trees)
        steps = np.arange(10, 90) / 100

        def passed(own):
            total = np.zeros((len(shared.value), 2, len(steps) + 1), np.int64)
            for j, _, bins, y, _ in own:
                p = 1 / (1 + np.exp(-shared.value[j].margins(bins.T.astype(np.int64))))
                for k, rows in enumerate((y, ~y)):
                    total[j, k] += np.bincount(np.searchsorted(steps, p[rows], side="right"), minlength=len(steps) + 1)
            yield total

        total = sum(aside.mapPartitions(passed).collect())
        out = []
        for j, job in enumerate(self.jobs):
            tp, fp = (np.cumsum(total[j, k][::-1])[::-1][1:] for k in (0, 1))
            f1 = 2 * tp / np.maximum(tp + fp + total[j, 0].sum(), 1)
            out.append(float(steps[f1.argmax()]) if job["tune"] and tp.any() else 0.5)
        return out


class _Fit:
    """One job's trees as they grow on the driver: random stream, tree of the round, level."""

    def __init__(self, s: Settings, rows: int, positive: int, width: int):
        self.s, self.rows, self.width, self.growing = s, rows, width, False
        self.weight = (rows - positive) / positive if positive else 1.0
        self.rng = np.random.default_rng(s.seed)
        self.done: list[tuple] = []
        self.total, self.counts = np.zeros(width), np.zeros(width)

    def begin(self, number: int) -> None:
        self.growing = number < self.s.rounds
        if not self.growing:
            self.tree = None
            return
        self.state = self.rng.bit_generator.state  # tasks draw their rows from here
        self.rng.bit_generator.state = _skip(self.state, self.rows)
        self.columns = np.sort(self.rng.permutation(self.width)[: max(1, int(self.s.columns * self.width))])
        self.tree, self.gains, self.level = boosting.empty_tree(self.s.depth), np.zeros(2 ** (self.s.depth + 1) - 1), 0

    def asked(self) -> tuple | None:
        if self.growing:
            return self.state, self.s.rows, self.weight, self.columns, self.tree, self.level

    def split(self, hist: np.ndarray | float) -> None:
        """Chooses the splits of a level from its summed histograms; the last level takes its values from them."""
        s, first = self.s, 2**self.level - 1
        if np.ndim(hist) == 0:  # no row of this job
            self.growing = False
            return
        at, left_g, left_h = boosting.choose_splits(hist[0], hist[1], self.columns, first, self.tree, self.gains, s)
        total_g, total_h = hist[0][:, 0].sum(axis=1), hist[1][:, 0].sum(axis=1)
        self.level += 1
        if self.level == s.depth:
            for side, (g, h) in enumerate(((left_g, left_h), (total_g[at] - left_g, total_h[at] - left_h))):
                self.tree[3][2 * (first + at) + 1 + side] = boosting.leaf_value(g, h, s)
        self.growing = len(at) > 0 and self.level < s.depth

    def end(self) -> tuple | None:
        if self.tree is None:
            return None
        split = self.tree[0] >= 0
        np.add.at(self.total, self.tree[0][split], self.gains[split])
        np.add.at(self.counts, self.tree[0][split], 1)
        self.done.append(self.tree)
        return self.tree

    def trees(self) -> Trees:
        gain = np.divide(self.total, self.counts, out=np.zeros_like(self.total), where=self.counts > 0)
        return Trees(*(np.array([t[k] for t in self.done]) for k in range(4)), gain)


def _nodes(bins: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
    """Each row's node after so many levels; ``bins`` by feature."""
    feature, cut, missing_left, _ = tree
    flat, every = bins.ravel(), np.arange(bins.shape[1])
    node = np.zeros(bins.shape[1], np.int64)
    # a leaf sends its rows nowhere: both of its children are itself
    own = np.arange(len(feature))
    children = np.where(feature < 0, own, 2 * own + 2)
    # bins of a node that go left: those up to its cut, and missing values where they belong
    goes = np.arange(WIDTH) <= cut[:, None]
    goes[:, MISSING] = missing_left
    goes = (goes & (feature >= 0)[:, None]).astype(np.int64).ravel()
    start = np.maximum(feature, 0) * bins.shape[1]
    for _ in range(levels):
        b = flat[start[node] + every]
        node = children[node] - goes[node * WIDTH + b]
    return node


def _slices(n: int) -> Iterator[slice]:
    return (slice(a, a + SLICE_ROWS) for a in range(0, n, SLICE_ROWS))


def _histograms(blocks: Iterator[tuple], asked: list[tuple | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(job, histograms of gradients and curvatures by node, column and bin) of a task's drawn rows."""
    sums: dict[int, np.ndarray] = {}
    for j, first, all_bins, all_y, all_margins in blocks:
        if asked[j] is None:
            continue
        state, share, weight, columns, tree, level = asked[j]
        size = 2**level * WIDTH
        own = sums.setdefault(j, np.zeros((2, 2**level, len(columns), WIDTH)))
        rng = _stream(state, first)
        for part in _slices(len(all_y)):
            used = np.flatnonzero(rng.random(len(all_y[part])) < share)
            bins, positive = all_bins[:, part].take(used, axis=1), all_y[part][used]
            p = 1.0 / (1.0 + np.exp(-all_margins[part][used]))
            w = np.where(positive, weight, 1.0)
            g = w * (p - positive)
            h = w * p * (1 - p)
            at = _nodes(bins, tree, level) - (2**level - 1)
            here = at >= 0
            if not here.all():
                at, g, h, bins = at[here], g[here], h[here], bins[:, here]
            at *= WIDTH
            for c, f in enumerate(columns):
                index = at + bins[f]
                for k, v in enumerate((g, h)):
                    own[k, :, c] += np.bincount(index, v, size).reshape(-1, WIDTH)
    yield from sums.items()


def _moved(block: tuple, grown: list[tuple | None]) -> tuple:
    """The block with its margins after the trees of a round."""
    j, first, bins, y, margin = block
    if grown[j] is None:
        return block
    levels = int(np.log2(len(grown[j][0]) + 1)) - 1
    steps = [grown[j][3][_nodes(bins[:, part], grown[j], levels)] for part in _slices(len(y))]
    return j, first, bins, y, margin + np.concatenate(steps)


def _delete(spark, path: str | None) -> None:
    """Removes a checkpoint that later ones replace."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
