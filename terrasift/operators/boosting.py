"""Boosted trees: many fits side by side on a bounded sample, scores on all rows.

Labelled rows are sampled to a documented bound and shared with all tasks once. Every fit, a
set of parameters with one group of rows held out, is a task of its own, so the 81 points of
the parameter grid with all of their held-out regions run at once. Trees grow level by level
on histograms of gradients; a fit of many rounds also yields those of fewer. Scoring reads any
table in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.sampling import sample_rows

SAMPLE = 20_000  # labelled rows that a fit sees at most
BINS = 64  # cuts of a feature at most; missing values have a bin of their own
MISSING = BINS + 1
WIDTH = BINS + 2


@dataclass(frozen=True)
class Settings:
    """The documented settings of the classifier."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    alpha: float = 1.0
    ridge: float = 5.0
    least: float = 10.0
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Ascending cuts of every feature: a value at most as large as a cut lies left of it."""
    out = []
    for column in x.T:
        seen = np.unique(column[~np.isnan(column)])
        if len(seen) > BINS:
            seen = np.unique(np.quantile(seen, np.arange(1, BINS + 1) / (BINS + 1)))
        out.append(seen[:-1] if 0 < len(seen) < BINS else seen)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below every value; missing values last."""
    columns = [np.where(np.isnan(c), MISSING, np.searchsorted(e, c, side="left")) for c, e in zip(x.T, cuts)]
    return np.stack(columns, axis=1).astype(np.int64) if columns else np.zeros((len(x), 0), np.int64)


@dataclass
class Trees:
    """Complete binary trees of ``depth`` levels; a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def margins(self, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        every = np.arange(len(bins))
        levels = int(np.log2(self.feature.shape[1] + 1)) - 1
        for t in range(len(self.feature) if rounds is None else rounds):
            node = np.zeros(len(bins), np.int64)
            for _ in range(levels):
                node = step(node, bins, every, self.feature[t], self.cut[t], self.missing_left[t])
            out += self.value[t][node]
        return out


def step(node, bins, every, feature, cut, missing_left) -> np.ndarray:
    """Each row's child node; rows in a leaf stay."""
    f = feature[node]
    b = bins[every, np.maximum(f, 0)]
    left = np.where(b == MISSING, missing_left[node], b <= cut[node])
    return np.where(f < 0, node, 2 * node + 2 - left)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return -s.rate * _shrunk(g, s.alpha) / (h + s.ridge)


def empty_tree(depth: int) -> tuple[np.ndarray, ...]:
    size = 2 ** (depth + 1) - 1
    return np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)


def choose_splits(
    hist_g: np.ndarray, hist_h: np.ndarray, columns: np.ndarray, first: int, tree: tuple[np.ndarray, ...], gains: np.ndarray, s: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Writes the values and the best splits of a level's nodes into ``tree``; (nodes split, sums of g and of h to their left)."""
    feature, cut, missing_left, value = tree
    score = lambda a, b: _shrunk(a, s.alpha) ** 2 / (b + s.ridge)
    count = len(hist_g)
    total_g, total_h = hist_g[:, 0].sum(axis=1), hist_h[:, 0].sum(axis=1)
    value[first : first + count] = leaf_value(total_g, total_h, s)
    best, best_g, best_h = np.full(count, 0.0), np.zeros(count), np.zeros(count)
    for to_left in (False, True):
        left_g = np.cumsum(hist_g[:, :, :MISSING], axis=2) + (hist_g[:, :, MISSING:] if to_left else 0)
        left_h = np.cumsum(hist_h[:, :, :MISSING], axis=2) + (hist_h[:, :, MISSING:] if to_left else 0)
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[:, None, None]
        gain[(left_h < s.least) | (right_h < s.least)] = 0.0
        top = gain.reshape(count, -1).argmax(axis=1)
        every = np.arange(count)
        found = gain.reshape(count, -1)[every, top]
        better = found > best + 1e-9
        spot = first + np.flatnonzero(better)
        best[better] = found[better]
        best_g[better], best_h[better] = (v.reshape(count, -1)[every, top][better] for v in (left_g, left_h))
        feature[spot], cut[spot] = columns[top[better] // MISSING], top[better] % MISSING
        missing_left[spot], gains[spot] = to_left, found[better]
    at = np.flatnonzero(feature[first : first + count] >= 0)
    return at, best_g[at], best_h[at]


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, columns: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """One tree on the rows ``used`` and the features ``columns``, and each row's leaf."""
    width = len(columns)
    tree = feature, cut, missing_left, value = empty_tree(s.depth)
    gains = np.zeros(len(feature))
    node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    own = bins[np.ix_(used, columns)] + np.arange(width) * WIDTH
    gu, hu = np.repeat(g[used], width), np.repeat(h[used], width)
    for level in range(s.depth + 1):
        first, count = 2**level - 1, 2**level
        at = node[used] - first
        here = at >= 0
        if not here.any():
            break
        if level == s.depth or not width:
            total_g, total_h = (np.bincount(at[here], v[used][here], count) for v in (g, h))
            value[first : first + count] = leaf_value(total_g, total_h, s)
            break
        index = (own + (at * width * WIDTH)[:, None])[here].ravel()
        wide = np.repeat(here, width)
        shape = (count, width, WIDTH)
        hist_g, hist_h = (np.bincount(index, v[wide], count * width * WIDTH).reshape(shape) for v in (gu, hu))
        choose_splits(hist_g, hist_h, columns, first, tree, gains, s)
        node = np.where(node >= first, step(node, bins, every, feature, cut, missing_left), node)
    return feature, cut, missing_left, value, gains, node


def boost(bins: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    """Trees of logistic loss; positives weigh the negative-to-positive ratio."""
    rng = np.random.default_rng(s.seed)
    positives = float((y == 1).sum())
    weight = np.where(y == 1, (len(y) - positives) / positives if positives else 1.0, 1.0)
    margin, trees, total = np.zeros(len(y)), [], np.zeros(bins.shape[1])
    counts = np.zeros(bins.shape[1])
    for _ in range(s.rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        used = np.flatnonzero(rng.random(len(y)) < s.rows)
        columns = np.sort(rng.permutation(bins.shape[1])[: max(1, int(s.columns * bins.shape[1]))])
        *tree, gains, leaf = grow(bins, weight * (p - y), weight * p * (1 - p), used, columns, s)
        split = tree[0] >= 0
        np.add.at(total, tree[0][split], gains[split])
        np.add.at(counts, tree[0][split], 1)
        margin += tree[3][leaf]
        trees.append(tree)
    # average gain of a feature's splits
    gain = np.divide(total, counts, out=np.zeros_like(total), where=counts > 0)
    return Trees(*(np.array([t[k] for t in trees]) for k in range(4)), gain)


def auc_of(p: np.ndarray, y: np.ndarray) -> float | None:
    """Area under the curve by average ranks; none with a single class."""
    _, place, count = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    pos, neg = float((y == 1).sum()), float((y != 1).sum())
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else None


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """First of 0.10, 0.11, ... 0.89 with the largest F1; 0.5 where none has a hit."""
    cuts = np.arange(10, 90) / 100
    tp = np.array([((p >= c) & (y == 1)).sum() for c in cuts])
    named = np.array([(p >= c).sum() for c in cuts])
    f1 = 2 * tp / np.maximum(named + (y == 1).sum(), 1)
    return float(cuts[f1.argmax()]) if tp.any() else 0.5


@dataclass
class Sample:
    """What fits share: features, labels and the group of every sampled row."""

    features: list[str]
    x: np.ndarray
    y: np.ndarray
    group: np.ndarray


def labelled_sample(
    df: DataFrame, features: list[str], label: str, key: list[str], group: Column | None = None, most: int = SAMPLE, seed: int = 42
) -> Sample:
    """At most ``most`` rows with a label, by seeded rank; their group, if given, as text."""
    rows = df.filter(F.col(label).isNotNull()).select(
        *key, *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y_"),
        (group if group is not None else F.lit("")).cast("string").alias("group_"),
    )
    table = sample_rows(rows, most, key, seed, "fit").orderBy(*key).toPandas()
    x = table[[f"x_{i}" for i in range(len(features))]].to_numpy(np.float64)
    return Sample(features, x, table["y_"].to_numpy(np.float64), table["group_"].to_numpy(object))


MODEL = "job long, rounds int, feature array<int>, cut array<int>, missing_left array<boolean>, value array<double>, gain array<double>, nodes int, cuts array<array<double>>, threshold double"
RESULT = "job long, held_out string, rounds int, n_train long, n_positive long, tp long, fp long, fn long, tn long, auc double, threshold double"


def _fit(sample: Sample, job: dict) -> tuple[list[np.ndarray], np.ndarray, Trees, np.ndarray, float]:
    """(cuts, bins of all rows, trees, rows trained on, threshold) of one job."""
    s = Settings(**job["settings"])
    train = np.flatnonzero(sample.group != job["held_out"]) if job["held_out"] is not None else np.arange(len(sample.y))
    own = train
    if job["tune"]:  # a fifth of the training rows chooses the threshold
        aside = np.random.default_rng(s.seed).random(len(train)) < 0.2
        own = train[~aside]
    cuts = cuts_of(sample.x[own])
    bins = binned(sample.x, cuts)
    trees = boost(bins[own], sample.y[own], s)
    threshold = 0.5
    if job["tune"] and aside.any():
        threshold = best_threshold(1 / (1 + np.exp(-trees.margins(bins[train[aside]]))), sample.y[train[aside]])
    return cuts, bins, trees, train, threshold


def _jobs(spark: SparkSession, sample: Sample, jobs: list[dict], schema: str, rows) -> DataFrame:
    """One task a job; ``rows`` makes a job's output rows."""
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield rows(i, shared.value, jobs[i])

    return spark.range(0, len(jobs), 1, max(len(jobs), 1)).mapInArrow(run, schema)


def fitted(spark: SparkSession, sample: Sample, jobs: list[dict]) -> list[dict]:
    """The models of ``jobs``; what reaches the driver is bounded by rounds and depth."""

    def rows(i: int, data: Sample, job: dict) -> pa.RecordBatch:
        cuts, _, trees, _, threshold = _fit(data, job)
        flat = [trees.feature.ravel(), trees.cut.ravel(), trees.missing_left.ravel(), trees.value.ravel(), trees.gain]
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
        columns = [pa.array([i], pa.int64()), pa.array([len(trees.feature)], pa.int32()), *(pa.array([v.tolist()], pa.list_(t)) for v, t in zip(flat, kinds))]
        columns += [pa.array([trees.feature.shape[1]], pa.int32()), pa.array([[c.tolist() for c in cuts]], pa.list_(pa.list_(pa.float64()))), pa.array([threshold])]
        return pa.RecordBatch.from_arrays(columns, ["job", "rounds", "feature", "cut", "missing_left", "value", "gain", "nodes", "cuts", "threshold"])

    out = []
    for r in sorted(_jobs(spark, sample, jobs, MODEL, rows).collect(), key=lambda r: r["job"]):
        shape = (r["rounds"], r["nodes"])
        trees = Trees(*(np.array(r[c]).reshape(shape) for c in ("feature", "cut", "missing_left", "value")), np.array(r["gain"]))
        out.append({"features": sample.features, "cuts": [np.array(c) for c in r["cuts"]], "trees": trees, "threshold": r["threshold"]})
    return out


def held_out_counts(spark: SparkSession, sample: Sample, jobs: list[dict]) -> DataFrame:
    """Confusion counts of each job on the sample rows of its held-out group, for each number of rounds asked for."""

    def rows(i: int, data: Sample, job: dict) -> pa.RecordBatch:
        _, bins, trees, train, threshold = _fit(data, job)
        test = np.flatnonzero(data.group == job["held_out"])
        y, out = data.y[test], []
        for rounds in job["stages"]:
            p = 1 / (1 + np.exp(-trees.margins(bins[test], rounds)))
            hit = p >= threshold
            counts = [int((hit & (y == 1)).sum()), int((hit & (y != 1)).sum()), int((~hit & (y == 1)).sum()), int((~hit & (y != 1)).sum())]
            out.append((i, str(job["held_out"]), rounds, len(train), int((data.y[train] == 1).sum()), *counts, auc_of(p, y), threshold))
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 6, pa.float64(), pa.float64()]
        names = ["job", "held_out", "rounds", "n_train", "n_positive", "tp", "fp", "fn", "tn", "auc", "threshold"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return _jobs(spark, sample, jobs, RESULT, rows)


def job(held_out=None, settings: Settings | None = None, stages: list[int] | None = None, tune: bool = False, **changes) -> dict:
    s = replace(settings or Settings(), **changes)
    return {"held_out": held_out, "settings": asdict(s), "stages": stages or [s.rounds], "tune": tune}


def with_probability(df: DataFrame, models: dict[str | None, dict], group: Column | None = None, out: str = "p_present") -> DataFrame:
    """Adds the probability of each row by the model of its group (``None``: one model for all); null without a model."""
    features = next(iter(models.values()))["features"]
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def probability(names, x):
        values = x.to_numpy(np.float64)
        result = np.full(len(values), np.nan)
        for name, model in shared.value.items():
            mine = np.ones(len(values), bool) if name is None else (names == name).to_numpy()
            if mine.any():
                result[mine] = 1 / (1 + np.exp(-model["trees"].margins(binned(values[mine], model["cuts"]))))
        return type(names)(result)

    name = group.cast("string") if group is not None else F.lit("")
    p = probability(name, F.struct(*[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(features)]))
    return df.withColumn(out, F.when(~F.isnan(p), p))
