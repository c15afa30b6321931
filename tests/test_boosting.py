"""Boosted trees against a plain search, and the validations built on them."""

import numpy as np
import pytest

from terrasift.operators import boosting, models
from terrasift.operators.boosting import MISSING, Settings


def plain_tree(bins, g, h, s, level=0):
    """Best split by trying every feature, cut and side for missing values; nested tuples."""
    shrink = lambda x: np.sign(x) * max(abs(x) - s.alpha, 0)
    score = lambda rows: shrink(g[rows].sum()) ** 2 / (h[rows].sum() + s.ridge)
    leaf = -s.rate * shrink(g.sum()) / (h.sum() + s.ridge)
    best = (1e-9, None)
    if level < s.depth:
        for to_left in (False, True):
            for f in range(bins.shape[1]):
                for cut in range(MISSING):
                    b = bins[:, f]
                    left = np.where(b == MISSING, to_left, b <= cut).astype(bool)
                    if h[left].sum() >= s.least and h[~left].sum() >= s.least:
                        gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
    if best[1] is None:
        return np.full(len(g), leaf)
    out, left = np.zeros(len(g)), best[1]
    out[left] = plain_tree(bins[left], g[left], h[left], s, level + 1)
    out[~left] = plain_tree(bins[~left], g[~left], h[~left], s, level + 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_takes_the_best_splits(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    g, h = rng.normal(size=120) * 3, rng.random(120) + 0.2
    s = Settings(depth=3, alpha=0.3, ridge=1.0, least=4.0)
    bins = boosting.binned(x, boosting.cuts_of(x))
    *tree, _, leaf = boosting.grow(bins, g, h, np.arange(120), np.arange(3), s)
    assert np.allclose(tree[3][leaf], plain_tree(bins, g, h, s))
    trees = boosting.Trees(*(t[None] for t in tree), np.zeros(3))
    assert np.allclose(trees.margins(bins), tree[3][leaf])


def learnable(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 - 1 + 0.5 * rng.normal(size=n) > 0).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    return x, y


def test_held_out_accuracy_and_fewer_rounds():
    x, y = learnable(3000)
    cuts = boosting.cuts_of(x[:2000])
    bins = boosting.binned(x, cuts)
    trees = boosting.boost(bins[:2000], y[:2000], Settings())
    margin = trees.margins(bins[2000:])
    assert ((margin > 0) == (y[2000:] > 0)).mean() > 0.8
    assert trees.gain[:2].min() > 3 * trees.gain[2:].max()
    assert boosting.auc_of(margin, y[2000:]) > 0.88 and boosting.auc_of(margin, np.ones(1000)) is None
    fewer = boosting.boost(bins[:2000], y[:2000], Settings(rounds=50))
    assert np.allclose(fewer.margins(bins), trees.margins(bins, 50))


def test_odd_samples():
    for x, y in ((np.full((30, 2), np.nan), np.arange(30) % 2), (np.ones((30, 2)), np.zeros(30)), (np.zeros((1, 2)), np.ones(1))):
        trees = boosting.boost(boosting.binned(x, boosting.cuts_of(x)), y.astype(float), Settings(rounds=3))
        assert np.isfinite(trees.margins(boosting.binned(x, boosting.cuts_of(x)))).all()
    assert boosting.best_threshold(np.array([0.2, 0.6, 0.7]), np.array([0, 1, 1])) == 0.21
    assert boosting.best_threshold(np.array([0.05]), np.array([1])) == 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    x, y = learnable(1200, 3)
    rng = np.random.default_rng(8)
    lat, lon = 42 + 4 * rng.random(1200), -111 + 4 * rng.random(1200)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t), float(a), float(b)) for i, (r, t, a, b) in enumerate(zip(x, y, lat, lon))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, elk_present int, latitude double, longitude double")


FEATURES = ["a", "b", "c", "d"]


def test_validations_test_every_row_once(labelled):
    regions = models.region_validation(labelled, FEATURES, ["id"], rounds=60).collect()
    assert len(regions) == 4 and sum(r["n"] for r in regions) == 1200 and min(r["accuracy"] for r in regions) > 0.75
    folds = models.fold_validation(labelled, FEATURES, ["id"], folds=3, rounds=60, sample=600).collect()
    tested = [r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in folds]
    assert sum(tested) == 1200 and max(tested) - min(tested) <= 2 and min(r["auc"] for r in folds) > 0.85


def test_grid_points_equal_single_validations(labelled):
    grid = {"depth": [2, 3], "rounds": [10, 30], "rate": [0.1], "least": [5.0]}
    found = models.grid_search(labelled, FEATURES, ["id"], grid=grid).collect()
    assert [r["place"] for r in found] == [1, 2, 3, 4] and {r["n"] for r in found} == {1200}
    assert [r["weighted_f1"] for r in found] == sorted((r["weighted_f1"] for r in found), reverse=True)
    for r in found:
        one = models.region_validation(labelled, FEATURES, ["id"], depth=r["depth"], rounds=r["rounds"], rate=0.1, least=5.0)
        assert models.summarise_validation(one).first()["weighted_f1"] == pytest.approx(r["weighted_f1"])


def test_final_model_scores_unseen_rows(spark, labelled):
    model = models.final_model(labelled.filter("id < 900"), FEATURES, ["id"], rounds=80)
    scored = models.classify(labelled.filter("id >= 900"), model)
    m = models.evaluate(scored).first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == 300 and m["accuracy"] > 0.78
    shares = {r["feature"]: r["importance"] for r in models.gain_importance(model, spark).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and min(shares["a"], shares["b"]) > max(shares["c"], shares["d"])
    assert models.classify(labelled.limit(0), model).count() == 0
