"""Boosting against trees grown by hand, one leaf at a time."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from gridwright.models import boosting
from gridwright.models.boosting import BINS, MISSING, Rules
from gridwright.models.common import Problem


def tree_by_hand(x, g, h, rules):
    """Best first, every column, cut and side tried on the rows themselves; returns each row's leaf and the leaves' rows."""
    weight = h if rules.by_hessian else np.ones(len(g))

    def best(rows):
        found = None
        score = lambda r: g[r].sum() ** 2 / weight[r].sum()
        for j in range(x.shape[1]):
            v = x[rows, j]
            gaps = np.isnan(v)
            for at in np.unique(x[~np.isnan(x[:, j]), j]):
                for side in (False, True):
                    left = np.where(gaps, side, v <= at)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < max(1, rules.least_rows) or min(h[a].sum(), h[b].sum()) < rules.least_hessian:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = gain, a, b
        return found

    leaves = [(0, np.arange(len(g)))]
    while len(leaves) < rules.leaves:
        options = [(i, best(rows)) for i, (depth, rows) in enumerate(leaves) if rules.depth is None or depth < rules.depth]
        options = [(i, b) for i, b in options if b]
        if not options:
            break
        i, (_, a, b) = max(options, key=lambda o: o[1][0])
        depth = leaves.pop(i)[0] + 1
        leaves += [(depth, a), (depth, b)]
    return [rows for _, rows in leaves]


def rows_of(rng, n=300, gaps=True):
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 2] = rng.integers(0, 5, n)
    if gaps:
        x[rng.random(x.shape) < 0.15] = np.nan
    signal = np.nan_to_num(x[:, 0]) + (np.nan_to_num(x[:, 2], nan=9.0) > 3) * 2
    return x, signal


def frame(spark, x, y):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, label double").repartition(3)


def predicted(model, df, column):
    rows = model.transform(df).collect()
    key = lambda r: tuple(-99.0 if v is None else v for v in (r["a"], r["b"], r["c"]))
    return {(key(r), r["label"]): r[column] for r in rows}


def keys(x, y):
    return [(tuple(-99.0 if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)]


@pytest.mark.parametrize("kind", ["squared", "logistic", "softmax"])
@pytest.mark.parametrize("style", ["hist", "levels"])
def test_three_rounds_equal_trees_by_hand(spark, monkeypatch, kind, style):
    monkeypatch.setattr(boosting, "RENEWED", 2)
    x, signal = rows_of(np.random.default_rng(4))
    y = signal if kind == "squared" else (signal > 1).astype(float) + (signal > 2.2) * (kind == "softmax")
    df = frame(spark, x, y)
    classes = {"squared": 0, "logistic": 2, "softmax": 3}[kind]
    problem = Problem(["a", "b", "c"], "classification" if classes else "regression", classes)
    if style == "hist":
        rules = Rules(leaves=6, least_rows=10)
        model = boosting.histogram_boosting(df, problem, {"max_leaf_nodes": 6, "min_samples_leaf": 10, "max_iter": 3, "learning_rate": 0.3})
    else:
        rules = Rules(leaves=4, depth=2, least_rows=1, least_hessian=0.0, by_hessian=False)
        model = boosting.gradient_boosting(df, problem, {"max_depth": 2, "n_estimators": 3, "learning_rate": 0.3})
    width = max(1, classes if classes > 2 else 1)
    share = np.array([(y == k).mean() for k in range(classes)])
    base = {"squared": [y.mean()], "logistic": [np.log(share[1] / share[0])] if classes == 2 else 0, "softmax": np.log(share) if classes else 0}[kind]
    m = np.tile(np.asarray(base, dtype=float), (len(y), 1))
    scale = (classes - 1) / classes if style == "levels" and classes > 2 else 1.0
    for _ in range(3):
        if kind == "squared":
            g, h = m - y[:, None], np.ones_like(m)
        else:
            p = 1 / (1 + np.exp(-m)) if classes == 2 else np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == (np.arange(3) if classes > 2 else 1)), p * (1 - p)
        step = np.zeros_like(m)
        for k in range(width):
            for rows in tree_by_hand(x, g[:, k], h[:, k], rules):
                step[rows, k] = -0.3 * scale * g[rows, k].sum() / h[rows, k].sum()
        m = m + step
    if kind == "squared":
        want = m[:, 0].tolist()
    else:
        p = 1 / (1 + np.exp(-m)) if classes == 2 else np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        want = (np.column_stack([1 - p, p]) if classes == 2 else p).tolist()
    got = predicted(model, df, "probability" if classes else "prediction")
    np.testing.assert_allclose([got[k] for k in keys(x, y)], want, rtol=1e-7, atol=1e-9)


def test_few_passes_for_a_tree_of_many_leaves(spark, monkeypatch):
    x, y = rows_of(np.random.default_rng(1), 600, gaps=False)
    y = y + np.sin(3 * x[:, 1]) + x[:, 1] * x[:, 0]
    passes = []
    add_up = boosting.Booster.add_up
    monkeypatch.setattr(boosting.Booster, "add_up", lambda self, *a: passes.append(len(a[1])) or add_up(self, *a))
    model = boosting.histogram_boosting(frame(spark, x, y), Problem(["a", "b", "c"], "regression", 0), {"max_iter": 1, "min_samples_leaf": 2})
    tree = model.state["trees"][0]
    assert sum(f < 0 for f in tree["feature"]) == 31 and len(passes) < 15
    assert sum(passes) < 60  # one of two siblings each


def test_many_values_become_quantile_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v), float(v % 7), None) for v in rng.permutation(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    edges = boosting.bin_edges(df, ["a", "b", "c"])
    assert 200 <= len(edges[0]) <= BINS and edges[1].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(edges[2]) == 0
    sizes = np.bincount(np.searchsorted(edges[0], np.arange(5000.0)))
    assert sizes.max() < 3 * 5000 / BINS


def test_ends_when_the_validation_part_gains_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (800, 3)).astype(float)
    df = frame(spark, x, rng.normal(size=800))
    model = boosting.histogram_boosting(df, Problem(["a", "b", "c"], "regression", 0), {
        "max_iter": 60, "early_stopping": True, "n_iter_no_change": 3, "learning_rate": 0.5})
    assert len(model.state["trees"]) < 30
    assert len(boosting.histogram_boosting(df, Problem(["a"], "regression", 0), {"max_iter": 4}).state["trees"]) == 4


def test_saved_and_read_back_and_odd_columns(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 9), 1.0 if i % 2 else None, None, float(i % 3)) for i in range(90)], "a double, b double, c double, label double")
    model = boosting.gradient_boosting(df, Problem(["a", "b", "c"], "classification", 3), {"n_estimators": 5, "learning_rate": 0.5})
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    want, got = (predicted(m, df, "prediction") for m in (model, again))
    assert want == got and all(k[1] == v for k, v in got.items())  # a tells the class
    assert MISSING == BINS


@pytest.mark.parametrize("classes", [0, 2])
def test_rows_of_the_same_bins_are_one_cell(spark, classes):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (2000, 3)).astype(float)
    y = x.sum(axis=1) + rng.normal(size=2000) if not classes else (x.sum(axis=1) + rng.normal(size=2000) > 4).astype(float)
    df, names = frame(spark, x, y), ["a", "b", "c"]
    edges = boosting.bin_edges(df, names)
    rows = boosting.combined(boosting.binned(df, names, "label", edges, 0.3, 42), classes)
    base = np.zeros(1)
    cells = [c for batch in boosting.blocks(rows, 3, base).toArrow().to_batches() for c in boosting._arrays(batch, 3)]
    codes, label, n, ss, held, m = (np.concatenate([c[i] for c in cells]) for i in range(6))
    assert len(codes) <= 64 * 2 * max(1, classes) and n.sum() == 2000 and 0.2 < n[held].sum() / 2000 < 0.4 and m.shape == (len(codes), 1)
    assert (n * label).sum() == pytest.approx(y.sum()) and (n * label ** 2 + ss).sum() == pytest.approx((y * y).sum())
    assert codes.max() == 3 and (n * codes[:, 0]).sum() == x[:, 0].sum()


def test_blocks_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 50)
    x, y = rows_of(np.random.default_rng(8))
    df, names = frame(spark, x, y), ["a", "b", "c"]
    rows = boosting.combined(boosting.binned(df, names, "label", boosting.bin_edges(df, names), 0.0, 42), 0)
    sizes = [len(c[1]) for batch in boosting.blocks(rows, 3, np.zeros(1)).toArrow().to_batches() for c in boosting._arrays(batch, 3)]
    assert max(sizes) <= 50 and sum(sizes) == rows.count()
