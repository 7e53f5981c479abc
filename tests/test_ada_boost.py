"""Boosting by re-weighting on blocks of cells."""

import numpy as np
import pytest

from gridwright.models import trees
from gridwright.models.common import Blocks, Problem


def test_boosting_of_classes_works_on_cells(spark, monkeypatch):
    """Rows of the same bins and class are one row that weighs as many, and the trees are the same."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (3000, 2)).astype(float)
    y = ((x.sum(axis=1) + rng.integers(0, 4, 3000)) > 6).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double")
    seen = []
    plain = Blocks.sum
    monkeypatch.setattr(Blocks, "sum", lambda self, size, fn, **more: seen.append(
        plain(self, 2, lambda z: np.array([len(z), np.exp(z[:, -1]).sum()]))) or plain(self, size, fn, **more))
    model = trees.ada_boost(df, Problem(["a", "b"], "classification"), {"n_estimators": 3})
    assert seen[0][0] == len(np.unique(np.column_stack([x, y]), axis=0)) < 80 and seen[0][1] == pytest.approx(3000)
    weight, first = np.ones(3000), model.state["trees"]
    for rules, alpha in zip(first, model.state["weights"]):
        best = min(  # the rule with the least Gini impurity
            ((sum(2 * s[0] * s[1] / s.sum() for s in (np.bincount(y[m].astype(int), weight[m], 2) for m in (x[:, j] <= c, x[:, j] > c))), j, c)
             for j in range(2) for c in range(5)))
        assert (rules["feature"], rules["at"]) == best[1:]
        side = x[:, best[1]] <= best[2]
        guess = np.where(side, rules["left"]["value"], rules["right"]["value"])
        error = weight[guess != y].sum() / weight.sum()
        assert alpha == pytest.approx(np.log((1 - error) / error))
        weight = weight * np.exp(alpha * (guess != y))


def test_boosting_of_numbers_works_on_cells(spark, monkeypatch):
    """Trees are walked once a cell; weights and losses are those of the rows, also after they were written anew."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (4000, 2)).astype(float)
    y = np.round(x[:, 0] * x[:, 1] + rng.normal(0, 1, 4000), 4)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double").repartition(3)
    monkeypatch.setattr(trees, "RENEWED", 2)
    cells = []
    plain = trees.Cells.sum
    monkeypatch.setattr(trees.Cells, "sum", lambda self, size, fn, **more: cells.append(
        plain(self, 2, lambda z: np.array([len(z[1]), z[1].sum()]))) or plain(self, size, fn, **more))
    model = trees.ada_boost(df, Problem(["a", "b"], "regression", 0), {"n_estimators": 5, "learning_rate": 0.5})
    assert all(c.tolist() == [36, 4000] for c in cells) and len(cells) == 20

    def value(rules, row):
        while "value" not in rules:
            rules = rules["left" if row[rules["feature"]] <= rules["at"] else "right"]
        return rules["value"]

    def depth(rules):
        return 0 if "value" in rules else 1 + max(depth(rules["left"]), depth(rules["right"]))

    def drop(weight, rows, j, cut):
        def squares(m):
            return (weight[m] * (y[m] - np.average(y[m], weights=weight[m])) ** 2).sum()
        left = rows & (x[:, j] <= cut)
        return squares(rows) - squares(left) - squares(rows & ~left)

    weight = np.ones(4000)
    for rules, alpha in zip(model.state["trees"], model.state["weights"]):
        assert depth(rules) == 3
        every = np.ones(4000, dtype=bool)
        assert drop(weight, every, rules["feature"], rules["at"]) == pytest.approx(max(drop(weight, every, j, c) for j in range(2) for c in range(5)))
        guess = np.array([value(rules, r) for r in x])
        for g in np.unique(guess):
            assert g == pytest.approx(np.average(y[guess == g], weights=weight[guess == g]))
        gap = np.abs(y - guess)
        error = (weight * gap).sum() / weight.sum() / gap.max()
        assert alpha == pytest.approx(0.5 * np.log((1 - error) / error))
        weight = weight * np.exp(-alpha * (1 - gap / gap.max()))


def test_numbers_are_the_weighted_median(spark):
    rules = [{"feature": 0, "at": float(i), "left": {"value": float(i % 3)}, "right": {"value": 5.0 + i}} for i in range(5)]
    model = trees.BoostedRules({"features": ["a"], "trees": rules, "weights": [1.0, 2.0, 0.5, 1.0, 0.5], "n_classes": 0})
    df = spark.createDataFrame([(float(v),) if v >= 0 else (None,) for v in range(-1, 7)], "a double")
    for row in model.transform(df).collect():
        votes = sorted((r["left"]["value"] if row["a"] is not None and row["a"] <= r["at"] else r["right"]["value"], w) for r, w in zip(rules, model.state["weights"]))
        reached = np.cumsum([w for _, w in votes])
        assert row["prediction"] == votes[int((reached >= 2.5).argmax())][0]
