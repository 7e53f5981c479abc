"""Trees of any depth against trees grown by hand, with every size limit forced low."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from gridwright.models import grower
from gridwright.models.common import Problem


def impurity(y, classes):
    if classes:
        return len(y) - sum((y == k).sum() ** 2 for k in range(classes)) / max(1, len(y))
    return ((y - y.mean()) ** 2).sum() if len(y) else 0.0


def by_hand(x, y, classes, depth, least, rows=None, at=0):
    """The leaf (a list of rows) of every row: all columns and values tried, the first best taken."""
    rows = np.arange(len(y)) if rows is None else rows
    whole = impurity(y[rows], classes)
    best = None
    if at != depth and len(rows) >= least and whole > 1e-9:
        for j in range(x.shape[1]):
            for v in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= v
                gain = whole - impurity(y[rows[left]], classes) - impurity(y[rows[~left]], classes)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-7)):
                    best = gain, left
    if best is None:
        return [rows]
    return by_hand(x, y, classes, depth, least, rows[best[1]], at + 1) + by_hand(x, y, classes, depth, least, rows[~best[1]], at + 1)


def table(spark, classes, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 9, n), rng.integers(0, 100, n)]).astype(float)
    signal = np.sin(x[:, 0] / 5) + (x[:, 1] > 4) + rng.normal(0, 0.3, n)
    y = np.digitize(signal, [0.0, 1.0])[:n].astype(float) if classes else np.round(signal, 3)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, a double, b double, c double, label double")
    return df.repartition(3), x, y, Problem(["a", "b", "c"], "classification" if classes else "regression", classes)


@pytest.fixture(params=["one task", "levels first", "a table"])
def way(request, monkeypatch):
    if request.param != "one task":
        monkeypatch.setattr(grower, "TASK_ROWS", 60)
    if request.param == "a table":
        monkeypatch.setattr(grower, "SMALL_NODES", 0)
    return request.param


@pytest.mark.parametrize("classes, depth, least", [(3, None, 2), (3, 3, 12), (0, 4, 2), (0, None, 30)])
def test_trees_equal_those_grown_by_hand(spark, way, classes, depth, least):
    df, x, y, problem = table(spark, classes)
    model = grower.decision_tree(df, problem, {"max_depth": depth, "min_samples_split": least})
    assert type(model).__name__ == ("TableForest" if way == "a table" else "ArrayForest")
    got = {r["i"]: r for r in model.transform(df).collect()}
    for leaf in by_hand(x, y, classes, depth, least):
        for i in leaf:
            if classes:
                np.testing.assert_allclose(got[i]["probability"], [(y[leaf] == k).mean() for k in range(classes)], atol=1e-9)
            else:
                assert got[i]["prediction"] == pytest.approx(y[leaf].mean())


@pytest.mark.parametrize("kind", [grower.random_forest, grower.extra_trees])
def test_forests_learn_and_runs_agree(spark, way, kind):
    df, x, y, problem = table(spark, 3)
    params = {"n_estimators": 12, "max_depth": None}
    one, two = (kind(df, problem, params).transform(df).orderBy("i").toPandas() for _ in range(2))
    assert (np.stack(one["probability"]) == np.stack(two["probability"])).all()
    assert (one["prediction"] == y).mean() > 0.95  # seen rows
    new, _, wanted, _ = table(spark, 3, seed=1)
    assert kind(df, problem, params).transform(new).filter("prediction = label").count() > 0.6 * len(wanted)  # a quarter of the labels is noise


def test_rows_are_drawn_with_mean_one():
    counts = np.stack([grower.drawn(np.arange(20_000), t, 5) for t in range(4)])
    assert abs(counts.mean() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(counts)[0, 1]) < 0.03


def test_saved_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grower, "SMALL_NODES", 0)
    monkeypatch.setattr(grower, "TASK_ROWS", 60)
    df, _, _, problem = table(spark, 0)
    model = grower.random_forest(df, problem, {"n_estimators": 3})
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "f"))
    again = PipelineModel.load(str(tmp_path / "f"))
    one, two = (m.transform(df).orderBy("i").toPandas()["prediction"] for m in (model, again))
    np.testing.assert_allclose(one, two)
    assert sum(model.state["importances"]) == pytest.approx(1.0)


def test_missing_values_and_one_class(spark, way):
    rows = [(i, float(i % 5) if i % 3 else None, 1.0 if i % 3 else 0.0, None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a double, label double, b double")
    problem = Problem(["a", "b"], "classification", 2)
    assert grower.decision_tree(df, problem, {}).transform(df).filter("prediction = label").count() == 200
    flat = grower.decision_tree(df.filter("label = 1"), problem, {}).transform(df)
    assert flat.filter("prediction = 1").count() == 200


def test_leaves_are_not_dealt_and_sums_stay_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(grower, "TASK_ROWS", 60)
    df, x, y, problem = table(spark, 0)
    held, sent = [], []
    upper_levels = grower._upper_levels
    to_arrow = type(df).toArrow
    monkeypatch.setattr(grower, "_upper_levels", lambda *a: held.extend(upper_levels(*a)) or held)
    monkeypatch.setattr(type(df), "toArrow", lambda self: (lambda t: sent.append(t.nbytes) or t)(to_arrow(self)))
    model = grower.random_forest(df, problem, {"n_estimators": 8, "max_depth": 3})
    for upper in held:
        deep = grower._depths(upper.tree)
        assert all(deep[node] < 3 for node in upper.root) and max(deep) == 3
    assert sent and max(sent) < 8 * 2 ** 3 * 200  # a short row a node, no sums of bins
    scored = model.transform(df).toPandas().sort_values("i")
    assert np.corrcoef(scored["prediction"], y)[0, 1] > 0.8
