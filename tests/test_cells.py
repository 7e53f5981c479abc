"""Rows stored by cell, and forests and boosting on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.models import common, grower
from gridwright.models.common import Cells, Problem, read_cells


def rows_of(cells):
    parts = [part for b in cells.data.toArrow().to_batches() for part in read_cells(b, cells.columns, cells.kept)]
    return np.concatenate([np.repeat(c, n, axis=1) for c, n, _ in parts], axis=1), np.concatenate([v for _, _, v in parts], axis=1), sum(len(n) for _, n, _ in parts)


@pytest.mark.parametrize("few", [False, True])
def test_cells_hold_every_row(spark, monkeypatch, few):
    """Also where a task takes few rows at once and a cell comes in pieces."""
    if few:
        monkeypatch.setattr(common, "GATHERED_ROWS", 100)
        monkeypatch.setattr(common, "CELL_ROWS", 30)
        monkeypatch.setattr(common, "LEAST_ROWS", 500)
    i = F.col("id")
    df = spark.range(20_000).select(
        F.when(i % 10 != 0, (i % 3).cast("double")).alias("a"), F.when(i % 4 != 0, 1.0).otherwise((i % 5).cast("double")).alias("b"), i.cast("double").alias("y"), i).repartition(3)
    edges = [np.array([0.5, 1.5]), np.array([0.0, 1.0, 2.0, 3.0])]
    cells = Cells(df, ["a", "b"], edges, ["a", "b", "y", "id"], 20_000, missing=True)
    codes, values, n = rows_of(cells)
    order = np.argsort(values[3].view(np.int64))
    got, ids = values[:, order], values[3].view(np.int64)[order]
    assert (ids == np.arange(20_000)).all() and (got[2] == ids).all()
    a, b = np.where(ids % 10 == 0, 3, ids % 3), np.where(ids % 4 == 0, ids % 5, 1)
    assert (codes[0][order] == a).all() and (codes[1][order] == b).all() and np.isnan(got[0]).sum() == 2000
    wanted = len(np.unique(np.stack([a, b]), axis=1).T)
    assert n == wanted if not few else wanted < n < 2000
    assert cells.data.count() < (2000 if few else 20)  # blocks, not rows
    assert cells.sum(2, lambda z: np.array([z[1].sum(), z[2][2].sum()])).tolist() == [20_000, 19_999 * 10_000]
    twice = cells.renewed(lambda codes, n, v: 2 * v[2])
    assert twice.sum(1, lambda z: np.array([z[2][0].sum()]))[0] == 19_999 * 20_000


def many(spark, classes):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 6000), rng.integers(0, 5, 6000)]).astype(float)
    y = np.round(x[:, 0] * (1 + x[:, 1] / 9) + rng.normal(0, 0.3, 6000), 3)
    y = np.digitize(y, [3.0, 7.0]).astype(float) if classes else y
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double").repartition(3)
    return df, Problem(["a", "b"], "classification" if classes else "regression", classes)


@pytest.mark.parametrize("kind", [grower.random_forest, grower.extra_trees])
@pytest.mark.parametrize("classes", [0, 3])
def test_large_nodes_are_split_on_cells(spark, monkeypatch, kind, classes):
    """A pass reads 45 cells instead of 6,000 rows; sums that are not stored give the same trees."""
    df, problem = many(spark, classes)
    df = df.checkpoint()
    monkeypatch.setattr(grower, "TASK_ROWS", 400)
    made, summed = [], grower._summed_cells

    def watched(*args):
        frame, read = summed(*args)
        made.append((frame.columns, sum(codes.shape[1] for b in frame.toArrow().to_batches() for codes, _ in read(b))))
        return frame, read

    monkeypatch.setattr(grower, "_summed_cells", watched)
    params = {"n_estimators": 5, "max_depth": 4}
    stored = kind(df, problem, params)
    monkeypatch.setattr(grower, "STORED_SUMS", 0)
    anew = kind(df, problem, params)
    assert made == [(["b", "s"], 45), (["b", "n", "v"], 45)]
    for one, two in zip(stored.state["trees"], anew.state["trees"]):
        assert one["feature"] == two["feature"] and one["threshold"] == two["threshold"]
        np.testing.assert_allclose(np.array(one["value"]), np.array(two["value"]))
    assert len(stored.state["trees"][0]["feature"]) > 7
