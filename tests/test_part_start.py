"""Searches that begin on a part of the rows end on all of them."""

import numpy as np
import pytest

from gridwright.models import common, kernels
from gridwright.models.common import Blocks, Problem


def test_cosines_are_those_of_the_library():
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(0, 30, (700, 3)), rng.normal(0, 1, (3, 128)), rng.uniform(0, 2 * np.pi, 128)
    np.testing.assert_allclose(kernels._quick_cosines(x, w, b), np.cos(x @ w + b) * np.sqrt(2 / 128), rtol=0, atol=1e-13)
    assert np.isnan(kernels._quick_cosines(np.array([[np.nan, 1.0, 1.0]]), w, b)).all() and kernels._quick_cosines(x[:0], w, b).shape == (0, 128)


def test_a_large_table_takes_few_passes(spark, monkeypatch):
    """From a part with its curvature: the objective over all rows is no higher, in a tenth of the passes."""
    rng = np.random.default_rng(4)
    x = rng.random((8000, 2)) * [10, 3]
    y = x[:, 0] * (1 - x[:, 1] / 5) + rng.normal(0, 0.3, 8000)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double").repartition(3).checkpoint()
    problem, params = Problem(["a", "b"], "regression", 0), {"C": 10, "mapped_features": 24}
    passes, plain, read = [], Blocks.sum, []
    monkeypatch.setattr(Blocks, "sum", lambda self, size, fn, **more: passes.append(size) or read.append(
        plain(self, 1, lambda z: np.array([len(z)]))[0] if len(passes) < 20 else 8000) or plain(self, size, fn, **more))

    def fit():
        passes.clear()
        s = kernels.support_vector_regressor(df, problem, params).state
        z = kernels._cosines(x, np.array(s["map"]["w"]), np.array(s["map"]["b"]))
        coef = np.array(s["coef"])[0]
        excess = np.abs(z @ coef + s["intercept"][0] - y) - 0.1
        return np.maximum(excess, 0).mean() + 0.5 / (10 * 8000) * (coef ** 2).sum(), len(passes)

    whole, many = fit()
    monkeypatch.setattr(common, "PART_ROWS", 2000)
    parted, few = fit()
    assert parted <= whole * (1 + 1e-4) and few <= 12 < many
    assert set(read) == {8000.0}  # every pass reads all rows
