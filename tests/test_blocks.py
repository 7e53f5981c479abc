"""Columns in blocks: sums without conversion of single rows, and the fits on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.models import common, linear
from gridwright.models.common import Blocks, Problem


def test_blocks_hold_every_row(spark):
    df = spark.range(25_000).select(
        F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("a b"), (F.col("id") % 7).alias("c")).repartition(3)
    data = Blocks(df, ["a b", "c"])
    assert data.data.count() < 25  # a pass converts so many values, not 25,000 rows
    for rows in (common.BLOCK_ROWS, 100):
        total = data.sum(4, lambda z: np.array([len(z), np.isnan(z[:, 0]).sum(), z[:, 1].sum(), np.nanmax(z[:, 0])]), largest=1, rows=rows)
        assert total[0] == 25_000 and total[1] == 2500 and total[2] == sum(i % 7 for i in range(25_000)) and total[3] == 24_999
    twice = data.renewed(lambda z: 2 * z[:, 1])
    assert twice.sum(1, lambda z: z[:, 1:].sum(axis=0))[0] == 2 * total[2] and data.sum(1, lambda z: z[:, 1:].sum(axis=0))[0] == total[2]
    assert Blocks(df.limit(0), ["c"]).sum(2, lambda z: np.array([len(z), z[:, 0].sum()])).tolist() == [0, 0]


def test_tasks_read_a_bounded_part(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_BYTES", 8 * 1000)
    monkeypatch.setattr(common, "LEAST_ROWS", 100)
    monkeypatch.setattr(common, "BLOCK_BYTES", 8 * 100)
    data = Blocks(spark.range(20_000).coalesce(1), ["id"])
    assert data.tasks == 20 and data.data.count() == 200
    assert data.sum(2, lambda z: np.array([len(z), z[:, 0].sum()])).tolist() == [20_000, 19_999 * 10_000]


@pytest.mark.parametrize("fit", ["margins", "logistic"])
def test_fits_pass_over_blocks_only(spark, monkeypatch, fit):
    """No pass of a search converts single rows."""
    def refuse(*args, **kwargs):
        raise AssertionError("a pass over single rows")

    monkeypatch.setattr(common, "sum_over_rows", refuse)
    df = spark.range(600).select((F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 > 6).cast("double").alias("label"))
    if fit == "logistic":
        model = linear.logistic_regression(df, Problem(["x"], "classification"), {"C": 1.0})
    else:
        model = linear.sgd_regressor(df, Problem(["x"], "regression", 0), {"loss": "huber"})
    assert model.state["coef"][0][0] > 0
