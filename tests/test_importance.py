"""Permutation importance against shuffles made by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators.curves import permutation_importance


def shuffles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"k{i}", float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(250, 2)))]
    df = spark.createDataFrame(rows, "i int, k string, a double, b double, label double").repartition(3)
    predict = lambda d: d.withColumn("prediction", 2.5 * F.col("a") + F.col("b"))
    return rows, permutation_importance(df, ["a", "b"], predict, ["i", "k"], repeats=4)


def test_importance_equals_shuffles_by_hand(spark):
    rows, out = shuffles(spark)
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in out.collect()}
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    order = lambda rep, side: sorted(range(len(rows)), key=lambda i: hashlib.md5(f"42:{rep}:{side}:{rows[i][0]}:{rows[i][1]}".encode()).hexdigest())
    r2 = lambda z: 1 - ((y - 2.5 * z[:, 0] - z[:, 1]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for j, name in enumerate("ab"):
        drops = []
        for rep in range(4):
            z = x.copy()
            z[order(rep, "a"), j] = x[order(rep, "b"), j]
            drops.append(r2(x) - r2(z))
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)))


def test_rows_cross_the_network_once(spark):
    _, out = shuffles(spark)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LogicalRDD") == 1  # four repeats, one read and one dealing


def test_missing_values_and_keys_are_shuffled_along(spark):
    rows = [(None, float(i) if i % 3 else None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, label double")
    seen = []

    def predict(d):
        seen.append(d)
        return d.withColumn("prediction", F.coalesce("a", F.lit(0.0)))

    permutation_importance(df, ["a"], predict, ["i"], repeats=2).collect()
    assert seen[1].count() == 120 and seen[1].filter("a IS NULL").count() == 40
