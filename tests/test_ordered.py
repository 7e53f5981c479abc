"""Order-based blocks against numpy, with skew and with limits forced low."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions.ordered import (
    quantiles, rank_cutoffs, running_totals, selected_quantiles, with_hash,
)
from gridwright.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows holds one value; a few extreme ones stretch the range."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 101 == 0, 1e9 + F.col("id"))
        .otherwise((F.col("id") * 37 % 997).cast("double") / 7).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("y"),
        F.lit(None).cast("double").alias("nothing"),
        F.lit(5.0).alias("same"),
    )


PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("limits", [{}, {"bins": 5, "rows_per_pick": 20}, {"bins": 64, "rows_per_pick": 1}])
def test_selected_quantiles_are_exact(skewed, limits):
    pdf = skewed.toPandas()
    got = selected_quantiles(skewed, ["x", "y", "nothing", "same"], PROBS, **limits)
    for c in ("x", "y", "same"):
        np.testing.assert_allclose(got[c], np.nanquantile(pdf[c], PROBS), rtol=1e-12)
    assert got["nothing"] == [None] * len(PROBS)


def test_both_quantile_ways_agree(skewed):
    a = quantiles(skewed, ["x", "y", "nothing"], PROBS)
    b = quantiles(skewed, ["x", "y", "nothing"], PROBS, buffer_cells=0)
    for c in ("x", "y"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-12)
    assert a["nothing"] == b["nothing"]


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_rank_cutoffs_match_sorting(spark, limit):
    # one group holds almost everything
    df = spark.range(2000).select("id", F.when(F.col("id") % 20 == 0, "b").otherwise("a").alias("g"))
    cuts = rank_cutoffs(
        with_hash(df, ["id"]), ["g"], [F.col("n") * 0, F.lit(1), F.floor(F.col("n") * 0.3), F.col("n")],
        digits=1, rows_per_bucket=limit).collect()
    for row in cuts:
        keys = [i for i in range(2000) if (i % 20 == 0) == (row["g"] == "b")]
        hashes = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in keys)
        n = len(hashes)
        assert row["n"] == n
        assert row["cutoffs"] == ["", hashes[0], hashes[int(n * 0.3) - 1], hashes[-1]]


@pytest.mark.parametrize("per_bucket", [1_000_000, 50])
def test_running_totals(spark, per_bucket):
    df = spark.range(1000).select(F.col("id").cast("double").alias("s"), (F.col("id") % 7).alias("v"))
    got = running_totals(df, "s", ["v"], rows_per_bucket=per_bucket).orderBy(F.desc("s")).toPandas()
    assert (got["cum_v"].to_numpy() == np.cumsum(np.arange(999, -1, -1) % 7)).all()
    assert (got["total_v"] == sum(i % 7 for i in range(1000))).all()


def test_splits_are_stable_disjoint_and_sized(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("g"))
    one = S.holdout(df, ["id"], 0.2, "g").toPandas()
    two = S.holdout(df.repartition(9), ["id"], 0.2, "g").toPandas().sort_values("id", ignore_index=True)
    assert len(one) == 1003
    assert (one.sort_values("id", ignore_index=True)["is_test"] == two["is_test"]).all()
    for g, part in one.groupby("g"):
        assert part["is_test"].sum() == round(len(part) * 0.2)
    folds = S.folds(df, ["id"], 4, "g").toPandas()
    sizes = folds.groupby(["g", "fold"]).size()
    assert set(folds["fold"]) == {0, 1, 2, 3}
    for g in ("x", "y"):
        assert sizes[g].max() - sizes[g].min() <= 1


def test_nested_samples_grow(spark):
    df = spark.range(500)
    got = S.nested_samples(df, ["id"], [0.1, 0.5]).toPandas()
    assert (got["step"] == 0).sum() == 50
    assert (got["step"] <= 1).sum() == 250
    assert (got["step"] == 2).sum() == 250
