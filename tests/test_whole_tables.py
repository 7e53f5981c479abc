"""No row is lost, cut or treated apart: missing labels, long keys, infinities, big files, deep trees."""

import math
import uuid
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions import ordered
from gridwright.models import common, grower
from gridwright.models.common import Problem
from gridwright.models.nearest import nearest_neighbors
from gridwright.operators import gram, splits
from gridwright.sources import tables


def test_rows_without_a_label_stay_unmarked(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 10 > 0, (F.col("id") % 3).cast("double")))
    marked = splits.holdout(df, ["id"], 0.2, "label").collect()
    assert len(marked) == 100 and all((r["is_test"] is None) == (r["label"] is None) for r in marked)
    assert sum(bool(r["is_test"]) for r in marked) == 18
    folds = splits.folds(df, ["id"], 5, "label").collect()
    assert len(folds) == 100 and all((r["fold"] is None) == (r["label"] is None) for r in folds)
    assert splits.nested_samples(df, ["id"], [0.5], ["label"]).filter("step IS NULL").count() == 10


def test_long_keys_break_ties(spark):
    """Keys that only differ behind their 20th character, and negative numbers, in their own order."""
    keys = sorted(str(uuid.UUID(int=n)) for n in (5, 1, 9, 7))
    rows = [(k, 0.0, float(i)) for i, k in enumerate(keys)]
    train = spark.createDataFrame(rows, "k string, x double, label double")
    model = nearest_neighbors(train, Problem(["x"], "regression", settings={"key": "k"}), {"n_neighbors": 2})
    assert model.transform(spark.createDataFrame([(0.0,)], "x double")).first()["prediction"] == 0.5
    numbers = [-(2**63), -30, -4, 0, 3, 20, 2**63 - 1]
    train = spark.createDataFrame([(k, 0.0, float(i)) for i, k in enumerate(numbers)], "k long, x double, label double")
    model = nearest_neighbors(train, Problem(["x"], "regression", settings={"key": ["k"]}), {"n_neighbors": 3})
    assert model.transform(spark.createDataFrame([(0.0,)], "x double")).first()["prediction"] == 1.0


@pytest.mark.parametrize("special", [[], [math.inf], [-math.inf] * 3, [math.nan], [math.inf, math.nan, -math.inf] * 40])
def test_quantiles_with_infinities(spark, special):
    values = [float(i * i % 977) for i in range(3000)] + special
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(v for v in values if not math.isnan(v)) + [v for v in values if math.isnan(v)]
    ranks = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = ordered.selected_quantiles(df, ["x"], ranks, bins=16, rows_per_pick=10)["x"]
    for p, value in zip(ranks, got):
        at = p * (len(order) - 1)
        low, high, part = order[math.floor(at)], order[math.ceil(at)], at - math.floor(at)
        expected = low if part == 0 else (1 - part) * low + part * high
        assert value == expected or math.isnan(value) and math.isnan(expected)


def test_quantiles_of_the_widest_range(spark):
    df = spark.createDataFrame([(-1.7e308,), (-1.0,), (0.0,), (2.0,), (1.7e308,)] * 50, "x double")
    assert ordered.selected_quantiles(df, ["x"], [0.0, 0.5, 1.0], rows_per_pick=10)["x"] == [-1.7e308, 0.0, 1.7e308]


def test_csv_is_read_in_parts(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    with open(path, "w") as f:
        f.write("a,b\n")
        f.writelines(f'{i},"x ""{i}"", y"\n' for i in range(200_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = tables.read_table(spark, path)
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.count("*"), F.sum("a"), F.max(F.length("b"))).first()[:2] == (200_000, 199_999 * 100_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = str(tmp_path / "lines.csv")
    with open(lines, "w") as f:
        f.write('a,b\n1,"x\ny"\n2,z\n')
    assert tables.read_table(spark, lines, multi_line=True).count() == 2


def test_partial_sums_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.normal(1e6, 1.0, (500, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    expected = np.cov(np.array(rows).T, bias=True) * 500
    for parts in (1, 7, 40):
        g = gram.grams(df.orderBy("a").repartition(parts), ["a", "b", "c"])[0]
        assert g.n == 500 and np.allclose(g.scatter, expected, rtol=1e-8) and np.allclose(g.mean, np.mean(rows, axis=0), rtol=1e-13)
    total = common.sum_over_rows(df.repartition(40), ["a", "b"], 3, lambda z: np.array([len(z), z[:, 0].sum(), z[:, 1].max()]), largest=1)
    assert total[0] == 500 and total[1] == pytest.approx(sum(r[0] for r in rows)) and total[2] == max(r[1] for r in rows)
    assert gram.grams(df.limit(0), ["a"]) == {}


def test_groups_of_cross_products_add_up(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"))
    parts, whole = gram.grams(df, ["a", "b"], "g"), gram.grams(df, ["a", "b"])[0]
    together = parts[0] + parts[1] + parts[2]
    assert np.allclose(together.scatter, whole.scatter) and np.allclose((whole - parts[0]).scatter, (parts[1] + parts[2]).scatter)


def test_small_nodes_are_not_split(spark):
    """One row apart from twenty: it may be split off unless a node needs 25 rows."""
    rows = [(float(i), 1.0 if i == 0 else 0.0) for i in range(21)]
    df = spark.createDataFrame(rows, "x double, label double")
    problem = Problem(["x"], "classification", n_classes=2)
    apart = grower.decision_tree(df, problem, {"min_samples_split": 21}).transform(df)
    assert apart.filter("prediction = label").count() == 21
    whole = grower.decision_tree(df, problem, {"min_samples_split": 22}).transform(df)
    assert whole.filter("prediction = 0").count() == 21


def test_pruned_tree_equals_the_whole_one_above_the_minimum(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 2))
    rows = [(float(a), float(b), float(np.sin(6 * a) + b * b)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    problem = Problem(["a", "b"], "regression")
    model = grower.decision_tree(df, problem, {"min_samples_split": 40, "max_depth": 8})
    tree = {k: np.array(v, dtype=object if k == "value" else None) for k, v in model.state["trees"][0].items()}
    counts = np.zeros(len(tree["feature"]), dtype=int)
    for point in x:
        node = 0
        counts[node] += 1
        while tree["feature"][node] >= 0:
            node = tree["left"][node] if point[tree["feature"][node]] <= tree["threshold"][node] else tree["right"][node]
            counts[node] += 1
    assert all(counts[i] >= 40 for i, f in enumerate(tree["feature"]) if f >= 0)
    assert sum(model.state["importances"]) == pytest.approx(1.0)


def test_extra_trees_without_a_limit_are_pure(spark):
    rng = np.random.default_rng(3)
    rows = [(float(i), float(rng.integers(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, label double")
    model = grower.extra_trees(df, Problem(["x"], "classification", n_classes=2), {"n_estimators": 3})
    assert model.transform(df).filter("prediction = label").count() == 300
    depth = {0: 0}
    for node, left in enumerate(model.state["trees"][0]["left"]):
        if left >= 0:
            depth[left] = depth[left + 1] = depth[node] + 1
    assert max(depth.values()) > 8


def test_a_search_that_stops_early_says_so():
    def bowl(x):
        return float(((x - 3.0) ** 2 * np.array([1.0, 100.0])).sum()), 2 * (x - 3.0) * np.array([1.0, 100.0])

    with pytest.warns(common.NotConverged):
        common.minimize(bowl, np.zeros(2), max_iter=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert np.allclose(common.minimize(bowl, np.zeros(2)), 3.0, atol=1e-3)
