import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions.columns import nan_to_null
from gridwright.operators import features as E
from gridwright.operators import preprocess as R
from gridwright.operators import profile as P
from gridwright.session import scratch_path
from gridwright.sources import tables as S


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(300).select(
        "id",
        F.when(F.col("id") % 7 != 0, (F.col("id") * 13 % 101).cast("double")).alias("a"),
        (F.col("id") * 17 % 89).cast("double").alias("b"),
        F.lit(5.0).alias("same"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).alias("c"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("d"),
        F.concat(F.lit("k"), (F.col("id") % 30).cast("string")).alias("e"),
    )


@pytest.mark.parametrize("scaling, encoding", [
    ("standard", "auto"), ("minmax", "onehot"), ("robust", "label"), ("maxabs", "ordinal"),
    ("power", "auto"), ("none", "auto"), ("unknown", "label"),
])
def test_every_option_leaves_complete_numbers(mixed, scaling, encoding):
    options = R.PreparationOptions(missing_strategy="median", scaling=scaling, encoding=encoding)
    out = R.Preparation(options, key="id").fit(mixed).transform(mixed).toPandas()
    assert len(out) == 300
    assert out.notna().all().all()
    assert all(out[c].dtype.kind in "if" for c in out.columns)
    if scaling == "standard":
        assert abs(out["b"].mean()) < 1e-9 and abs(out["b"].std(ddof=0) - 1) < 1e-9
        assert (out["same"] == 0).all()


@pytest.mark.parametrize("strategy", ["auto", "mean", "median", "most_frequent", "knn", "iterative"])
def test_every_fill_strategy(mixed, strategy):
    df = mixed.select("id", "a", "b")
    model = R.Preparation(R.PreparationOptions(missing_strategy=strategy, scaling="none"), key="id").fit(df)
    out = model.transform(df).toPandas()
    before = df.toPandas()
    assert out["a"].notna().all()
    known = before["a"].notna()
    assert (out.sort_values("id")["a"].to_numpy()[known] == before["a"][known]).all()


def test_iterative_fill_recovers_a_linear_relation(spark):
    df = spark.range(400).select(
        "id", F.col("id").cast("double").alias("x"), ((F.col("id") * 31) % 57).cast("double").alias("z"))
    df = df.withColumn("y", F.when(F.col("id") % 6 != 0, 3 * F.col("x") - 2 * F.col("z") + 4))
    step = R.fit_fill_iterative(df.drop("id"))
    out = R.apply_step(df, step).toPandas()
    np.testing.assert_allclose(out["y"], 3 * out["x"] - 2 * out["z"] + 4, atol=0.05)


def test_saved_model_replays(spark, mixed):
    options = R.PreparationOptions(missing_strategy="knn", outlier_method="iqr", drop_low_variance=True)
    model = R.Preparation(options, key="id").fit(mixed)
    path = scratch_path(spark, "prep")
    model.write().save(path)
    a = model.transform(mixed).toPandas().sort_values("id", ignore_index=True)
    b = R.PreparationModel.load(path).transform(mixed).toPandas().sort_values("id", ignore_index=True)
    assert list(a.columns) == list(b.columns) and "same" not in a.columns
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float))


def test_unseen_text_fails(spark, mixed):
    codes = R.dictionary(mixed, "e")
    other = spark.createDataFrame([(1, "never")], "id int, e string")
    with pytest.raises(Exception, match="unseen value"):
        R.encode(other, "e", codes).collect()
    assert R.encode(other, "e", codes, invalid="null").first()["e"] is None


def test_dictionary_is_the_rank_of_sorted_texts(spark):
    df = spark.range(5000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    got = {r["value"]: r["code"] for r in R.dictionary(df, "t").collect()}
    assert got == {v: float(i) for i, v in enumerate(sorted(f"t{i}" for i in range(5000)))}


def test_zscore_leaves_a_constant_column(spark):
    df = spark.range(20).select(F.lit(1.0).alias("c"), F.col("id").cast("double").alias("x"))
    out = R.apply_step(df, R.fit_outliers(df, "zscore", 1.0)).toPandas()
    assert out["c"].notna().all() and out["x"].isna().any()


def test_power_exponent_maximises_the_likelihood(spark):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(size=500))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam, mean, sd = R.fit_power(df, ["x"])["columns"]["x"]

    def log_likelihood(value):
        y = ((x + 1) ** value - 1) / value
        return -0.5 * len(x) * np.log(y.var()) + (value - 1) * np.log1p(x).sum()

    assert log_likelihood(lam) >= max(log_likelihood(lam + d) for d in (-0.01, 0.01)) - 1e-6
    out = R.apply_step(df, {"op": "power", "columns": {"x": [lam, mean, sd]}}).toPandas()["x"]
    assert abs(out.mean()) < 1e-9 and abs(out.std(ddof=0) - 1) < 1e-9


def test_edge_tables_do_not_crash(spark):
    empty = spark.createDataFrame([], "x double, t string")
    one = spark.createDataFrame([(1.0, None)], "x double, t string")
    for df in (empty, one):
        assert P.profile_numeric(df, ["x"]).count() == 1
        assert P.overview(df).first()["n_rows"] == df.count()
        P.top_values(df).collect()
        P.correlation(df).collect()
        P.histogram(df, "x").collect()
        R.Preparation(R.PreparationOptions()).fit(df).transform(df).collect()
    assert P.profile(one, "t", ["x"])["target"].first()["n_unique"] == 0


def test_wide_correlation_agrees_with_pairs(spark):
    from gridwright.operators.gram import pair_moments
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    df = nan_to_null(spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double, d double"))
    import pandas as pd
    want = pd.DataFrame(x).corr().to_numpy()
    for row in pair_moments(df, df.columns).collect():
        assert abs(row["corr"] - want[row["i"], row["j"]]) < 1e-9
    for row in P.correlation(df, digits=None).collect():
        i, j = "abcd".index(row["col_a"]), "abcd".index(row["col_b"])
        assert abs(row["corr"] - want[i, j]) < 1e-9


def test_csv_types_and_missing_texts(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame(
        [("1", "2.5", "True", "x", "NA"), ("NA", "", "False", "a \"quoted\", text", "null"), ("3", "1e3", "NaN", "line\nbreak", "")],
        "i string, d string, b string, t string, e string",
    ).coalesce(1).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    df = S.read_table(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "t": "string", "e": "double"}
    rows = df.toPandas()
    assert rows["i"].isna().sum() == 1 and rows["d"].isna().sum() == 1 and rows["e"].isna().all()
    assert "line\nbreak" in set(rows["t"]) and 'a "quoted", text' in set(rows["t"])


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 50
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = E.pca(df, n_components=9)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose(got.share, values / values.sum(), atol=1e-9)
    scores = got.transform(df).toPandas().to_numpy()
    np.testing.assert_allclose(scores.mean(axis=0), 0, atol=1e-8)
    np.testing.assert_allclose(scores.var(axis=0, ddof=1), values, rtol=1e-7)


def test_polynomial_order_and_selection(spark):
    df = spark.createDataFrame([(2.0, 3.0, "k")], "a double, b double, t string")
    assert E.polynomial_features(df).columns == ["t", "a", "b", "a^2", "a b", "b^2"]
    out = E.interaction_features(spark.createDataFrame([(2.0, 0.0)], "a double, b double")).first()
    assert out["a_x_b"] == 0.0 and out["a_div_b"] == 0.0
    sel = E.select_features(df, ["a", "b"], "t", k=5)
    assert sel.filter("selected").count() == 2
