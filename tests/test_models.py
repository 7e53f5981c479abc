"""Fitted models against closed forms, and the selection loop end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.catalog.base import LANG_FEATURES, languages
from gridwright.models.common import Problem
from gridwright.operators import metrics as M
from gridwright.plans import trainer as T
from gridwright.plans.registry import CLASSIFIERS, REGRESSORS, algorithms, find, list_algorithms
from gridwright.plans.runlog import RunLog
from gridwright.plans.scoring import Scorer
from gridwright.session import scratch_path

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3)) * [1.0, 5.0, 0.3] + [0.0, 10.0, -1.0]
    y = x @ [2.0, -0.5, 3.0] + 1.0 + rng.normal(size=240) * 0.4
    label = (y > np.median(y)).astype(float)
    three = np.digitize(y, np.quantile(y, [0.33, 0.66])).astype(float)
    rows = [(i, *map(float, r), float(t), float(b), float(m)) for i, (r, t, b, m) in
            enumerate(zip(x, y, label, three))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, two double, three double")
    return df.repartition(3).cache(), x, y, label, three


def coefficients(model):
    return np.array(model.state["coef"]), np.array(model.state["intercept"])


def test_ridge_and_bayesian_ridge(numbers):
    df, x, y, *_ = numbers
    rows = df.withColumn("label", F.col("y"))
    xc, yc = x - x.mean(0), y - y.mean()
    coef, _ = coefficients(find("regression", "Ridge Regression").fit(rows, Problem(FEATURES, "regression"), {"alpha": 7.0}))
    np.testing.assert_allclose(coef[0], np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ yc), rtol=1e-9)
    coef, icept = coefficients(find("regression", "Bayesian Ridge").fit(rows, Problem(FEATURES, "regression"), {}))
    np.testing.assert_allclose(coef[0], [2.0, -0.5, 3.0], atol=0.2)


def test_elastic_net_meets_its_optimality_conditions(numbers):
    df, x, y, *_ = numbers
    rows = df.withColumn("label", F.col("y"))
    alpha, share = 0.5, 0.4
    coef, icept = coefficients(find("regression", "Elastic Net").fit(
        rows, Problem(FEATURES, "regression"), {"alpha": alpha, "l1_ratio": share}))
    residual = y - x @ coef[0] - icept[0]
    grad = -x.T @ residual / len(y) + alpha * (1 - share) * coef[0]
    for g, b in zip(grad, coef[0]):
        if b:
            assert abs(g + alpha * share * np.sign(b)) < 1e-6
        else:
            assert abs(g) <= alpha * share + 1e-6
    assert abs(residual.mean()) < 1e-9


@pytest.mark.parametrize("classes, column", [(2, "two"), (3, "three")])
def test_logistic_gradient_is_zero(numbers, classes, column):
    df, x, y, two, three = numbers
    label = two if classes == 2 else three
    rows = df.withColumn("label", F.col(column))
    coef, icept = coefficients(find("classification", "Logistic Regression").fit(
        rows, Problem(FEATURES, "classification", classes), {"C": 0.5}))
    s = x @ coef.T + icept
    if classes == 2:
        p, t = 1 / (1 + np.exp(-s)), label[:, None]
    else:
        e = np.exp(s - s.max(1, keepdims=True))
        p, t = e / e.sum(1, keepdims=True), np.eye(3)[label.astype(int)]
    np.testing.assert_allclose(0.5 * (p - t).T @ x + coef, 0, atol=1e-5)
    np.testing.assert_allclose((p - t).sum(0), 0, atol=1e-5)


LIGHT = {
    "Random Forest": {"n_estimators": 10, "max_depth": 5}, "Gradient Boosting": {"n_estimators": 5},
    "AdaBoost": {"n_estimators": 5}, "Extra Trees": {"n_estimators": 10, "max_depth": 6},
    "Hist Gradient Boosting": {"max_iter": 5}, "Decision Tree": {"max_depth": 4},
    "SVM (RBF)": {"C": 10, "max_iter": 30, "mapped_features": 64}, "SVR": {"C": 10, "kernel": "linear", "max_iter": 30},
    "MLP Neural Network": {"hidden_layer_sizes": (8,), "max_iter": 25},
}


@pytest.mark.parametrize("algorithm", [a.name for a in CLASSIFIERS])
def test_every_classifier_learns_three_classes(numbers, algorithm):
    df, *_ = numbers
    rows = df.withColumn("label", F.col("three")).select("id", *FEATURES, "label")
    problem = Problem(FEATURES, "classification", 3)
    out = find("classification", algorithm).fit(rows, problem, LIGHT.get(algorithm, {})).transform(rows)
    assert set(out.columns) - set(rows.columns) <= {"prediction", "probability"}
    got = out.toPandas()
    assert len(got) == 240 and (got["prediction"] == got["label"]).mean() > 0.6
    if "probability" in out.columns:
        p = np.stack(got["probability"].to_numpy())
        assert p.shape == (240, 3)
        np.testing.assert_allclose(p.sum(1), 1.0)
    else:
        assert algorithm in ("Ridge Classifier", "SGD Classifier")


@pytest.mark.parametrize("algorithm", [a.name for a in REGRESSORS])
def test_every_regressor_learns(numbers, algorithm):
    df, *_ = numbers
    rows = df.withColumn("label", F.col("y")).select("id", *FEATURES, "label")
    params = {"alpha": 0.1} if algorithm in ("Lasso Regression", "Elastic Net") else LIGHT.get(algorithm, {})
    out = find("regression", algorithm).fit(rows, Problem(FEATURES, "regression", 0), params).transform(rows)
    assert out.agg(M.regression_aggregates()["r2"]).first()[0] > 0.5


def test_one_pass_search_equals_fold_by_fold(numbers):
    from gridwright.operators.splits import folds
    df, *_ = numbers
    rows = folds(df.withColumn("label", F.col("y")), ["id"], 3)
    problem = Problem(FEATURES, "regression", 0)
    ridge = find("regression", "Ridge Regression")
    best, scores = T.search(rows, problem, ridge, ridge.points(), 3, "r2")
    slow = T.cross_validate(rows, problem, ridge.fit, best, 3, "r2")
    np.testing.assert_allclose(scores, slow, rtol=1e-9)


def test_training_run_save_and_score(spark, sf):
    df = languages(spark, sf)
    options = T.TrainingOptions(cv_folds=2, tuning_method="grid", selected_algorithms=["LDA", "Ridge Classifier", "K-Nearest Neighbors"],
                                overrides={"K-Nearest Neighbors": {"n_neighbors": "broken", "metric": "euclidean"}})
    run = T.train(df, "lang", LANG_FEATURES, ["doc_id"], options)
    board = {r["name"]: r for r in run.leaderboard.collect()}
    assert run.task == "classification" and run.n_train + run.n_test == df.count()
    assert board["K-Nearest Neighbors"]["cv_mean"] == T.FAILED and board["K-Nearest Neighbors"]["error"]
    assert board["LDA"]["accuracy"] > 0.8 and run.best_name in ("LDA", "Ridge Classifier")
    assert len(board["LDA"]["cv_scores"]) == 2 and board["LDA"]["confusion_matrix"]
    assert T.comparison(run.leaderboard, run.task).count() == 2
    path = run.save(scratch_path(spark, "run"))
    scorer = Scorer.load(spark, path)
    a = {r["doc_id"]: r["prediction"] for r in Scorer.of(run).predict(df).collect()}
    b = {r["doc_id"]: r["prediction"] for r in scorer.predict(df).collect()}
    assert a == b and set(a.values()) <= set(run.labels)
    # an absent feature counts as zero
    short = scorer.score_batch(df.drop("es", "lang"))
    assert "__prediction__" in short.columns and "es" in short.columns and short.count() == df.count()
    assert scorer.importance(spark).count() == 3


def test_registry_lists_every_algorithm(spark):
    assert list_algorithms(spark, "classification").count() == 14
    assert list_algorithms(spark, "regression").count() == 16
    assert [a.name for a in algorithms("regression", ["SVR"])] == ["SVR"]
    knn = find("classification", "K-Nearest Neighbors")
    assert len(knn.points()) == 8 and len(knn.sample(5)) == 5 and len(knn.sample(50)) == 8


def test_run_log(spark):
    log = RunLog(spark, scratch_path(spark, "log"))
    assert log.count() == 0
    one = log.log(metrics={"r2": 0.5}, task_type="regression", best_model="LDA")
    log.log(name="mine", metrics={"mae": 2}, tags=["x"])
    assert log.count() == 2 and log.get(one).first()["name"] == "run_1"
    rows = {r["name"]: r for r in log.compare().collect()}
    assert rows["run_1"]["r2"] == 0.5 and rows["run_1"]["mae"] is None and rows["mine"]["mae"] == 2.0
    with pytest.raises(KeyError):
        log.get("none")
    log.clear()
    assert log.count() == 0


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
