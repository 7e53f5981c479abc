"""Linear models: MLlib where its objective can be mapped, else one Gram pass."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.models.common import (
    LinearScores, Problem, fit_margins, fit_vector, hinge, logistic,
)
from gridwright.operators.gram import Gram, gram
from gridwright.operators.preprocess import bayesian_ridge


# Newton's method holds a square matrix of this many coefficients at most.
NEWTON_WIDTH = 200


# -- classifiers ----------------------------------------------------------------------------

def logistic_regression(df: DataFrame, problem: Problem, params: dict):
    """C weighs the summed loss, so the mean loss gets an L2 weight of 1 / (C n).

    Few coefficients: Newton's method, about ten passes. Many: MLlib's
    quasi-Newton fit. Both reach the same optimum, whatever solver is named.
    """
    l2 = 1.0 / (params.get("C", 1.0) * df.count())
    binary = problem.n_classes == 2
    if problem.n_classes * (len(problem.features) + 1) <= NEWTON_WIDTH:
        coef, intercept = logistic(
            df, problem.features, problem.label, [1.0] if binary else problem.classes, l2, joint=not binary)
        return _scores(problem, coef, intercept, "probability")
    est = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False,
                             maxIter=params.get("max_iter", 1000))
    return fit_vector(est, df, problem, "vector")


def _scores(problem: Problem, coef: np.ndarray, intercept: np.ndarray, kind: str) -> LinearScores:
    return LinearScores({"features": problem.features, "kind": kind,
                         "coef": np.asarray(coef).tolist(), "intercept": np.asarray(intercept).tolist()})


def sgd_classifier(df: DataFrame, problem: Problem, params: dict) -> LinearScores:
    """The stochastic learner's objective, one class against the rest, solved in batch."""
    alpha = params.get("alpha", 1e-4)
    wanted = [1.0] if problem.n_classes == 2 else problem.classes
    if params.get("loss", "hinge") == "hinge":
        coef, intercept = fit_margins(df, problem.features, problem.label, len(wanted), hinge(wanted), alpha,
                                      max_iter=params.get("max_iter", 1000))
        return _scores(problem, coef, intercept, "scores")
    coef, intercept = logistic(df, problem.features, problem.label, wanted, alpha, joint=False)
    return _scores(problem, coef, intercept, "probability" if problem.n_classes == 2 else "sigmoid")


def ridge_classifier(df: DataFrame, problem: Problem, params: dict) -> LinearScores:
    """Ridge regression on +-1 targets, one per class (one alone for two classes)."""
    alpha = params.get("alpha", 1.0)
    y = col(problem.label)
    wanted = [1.0] if problem.n_classes == 2 else problem.classes
    targets = [F.when(y == c, 1.0).otherwise(-1.0).alias(f"_t{i}") for i, c in enumerate(wanted)]
    p = len(problem.features)
    g = gram(df.select(*[col(c) for c in problem.features], *targets),
             [*problem.features, *[f"_t{i}" for i in range(len(wanted))]])
    coef = np.linalg.solve(g.scatter[:p, :p] + alpha * np.eye(p), g.scatter[:p, p:]).T
    intercept = g.mean[p:] - coef @ g.mean[:p]
    return _scores(problem, coef, intercept, "scores")


def linear_discriminant(df: DataFrame, problem: Problem, params: dict) -> LinearScores:
    """Linear discriminant analysis from class means and one Gram pass.

    The pooled covariance divides by n - k for solver ``svd`` and by n for ``lsqr``.
    """
    x = problem.features
    g = gram(df, x)
    rows = df.groupBy(col(problem.label).alias("_y")).agg(
        F.count("*").alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(x)]
    ).orderBy("_y").collect()
    counts = np.array([r["n"] for r in rows], dtype=float)
    means = np.array([[r[f"m{i}"] for i in range(len(x))] for r in rows])
    centred = means - g.mean
    within = g.scatter - (centred * counts[:, None]).T @ centred
    free = g.n - len(rows) if params.get("solver", "svd") == "svd" else g.n
    inverse = np.linalg.pinv(within / free)
    coef = centred @ inverse
    intercept = np.log(counts / g.n) - 0.5 * np.sum(coef * centred, axis=1) - coef @ g.mean
    if len(rows) == 2:
        coef, intercept = coef[1:] - coef[:1], intercept[1:] - intercept[:1]
    return _scores(problem, coef, intercept, "probability")


# -- regressors: solved from the cross products of one pass ------------------------------------

def _solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def _centred(g: Gram) -> tuple[np.ndarray, np.ndarray, float]:
    p = len(g.mean) - 1
    return g.scatter[:p, :p], g.scatter[:p, p], g.n


def _with_intercept(g: Gram, coef: np.ndarray) -> tuple[np.ndarray, float]:
    return coef, float(g.mean[-1] - g.mean[:-1] @ coef)


def solve_linear(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    p = len(g.mean) - 1
    if not params.get("fit_intercept", True):
        return _solve(g.raw[:p, :p], g.raw[:p, p]), 0.0
    xx, xy, _ = _centred(g)
    return _with_intercept(g, _solve(xx, xy))


def solve_ridge(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    xx, xy, _ = _centred(g)
    return _with_intercept(g, _solve(xx + params.get("alpha", 1.0) * np.eye(len(xy)), xy))


def solve_sgd_squared(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    """Mean squared loss halved, so the penalty counts n times."""
    xx, xy, n = _centred(g)
    return _with_intercept(g, _solve(xx + n * params.get("alpha", 1e-4) * np.eye(len(xy)), xy))


def solve_elastic_net(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    """Coordinate descent on the cross products; no further pass over the rows."""
    alpha, share = params.get("alpha", 1.0), params.get("l1_ratio", 0.5)
    xx, xy, n = _centred(g)
    xx, xy = xx / n, xy / n
    coef = np.zeros(len(xy))
    for _ in range(params.get("max_iter", 5000)):
        largest = 0.0
        for j in range(len(xy)):
            if xx[j, j] <= 0:
                continue
            pull = xy[j] - xx[j] @ coef + xx[j, j] * coef[j]
            new = np.sign(pull) * max(abs(pull) - alpha * share, 0.0) / (xx[j, j] + alpha * (1 - share))
            largest = max(largest, abs(new - coef[j]) * np.sqrt(xx[j, j]))
            coef[j] = new
        if largest < 1e-12 * max(1.0, np.sqrt(max(g.scatter[-1, -1] / n, 0.0))):
            break
    return _with_intercept(g, coef)


def solve_lasso(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    return solve_elastic_net(g, {**params, "l1_ratio": 1.0})


def solve_bayesian_ridge(g: Gram, params: dict) -> tuple[np.ndarray, float]:
    return bayesian_ridge(
        g, alpha_1=params.get("alpha_1", 1e-6), lambda_1=params.get("lambda_1", 1e-6))[:2]


def from_gram(solve):
    """A fit function that needs nothing but the cross products."""
    def fit(df: DataFrame, problem: Problem, params: dict) -> LinearScores:
        coef, intercept = solve(gram(df, [*problem.features, problem.label]), params)
        return _scores(problem, [coef], [intercept], "regression")
    return fit


linear_regression = from_gram(solve_linear)
ridge = from_gram(solve_ridge)
lasso = from_gram(solve_lasso)
elastic_net = from_gram(solve_elastic_net)
bayesian_ridge_regression = from_gram(solve_bayesian_ridge)
_sgd_squared = from_gram(solve_sgd_squared)


def gram_loss(g: Gram, coef: np.ndarray, intercept: float) -> tuple[float, float]:
    """Mean squared error and R^2 of a linear model on the rows behind ``g``."""
    p = len(coef)
    bias = g.mean[p] - g.mean[:p] @ coef - intercept
    s = g.scatter
    rss = s[p, p] - 2 * coef @ s[:p, p] + coef @ s[:p, :p] @ coef + g.n * bias ** 2
    return float(rss / g.n), float(1 - rss / s[p, p]) if s[p, p] > 0 else float("nan")


def huber(df: DataFrame, problem: Problem, params: dict) -> PipelineModel:
    est = LinearRegression(loss="huber", epsilon=params.get("epsilon", 1.35),
                           regParam=params.get("alpha", 1e-4) / df.count(), standardization=False,
                           maxIter=params.get("max_iter", 500))
    return fit_vector(est, df, problem)


def sgd_regressor(df: DataFrame, problem: Problem, params: dict) -> LinearScores:
    """Batch solution of the regularised squared or fixed-width Huber loss."""
    if params.get("loss", "squared_error") == "squared_error":
        return _sgd_squared(df, problem, params)
    width = params.get("epsilon", 0.1)

    def loss(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        residual = margins - y[:, None]
        size = np.abs(residual)
        value = np.where(size <= width, 0.5 * residual ** 2, width * (size - 0.5 * width))
        return value, np.clip(residual, -width, width)

    coef, intercept = fit_margins(df, problem.features, problem.label, 1, loss, params.get("alpha", 1e-4),
                                  center=True, max_iter=params.get("max_iter", 1000))
    return _scores(problem, coef, intercept, "regression")
