"""The algorithms on offer: name, category, search grid and fit function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridwright.models import bayes, boosting, grower, kernels, linear, nearest, networks, trees


@dataclass(frozen=True)
class Algorithm:
    name: str
    category: str
    grid: dict[str, list]
    fit: Callable
    # for linear least squares: coefficients from cross products alone
    solve: Callable | None = None
    # settings of the grid that make no difference here
    unused: tuple[str, ...] = ()

    def used(self, point: dict) -> dict:
        return {k: v for k, v in point.items() if k not in self.unused}

    def points(self) -> list[dict]:
        names = list(self.grid)
        return [dict(zip(names, values)) for values in product(*self.grid.values())]

    def sample(self, n_iter: int, seed: int = 42) -> list[dict]:
        """Distinct grid points: all of them, or a seeded draw of ``n_iter``."""
        points = self.points()
        n = min(n_iter, len(points))
        chosen = np.random.default_rng(seed).permutation(len(points))[:n]
        return [points[i] for i in chosen]


# Algorithm names, categories and search grids.
CLASSIFIERS = [
    Algorithm("Logistic Regression", "Linear",
              {"C": [0.01, 0.1, 1, 10], "solver": ["lbfgs", "saga"]}, linear.logistic_regression, unused=("solver",)),
    Algorithm("Decision Tree", "Tree",
              {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10]}, grower.decision_tree),
    Algorithm("Random Forest", "Ensemble",
              {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]}, grower.random_forest),
    Algorithm("Gradient Boosting", "Ensemble",
              {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2]}, boosting.gradient_boosting),
    Algorithm("AdaBoost", "Ensemble",
              {"n_estimators": [50, 100], "learning_rate": [0.5, 1.0]}, trees.ada_boost),
    Algorithm("Extra Trees", "Ensemble",
              {"n_estimators": [50, 100], "max_depth": [None, 10]}, grower.extra_trees),
    Algorithm("Hist Gradient Boosting", "Ensemble",
              {"learning_rate": [0.05, 0.1], "max_iter": [100, 200]}, boosting.histogram_boosting),
    Algorithm("SVM (RBF)", "SVM",
              {"C": [0.1, 1, 10], "gamma": ["scale", "auto"]}, kernels.rbf_classifier),
    Algorithm("K-Nearest Neighbors", "Instance-Based",
              {"n_neighbors": [3, 5, 7, 11], "metric": ["euclidean", "manhattan"]}, nearest.nearest_neighbors),
    Algorithm("Gaussian Naive Bayes", "Probabilistic",
              {"var_smoothing": [1e-9, 1e-8, 1e-7]}, bayes.gaussian_naive_bayes),
    Algorithm("LDA", "Linear", {"solver": ["svd", "lsqr"]}, linear.linear_discriminant, unused=("solver",)),
    Algorithm("MLP Neural Network", "Neural Network",
              {"hidden_layer_sizes": [(64,), (128,), (64, 32)], "activation": ["relu", "tanh"]},
              networks.perceptron),
    Algorithm("Ridge Classifier", "Linear", {"alpha": [0.1, 1.0, 10.0]}, linear.ridge_classifier),
    Algorithm("SGD Classifier", "Linear",
              {"alpha": [0.0001, 0.001], "loss": ["hinge", "log_loss"]}, linear.sgd_classifier),
]
REGRESSORS = [
    Algorithm("Linear Regression", "Linear", {"fit_intercept": [True, False]}, linear.linear_regression,
              linear.solve_linear),
    Algorithm("Ridge Regression", "Linear", {"alpha": [0.1, 1.0, 10.0, 100.0]}, linear.ridge,
              linear.solve_ridge),
    Algorithm("Lasso Regression", "Linear", {"alpha": [0.01, 0.1, 1.0, 10.0]}, linear.lasso,
              linear.solve_lasso),
    Algorithm("Elastic Net", "Linear",
              {"alpha": [0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]}, linear.elastic_net,
              linear.solve_elastic_net),
    Algorithm("Bayesian Ridge", "Bayesian",
              {"alpha_1": [1e-6, 1e-5], "lambda_1": [1e-6, 1e-5]}, linear.bayesian_ridge_regression,
              linear.solve_bayesian_ridge),
    Algorithm("Huber Regressor", "Robust",
              {"epsilon": [1.1, 1.35, 1.5], "alpha": [0.0001, 0.001]}, linear.huber),
    Algorithm("Decision Tree", "Tree",
              {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5]}, grower.decision_tree),
    Algorithm("Random Forest", "Ensemble",
              {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]}, grower.random_forest),
    Algorithm("Gradient Boosting", "Ensemble",
              {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1]}, boosting.gradient_boosting),
    Algorithm("AdaBoost", "Ensemble",
              {"n_estimators": [50, 100], "learning_rate": [0.5, 1.0]}, trees.ada_boost),
    Algorithm("Extra Trees", "Ensemble", {"n_estimators": [50, 100]}, grower.extra_trees),
    Algorithm("Hist Gradient Boosting", "Ensemble",
              {"learning_rate": [0.05, 0.1], "max_iter": [100, 200]}, boosting.histogram_boosting),
    Algorithm("SVR", "SVM",
              {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
              kernels.support_vector_regressor),
    Algorithm("K-Nearest Neighbors", "Instance-Based",
              {"n_neighbors": [3, 5, 7, 11]}, nearest.nearest_neighbors),
    Algorithm("MLP Neural Network", "Neural Network",
              {"hidden_layer_sizes": [(64,), (128,), (64, 32)], "activation": ["relu", "tanh"]},
              networks.perceptron),
    Algorithm("SGD Regressor", "Linear",
              {"alpha": [0.0001, 0.001], "loss": ["squared_error", "huber"]}, linear.sgd_regressor),
]


def algorithms(task: str, selected: list[str] | None = None) -> list[Algorithm]:
    roster = CLASSIFIERS if task == "classification" else REGRESSORS
    return [a for a in roster if not selected or a.name in selected]


def find(task: str, name: str) -> Algorithm:
    for a in algorithms(task):
        if a.name == name:
            return a
    raise KeyError(name)


def list_algorithms(spark: SparkSession, task: str) -> DataFrame:
    rows = [(a.name, a.category) for a in algorithms(task)]
    return spark.createDataFrame(rows, "name string, category string")
