"""Multilayer perceptrons with relu or tanh units, fitted by summed gradients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.models.base import FittedStage
from gridwright.models.common import Blocks, Problem, minimize, score_matrix, with_outputs


def _shapes(layers: list[int]) -> list[tuple[int, int]]:
    return [(a + 1, b) for a, b in zip(layers, layers[1:])]


def _unpack(theta: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for rows, cols in _shapes(layers):
        out.append(theta[at:at + rows * cols].reshape(rows, cols))
        at += rows * cols
    return out


def _forward(x: np.ndarray, weights: list[np.ndarray], activation: str) -> list[np.ndarray]:
    """Inputs of every layer followed by the raw output."""
    states = [x]
    for i, w in enumerate(weights):
        z = states[-1] @ w[1:] + w[0]
        if i < len(weights) - 1:
            z = np.maximum(z, 0.0) if activation == "relu" else np.tanh(z)
        states.append(z)
    return states


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Perceptron(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        weights = [np.array(w) for w in s["weights"]]
        mean, sd = np.array(s["mean"]), np.array(s["sd"])
        y_mean, y_sd = s["label"]
        classification, activation = s["classification"], s["activation"]

        def score(x: np.ndarray) -> np.ndarray:
            out = _forward((x - mean) / sd, weights, activation)[-1]
            return _softmax(out) if classification else out * y_sd + y_mean

        return with_outputs(df, score_matrix(df, s["features"], score), classification)


def perceptron(df: DataFrame, problem: Problem, params: dict) -> Perceptron:
    """Full-batch limited-memory BFGS on cross-entropy or squared loss.

    Every step sums gradients over all rows, so the result does not depend on
    how the rows are spread over tasks.
    """
    hidden = list(params.get("hidden_layer_sizes", (100,)))
    activation = params.get("activation", "relu")
    l2 = params.get("alpha", 1e-4)
    x = problem.features
    p, k = len(x), problem.n_classes if problem.is_classification else 1
    columns = [*x, problem.label]
    stats = df.agg(*[f(col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(columns)
                     for s, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    mean = np.array([stats[f"m{i}"] for i in range(p)])
    sd = np.array([stats[f"s{i}"] or 1.0 for i in range(p)])
    y_mean, y_sd = (0.0, 1.0) if problem.is_classification else (stats[f"m{p}"], stats[f"s{p}"] or 1.0)
    n = stats["n"]
    layers = [p, *hidden, k]
    rng = np.random.default_rng(problem.seed)
    start = np.concatenate([
        np.vstack([np.zeros((1, b)), rng.uniform(-1, 1, (a - 1, b)) * np.sqrt(6.0 / (a - 1 + b))]).ravel()
        for a, b in _shapes(layers)
    ])
    classification = problem.is_classification
    data = Blocks(df, columns)

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights = _unpack(theta, layers)

        def part(z: np.ndarray) -> np.ndarray:
            inputs, y = (z[:, :p] - mean) / sd, z[:, p]
            states = _forward(inputs, weights, activation)
            rows = np.arange(len(y))
            if classification:
                share = _softmax(states[-1])
                label = y.astype(int)
                value = -np.log(np.maximum(share[rows, label], 1e-300)).sum()
                delta = share
                delta[rows, label] -= 1.0
            else:
                delta = states[-1] - ((y - y_mean) / y_sd)[:, None]
                value = 0.5 * float((delta ** 2).sum())
            grads = []
            for i in range(len(weights) - 1, -1, -1):
                grads.append(np.vstack([delta.sum(axis=0, keepdims=True), states[i].T @ delta]).ravel())
                if i:
                    delta = delta @ weights[i][1:].T
                    delta = delta * ((states[i] > 0) if activation == "relu" else 1 - states[i] ** 2)
            return np.concatenate([[value], *reversed(grads)])

        total = data.sum(len(theta) + 1, part) / n
        decay = np.concatenate([np.vstack([np.zeros((1, w.shape[1])), w[1:]]).ravel() for w in weights])
        value = total[0] + 0.5 * l2 / n * float(decay @ decay)
        return value, total[1:] + l2 / n * decay

    theta = minimize(objective, start, params.get("max_iter", 500), 1e-4)
    return Perceptron({
        "features": x, "weights": [w.tolist() for w in _unpack(theta, layers)],
        "activation": activation, "mean": mean.tolist(), "sd": sd.tolist(),
        "label": [y_mean, y_sd], "classification": classification,
    })
