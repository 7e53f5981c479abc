"""Kernel machines on random Fourier features (Rahimi and Recht, 2007).

The kernel matrix is never formed: an explicit cosine map approximates the RBF
kernel and a linear machine is fitted on it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.models.base import FittedStage
from gridwright.models.common import PART_ROWS, Problem, fit_margins, hinge, logistic, score_matrix

MAPPED_FEATURES = 128
#: Cosines that are worked out at once.
NEAR_COSINES = 1 << 15
#: The share of rows nearest to the corner of a loss that tell its curvature.
NEAR_CORNER = 0.2


def _gamma(df: DataFrame, problem: Problem, params: dict) -> float:
    """``scale``: 1 / (p Var(X)) over all cells; ``auto``: 1 / p."""
    p = len(problem.features)
    if params.get("gamma", "scale") == "auto":
        return 1.0 / p
    row = df.agg(*[f(col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(problem.features)
                   for s, f in (("m", F.avg), ("v", F.var_pop))]).first()
    means = np.array([row[f"m{i}"] for i in range(p)])
    variance = float(np.mean([row[f"v{i}"] for i in range(p)]) + means.var())
    return 1.0 / (p * variance) if variance > 0 else 1.0


def _draw(p: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2.0 * gamma), size=(p, size)), rng.uniform(0, 2 * np.pi, size)


# sin(u) / u on [0, pi/2] as a polynomial in u * u: Taylor's, whose next term is below 1e-16
_SINE = [(-1.0) ** k / math.factorial(2 * k + 1) for k in range(11)]


def _cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cos(x @ w + b) * np.sqrt(2.0 / len(b))


def _quick_cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same but for rounding, as 1 - 2 sin^2 of half the angle: a few multiplications on some rows at a
    time take less than half the time of the library's cosine, which reduces every angle on its own."""
    out, scale = np.empty((len(x), len(b))), np.sqrt(2.0 / len(b))
    some = max(1, NEAR_COSINES // max(1, len(b)))
    turns, offset = w / (2.0 * np.pi), b / (2.0 * np.pi)
    for at in range(0, len(x), some):
        u = x[at:at + some] @ turns
        u += offset
        u -= np.rint(u)
        u *= np.pi
        square = u * u
        sine = square * _SINE[-1]
        for a in _SINE[-2:0:-1]:
            sine += a
            sine *= square
        sine += _SINE[0]
        sine *= u
        sine *= sine
        sine *= -2.0 * scale
        np.add(sine, scale, out=out[at:at + some])
    return out


class KernelMachine(FittedStage):
    """Margins on mapped features; Platt-scaled probabilities for classes."""

    def margins(self):
        s = self.state
        coef, intercept = np.array(s["coef"]), np.array(s["intercept"])
        mapped = s["map"] is not None
        w, b = (np.array(s["map"]["w"]), np.array(s["map"]["b"])) if mapped else (None, None)

        def score(x: np.ndarray) -> np.ndarray:
            return (_quick_cosines(x, w, b) if mapped else x) @ coef.T + intercept

        return score

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        staged = df.withColumn("_m", score_matrix(df, s["features"], self.margins()))
        if not s["platt"]:
            return staged.withColumn("prediction", F.col("_m")[0]).drop("_m")
        share = [
            1.0 / (1.0 + F.exp(-(F.col("_m")[i] * F.lit(a) + F.lit(c)))) for i, (a, c) in enumerate(s["platt"])
        ]
        if len(share) == 1:
            guess = F.when(F.col("_m")[0] > 0, 1.0).otherwise(0.0)
            p = F.array(1.0 - share[0], share[0])
        else:
            guess = (F.array_position("_m", F.array_max("_m")) - 1).cast("double")
            total = share[0]
            for x in share[1:]:
                total = total + x
            p = F.array(*[x / total for x in share])
        return staged.withColumn("prediction", guess).withColumn("probability", p).drop("_m")


def rbf_classifier(df: DataFrame, problem: Problem, params: dict) -> KernelMachine:
    """C-weighted hinge loss on the mapped features, all classes in each pass; then
    one logistic fit per margin (Platt), again all in the same passes."""
    n, size = df.count(), int(params.get("mapped_features", MAPPED_FEATURES))
    features = problem.features
    w, b = _draw(len(features), _gamma(df, problem, params), size, problem.seed)
    wanted = [1.0] if problem.n_classes == 2 else problem.classes
    coef, intercept = fit_margins(
        df, features, problem.label, len(wanted), hinge(wanted), 1.0 / (params.get("C", 1.0) * n),
        mapping=lambda x: _cosines(x, w, b), max_iter=params.get("max_iter", 1000))
    model = KernelMachine({
        "features": features, "map": {"w": w.tolist(), "b": b.tolist()},
        "coef": coef.tolist(), "intercept": intercept.tolist(), "platt": []})
    margins = df.select(
        col(problem.label).cast("double").alias("label"),
        score_matrix(df, features, model.margins()).alias("m"))
    platt = []
    for i, c in enumerate(wanted):
        one = margins.select(F.col("m")[i].alias("m"), F.when(F.col("label") == c, 1.0).otherwise(0.0).alias("t"))
        slope, offset = logistic(one, ["m"], "t", [1.0], 1e-6, joint=False)
        platt.append([float(slope[0, 0]), float(offset[0])])
    model.state["platt"] = platt
    return model


def support_vector_regressor(df: DataFrame, problem: Problem, params: dict) -> KernelMachine:
    """Epsilon-insensitive loss by summed gradients, linear or on mapped features."""
    n, width = df.count(), params.get("epsilon", 0.1)
    features, mapping, state = problem.features, None, None
    if params.get("kernel", "rbf") == "rbf":
        size = int(params.get("mapped_features", MAPPED_FEATURES))
        w, b = _draw(len(features), _gamma(df, problem, params), size, problem.seed)
        state = {"w": w.tolist(), "b": b.tolist()}

        # a search from nothing on few rows stops early, where depends on the last digit: it keeps the library's
        cosines = _quick_cosines if n > 2 * PART_ROWS else _cosines

        def mapping(x: np.ndarray) -> np.ndarray:
            return cosines(x, w, b)

    def loss(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        residual = margins - y[:, None]
        excess = np.abs(residual) - width
        return np.maximum(excess, 0.0), np.where(excess > 0, np.sign(residual), 0.0)

    def bend(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
        gap = np.abs(np.abs(margins[:, 0] - y) - width)  # the slope jumps by one here
        near = max(float(np.quantile(gap, NEAR_CORNER)), 1e-9)
        return np.where(gap <= near, 0.5 / near, 0.0)

    coef, intercept = fit_margins(df, features, problem.label, 1, loss, 1.0 / (params.get("C", 1.0) * n),
                                  mapping=mapping, center=True, max_iter=params.get("max_iter", 1000), bend=bend if mapping else None)
    return KernelMachine({"features": features, "map": state, "coef": coef.tolist(),
                          "intercept": intercept.tolist(), "platt": []})
