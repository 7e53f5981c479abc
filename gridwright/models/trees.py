"""Boosting by re-weighting of small trees, and the importances of all models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, col
from gridwright.models.base import FittedStage
from gridwright.models.common import Blocks, Cells, Problem, argmax, score_matrix, softmax, with_outputs
from gridwright.session import checkpoint

# -- boosting by re-weighting ---------------------------------------------------------------

# Quantiles tried as thresholds of a column (parameter ``cut_points``).
BOOST_BINS = 64
# Rounds between two writings of the row weights.
RENEWED = 5


def _cut_points(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    grid = [i / bins for i in range(1, bins)]
    row = df.agg(*[
        F.percentile_approx(col(c).cast("double"), grid, 50 * bins).alias(str(i)) for i, c in enumerate(features)
    ]).first()
    return [np.array(sorted(set(row[i] or []))) for i in range(len(features))]


def _grow(data: Blocks | Cells, cuts: list[np.ndarray], weighed, depth: int, classes: int) -> dict:
    """One weighted histogram tree; a pass over the data per level.

    ``weighed`` gives for a block of ``data`` the bins (numbers of the cuts below a value) of its rows or cells and what is
    added up of each: weights by class, or (``classes`` is 0: a regression tree) weights and weighted labels and squares.
    Trees are arrays indexed by node.
    """
    p = len(cuts)
    wide = max(len(c) for c in cuts) + 1
    stats = classes or 3
    tree = {"feature": np.array([-1]), "threshold": np.array([0.0]), "left": np.array([-1]),
            "right": np.array([-1]), "value": [None], "weight": [None], "gains": np.zeros(p)}
    live = [0]
    for _ in range(depth):
        place = np.full(len(tree["feature"]), -1)
        place[live] = np.arange(len(live))
        shape = (len(live), p, wide, stats)
        frozen = {k: tree[k] for k in ("feature", "threshold", "left", "right")}

        def part(z) -> np.ndarray:
            x, values = weighed(z)
            slot = place[_descend(x, frozen)]
            rows = slot >= 0
            out = np.zeros((shape[0] * p * wide, stats))
            for j in range(p):
                cell = (slot[rows] * p + j) * wide + x[rows, j].astype(np.int64)
                for k in range(stats):
                    out[:, k] += np.bincount(cell, values[rows, k], len(out))
            return out.ravel()

        sums = data.sum(int(np.prod(shape)), part).reshape(shape)
        following = []
        for i, node in enumerate(live):
            total = sums[i, 0].sum(axis=0)
            tree["value"][node], tree["weight"][node] = _leaf(total, bool(classes)), total
            left = np.cumsum(sums[i], axis=1)[:, :-1]
            gain = _gain(left, total, bool(classes))
            for j in range(p):  # a column with few cuts has no later candidates
                gain[j, len(cuts[j]):] = -np.inf
            j, cut = np.unravel_index(np.argmax(gain), gain.shape)
            if not gain[j, cut] > 1e-12 * max(1.0, float(np.abs(total).max())):
                continue
            kids = [len(tree["feature"]), len(tree["feature"]) + 1]
            tree["gains"][j] += gain[j, cut]
            tree["feature"][node], tree["threshold"][node] = j, cut
            tree["left"][node], tree["right"][node] = kids
            for name, blank in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1)):
                tree[name] = np.append(tree[name], [blank, blank])
            for part_sums in (left[j, cut], total - left[j, cut]):
                tree["value"].append(_leaf(part_sums, bool(classes)))
                tree["weight"].append(part_sums)
            following += kids
        live = following
        if not live:
            break
    tree["output"] = np.array([float(np.argmax(v)) if classes else v[0] for v in tree["value"]])
    return tree


def _rules(tree: dict, node: int = 0) -> dict:
    """Arrays to nested rules, for scoring as a column expression."""
    if tree["feature"][node] < 0:
        return {"value": float(tree["output"][node])}
    return {"feature": int(tree["feature"][node]), "at": float(tree["threshold"][node]),
            "left": _rules(tree, int(tree["left"][node])), "right": _rules(tree, int(tree["right"][node]))}


def _tree_column(rules: dict, features: list[str]) -> Column:
    if "value" in rules:
        return F.lit(float(rules["value"]))
    test = col(features[rules["feature"]]).cast("double") <= F.lit(float(rules["at"]))
    return F.when(test, _tree_column(rules["left"], features)).otherwise(
        _tree_column(rules["right"], features))


def _values(rules: dict, x: np.ndarray) -> np.ndarray:
    """What nested rules say of every row."""
    if "value" in rules:
        return np.full(len(x), rules["value"])
    return np.where(x[:, rules["feature"]] <= rules["at"], _values(rules["left"], x), _values(rules["right"], x))


class BoostedRules(FittedStage):
    """Weighted vote (classes) or weighted median (numbers) of small trees."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        if not s["n_classes"]:
            rules, weights = s["trees"], np.array(s["weights"], dtype=float)

            def median(x: np.ndarray) -> np.ndarray:
                votes = np.column_stack([_values(t, x) for t in rules])
                order = np.argsort(votes, axis=1, kind="stable")
                # first prediction, in ascending order, at which half the weight is reached
                reached = np.cumsum(weights[order], axis=1)
                place = ((reached >= 0.5 * sum(s["weights"])) | np.isnan(reached)).argmax(axis=1)
                rows = np.arange(len(x))
                return votes[rows, order[rows, place]]

            return with_outputs(df, score_matrix(df, s["features"], median, nan_is_null=False), False)
        votes = [_tree_column(t, s["features"]) for t in s["trees"]]
        k = s["n_classes"]
        total = sum(s["weights"])
        names = [f"_v{i}" for i in range(len(votes))]
        staged = df.select(*[col(c) for c in df.columns], *[v.alias(n) for v, n in zip(votes, names)])
        scores = []
        for c in range(k):
            terms = [
                F.when(F.col(n) == float(c), F.lit(w / total)).otherwise(F.lit(-w / total / (k - 1)))
                for n, w in zip(names, s["weights"])
            ]
            scores.append(add_all(terms).alias(f"_d{c}"))
        staged = staged.select(*[col(c) for c in df.columns], *scores)
        cols = [F.col(f"_d{c}") for c in range(k)]
        if k == 2:
            margin = [(cols[0] - cols[1]) / 2, (cols[1] - cols[0]) / 2]
        else:
            margin = [c / (k - 1) for c in cols]
        return (
            staged.withColumn("prediction", argmax(cols)).withColumn("probability", softmax(margin))
            .drop(*[f"_d{c}" for c in range(k)])
        )


def ada_boost(df: DataFrame, problem: Problem, params: dict) -> BoostedRules:
    """SAMME for classes, R2 with linear loss for numbers.

    The logarithm of a row's weight is a column. Tasks add what the trees since it
    was written change, and every ``RENEWED`` rounds a reliable checkpoint writes
    it anew, so a round costs the same early and late. A round takes one pass
    (stumps) or four (depth-3 trees and their loss). For classes, rows of the same
    bins and class always weigh the same: they are one row that weighs as many. For
    numbers, rows of the same bins are stored as a cell: trees are walked and bins
    are added up once a cell, and only weights and losses are worked out by row.
    """
    rounds = int(params.get("n_estimators", 50))
    rate = float(params.get("learning_rate", 1.0))
    k = problem.n_classes if problem.is_classification else 0
    p = len(problem.features)
    columns = [f"c{i}" for i in range(p + 2)]
    cuts = _cut_points(df, problem.features, int(params.get("cut_points", BOOST_BINS)))
    trees: list[dict] = []
    weights: list[float] = []
    tops: list[float] = []
    offset, written = 0.0, 0  # of the logarithms; the trees that the column holds

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.searchsorted(cut, b.column(j).to_numpy(zero_copy_only=False), side="left") for j, cut in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.float64)) for c in codes), *b.columns[p:]], columns)

    rows = df.select(*[col(c).cast("double").alias(n) for c, n in zip([*problem.features, problem.label], columns)], F.lit(0.0).alias(columns[-1]))
    if k:
        rows = rows.mapInArrow(binned, rows.schema)
        rows = checkpoint(rows.groupBy(*columns[:-1]).agg(F.ln(F.count("*").cast("double")).alias(columns[-1])))
        data = Blocks(rows, columns)
    else:
        data = Cells(rows, columns[:p], cuts, [columns[p + 1], columns[p]], rows.count())

    def class_logs(z: np.ndarray) -> np.ndarray:
        x, y, log = z[:, :p], z[:, p], z[:, p + 1].copy()
        for t, weight in list(zip(trees, weights))[written:]:
            log += weight * (t["output"][_descend(x, t)] != y)
        return log

    def weighed_classes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return z[:, :p], np.eye(k)[z[:, p].astype(int)] * np.exp(class_logs(z) - offset)[:, None]

    def logs(codes: np.ndarray, n: np.ndarray, values: np.ndarray) -> np.ndarray:
        log, y = values[0].copy(), values[1]
        for t, weight, top in list(zip(trees, weights, tops))[written:]:
            log += (weight / top) * np.abs(y - np.repeat(t["output"][_descend(codes.T, t)], n)) - weight
        return log

    def weighed_numbers(z: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, n, values = z
        w, y, start = np.exp(logs(*z)), values[1], np.cumsum(n) - n
        wy = w * y
        return codes.T, np.column_stack([np.add.reduceat(s, start) for s in (w, wy, wy * y)])

    for number in range(rounds):
        if number and number % RENEWED == 0:
            data, written = data.renewed(class_logs if k else logs), number
        tree = _grow(data, cuts, weighed_classes if k else weighed_numbers, 1 if k else 3, k)
        if k:
            leaves = [w for w, f in zip(tree["weight"], tree["feature"]) if f < 0]
            total = float(sum(w.sum() for w in leaves))
            error = float(sum(w.sum() - w.max() for w in leaves)) / total
            if error <= 1e-12:
                trees, weights = [*trees, tree], [*weights, 1.0]
                break
            if error >= 1 - 1 / k:
                break
            alpha, top = rate * (math.log((1 - error) / error) + math.log(k - 1)), 0.0
            offset += math.log(total * (1 - error + error * math.exp(alpha)) / total)
        else:
            def loss(z: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
                codes, n, values = z
                gap, w = np.abs(values[1] - np.repeat(tree["output"][_descend(codes.T, tree)], n)), np.exp(logs(*z))
                return np.array([(w * gap).sum(), w.sum(), gap.max()])

            lost, total, top = data.sum(3, loss, largest=1)
            error = lost / total / top if top > 0 else 0.0
            if error <= 1e-12:
                trees, weights, tops = [*trees, tree], [*weights, 1.0], [*tops, 1.0]
                break
            if error >= 0.5:
                if not trees:
                    trees, weights, tops = [tree], [1.0], [1.0]
                break
            alpha = rate * math.log((1 - error) / error)
        trees, weights, tops = [*trees, tree], [*weights, alpha], [*tops, top]
    if not trees:
        raise ValueError("no tree does better than chance")
    drops = sum((w * np.array(_shares(t["gains"])) for t, w in zip(trees, weights)), np.zeros(p))
    for t in trees:  # back from bins to values
        inner = np.flatnonzero(t["feature"] >= 0)
        t["threshold"][inner] = [cuts[t["feature"][i]][int(t["threshold"][i])] for i in inner]
    return BoostedRules({"features": problem.features, "trees": [_rules(t) for t in trees],
                         "weights": weights, "n_classes": k, "importances": _shares(drops)})


def _shares(gains: np.ndarray) -> list[float]:
    return (gains / gains.sum() if gains.sum() > 0 else gains).tolist()


def _descend(x: np.ndarray, tree: dict) -> np.ndarray:
    """Node of every row in a partly grown tree."""
    node = np.zeros(len(x), dtype="int64")
    rows = np.arange(len(x))
    while len(rows):
        at = node[rows]
        rows = rows[tree["feature"][at] >= 0]
        at = node[rows]
        left = x[rows, tree["feature"][at]] <= tree["threshold"][at]
        node[rows] = np.where(left, tree["left"][at], tree["right"][at])
    return node


def _leaf(total: np.ndarray, classification: bool) -> list[float]:
    if classification:
        return (total / max(total.sum(), 1e-300)).tolist()
    return [float(total[1] / max(total[0], 1e-300))]


def _gain(left: np.ndarray, total: np.ndarray, classification: bool) -> np.ndarray:
    """Impurity drop (gini or variance), weighted by rows."""
    right = total - left

    def impurity(s: np.ndarray) -> np.ndarray:
        if classification:
            n = np.maximum(s.sum(axis=-1), 1e-300)
            return n - (s * s).sum(axis=-1) / n
        n = np.maximum(s[..., 0], 1e-300)
        return s[..., 2] - s[..., 1] ** 2 / n

    drop = impurity(total) - impurity(left) - impurity(right)
    size = (lambda s: s.sum(axis=-1)) if classification else (lambda s: s[..., 0])
    return np.where((size(left) > 0) & (size(right) > 0), drop, -np.inf)


def importances(model, features: list[str]) -> tuple[str, list[float]] | None:
    """Tree importances (shares of the impurity drops) or coefficients (mean absolute value over classes)."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    for stage in stages:
        if isinstance(stage, FittedStage):
            s = stage.state
            if "coef" in s:
                c = np.array(s["coef"])
                return "coefficients", (c[0] if len(c) == 1 and s["kind"] == "regression"
                                        else np.abs(c).mean(axis=0)).tolist()
            if "importances" in s:
                return "feature_importances", s["importances"]
            continue
        if hasattr(stage, "featureImportances"):
            return "feature_importances", stage.featureImportances.toArray().tolist()
        if hasattr(stage, "coefficientMatrix"):
            return "coefficients", np.abs(stage.coefficientMatrix.toArray()).mean(axis=0).tolist()
        if hasattr(stage, "coefficients"):
            return "coefficients", stage.coefficients.toArray().tolist()
        if hasattr(stage, "models"):
            parts = [importances(m, features) for m in (PipelineModel([m]) for m in stage.models)]
            if parts and parts[0]:
                return parts[0][0], np.mean([np.abs(v) for _, v in parts], axis=0).tolist()
    return None
