"""Feature scores and selection, principal components, generated features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, as_double, col, numeric_columns, ratio
from gridwright.functions.ordered import quantiles
from gridwright.operators.gram import gram

MI_BINS = 10
POLYNOMIAL_COLUMNS = 5
INTERACTION_COLUMNS = 6


def _scores_frame(df: DataFrame, scores: DataFrame, features: Sequence[str]) -> DataFrame:
    names = df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(features)], "feature string, position int")
    return names.join(scores, "feature", "left").select("feature", "position", "score")


def _bin(df: DataFrame, column: str, cuts: Sequence[float | None]) -> Column:
    """Number of cut points below the value (right-closed quantile bins)."""
    x = as_double(df, column)
    edges = sorted({c for c in cuts if c is not None})
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), add_all([F.when(x > e, 1).otherwise(0) for e in edges]))


def mutual_information(df: DataFrame, features: Sequence[str], target: str,
                       task: str = "classification", bins: int = MI_BINS) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with the target.

    One unpivot and one contingency count for all features; a regression target
    is binned the same way.
    """
    features = list(features)
    probs = [i / bins for i in range(1, bins)]
    numeric_target = task == "regression"
    cuts = quantiles(df, [*features, *([target] if numeric_target else [])], probs)
    y = _bin(df, target, cuts[target]) if numeric_target else col(target).cast("string")
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), _bin(df, c, cuts[c]).alias("x")) for c in features
    ])
    table = (
        df.select(y.alias("y"), F.inline(cells)).filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("feature", "x", "y").agg(F.count("*").cast("double").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("feature"))
    nx = F.sum("n").over(Window.partitionBy("feature", "x"))
    ny = F.sum("n").over(Window.partitionBy("feature", "y"))
    parts = table.select("feature", (F.col("n") / total * F.ln(F.col("n") * total / (nx * ny))).alias("t"))
    scores = parts.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("score"))
    return _scores_frame(df, scores, features)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature from one group-by over the classes."""
    features = list(features)
    per_class = df.filter(col(label).isNotNull()).groupBy(col(label).alias("_y")).agg(
        F.count("*").alias("_n"),
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.var_pop(as_double(df, c)).alias(f"v{i}") for i, c in enumerate(features)],
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(features)
    ])
    long = per_class.select(F.col("_n").cast("double").alias("n"), F.inline(cells))
    w = Window.partitionBy("feature")
    centred = long.withColumn("all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    sums = centred.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("all")) * (F.col("m") - F.col("all"))).alias("between"),
    )
    score = ratio(
        ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k")))
    return _scores_frame(df, sums.select("feature", score.alias("score")), features)


def regression_f(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F of a univariate regression: r^2 / (1 - r^2) * (n - 2)."""
    features = list(features)
    y = as_double(df, target)
    aggs = []
    for i, c in enumerate(features):
        x = as_double(df, c)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggs += [F.try_divide(F.covar_pop(x, y), spread).alias(f"r{i}"),
                 F.count(F.when(x.isNotNull(), y)).alias(f"n{i}")]
    one = df.agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(features)
    ])
    r2 = F.col("r") * F.col("r")
    scores = one.select(F.inline(cells)).select(
        "feature", (ratio(r2, 1 - r2) * (F.col("n") - 2)).alias("score"))
    return _scores_frame(df, scores, features)


def forest_importance(df: DataFrame, features: Sequence[str], label: str,
                      task: str = "classification", trees: int = 50, seed: int = 42,
                      depth: int = 30) -> DataFrame:
    """Mean impurity drops of a forest; ``depth`` 30 is as deep as the library grows."""
    features = list(features)
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(
        df.select(*[as_double(df, c).alias(c) for c in features], col(label).cast("double").alias("_y")))
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    model = kind(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    rows = [(c, i, float(v)) for i, (c, v) in enumerate(zip(features, model.featureImportances.toArray()))]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, score double")


def feature_scores(df: DataFrame, features: Sequence[str], label: str,
                   task: str = "classification", method: str = "mutual_info") -> DataFrame:
    if method == "f_test":
        score = anova_f if task == "classification" else regression_f
        return score(df, features, label)
    if method == "random_forest":
        return forest_importance(df, features, label, task)
    return mutual_information(df, features, label, task)


def select_features(df: DataFrame, features: Sequence[str], label: str, task: str = "classification",
                    method: str = "mutual_info", k: int = 10) -> DataFrame:
    """(feature, score, rank, selected); everything is kept when k >= columns.

    The forest keeps features at or above the mean importance, at most k.
    """
    features = list(features)
    if k >= len(features):
        rows = [(c, i, None) for i, c in enumerate(features)]
        scores = df.sparkSession.createDataFrame(rows, "feature string, position int, score double")
        return scores.select("feature", "position", "score",
                             (F.col("position") + 1).cast("long").alias("rank"),
                             F.lit(True).alias("selected"))
    scores = feature_scores(df, features, label, task, method)
    # one row per feature: ordering them in one task is bounded by the schema
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.desc_nulls_last("score"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    keep = F.col("rank") <= k
    if method == "random_forest":
        keep = keep & (F.col("score") >= F.avg("score").over(everything))
    return ranked.select("feature", "position", "score", "rank", keep.alias("selected"))


def keep_selected(df: DataFrame, features: Sequence[str], selection: DataFrame) -> DataFrame:
    """Drop the features that were not selected; the order of columns stays."""
    chosen = {r["feature"] for r in selection.filter("selected").select("feature").collect()}
    return df.drop(*[col(c) for c in features if c not in chosen])


class Components:
    """Fitted principal components: means, loadings and explained shares."""

    def __init__(self, columns: list[str], mean: np.ndarray, loadings: np.ndarray, share: np.ndarray):
        self.columns, self.mean, self.loadings, self.share = columns, mean, loadings, share

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = [col(c) for c in keep]
        for j in range(self.loadings.shape[1]):
            terms = [
                (as_double(df, c) - F.lit(float(m))) * F.lit(float(b))
                for c, m, b in zip(self.columns, self.mean, self.loadings[:, j])
            ]
            out.append(add_all(terms).alias(f"PC{j + 1}"))
        return df.select(*out)

    def explained(self, spark) -> DataFrame:
        total = np.cumsum(self.share)
        rows = [(f"PC{i + 1}", float(s), float(t)) for i, (s, t) in enumerate(zip(self.share, total))]
        return spark.createDataFrame(
            rows, "component string, explained_variance_ratio double, cumulative_variance double")


def pca(df: DataFrame, columns: Sequence[str] | None = None, n_components: int = 5) -> Components:
    """Principal components from one cross-product pass (centred, unscaled).

    The largest loading of every component is positive.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    g = gram(df, columns)
    values, vectors = np.linalg.eigh(g.scatter)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    n = int(min(n_components, len(columns), g.n))
    vectors = vectors[:, :n]
    for j in range(n):
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] = -vectors[:, j]
    total = values.sum()
    return Components(columns, g.mean, vectors, values[:n] / total if total > 0 else values[:n])


def polynomial_features(df: DataFrame, degree: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """All monomials up to ``degree``; the other columns come first."""
    columns = list(columns) if columns else numeric_columns(df)[:POLYNOMIAL_COLUMNS]
    out = [col(c) for c in df.columns if c not in columns]
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            product = as_double(df, combo[0])
            for c in combo[1:]:
                product = product * as_double(df, c)
            parts = []
            for c in dict.fromkeys(combo):
                times = combo.count(c)
                parts.append(c if times == 1 else f"{c}^{times}")
            out.append(product.alias(" ".join(parts)))
    return df.select(*out)


def interaction_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise products and ratios; a ratio over 0 is 0, over NULL is NULL."""
    columns = list(columns) if columns else numeric_columns(df)[:INTERACTION_COLUMNS]
    out = [col(c) for c in df.columns]
    for a, b in combinations(columns, 2):
        x, y = as_double(df, a), as_double(df, b)
        out.append((x * y).alias(f"{a}_x_{b}"))
        out.append(F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, y)).alias(f"{a}_div_{b}"))
    return df.select(*out)
