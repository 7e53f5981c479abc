"""Metrics of predictions as DataFrames.

Classification metrics are projections of two aggregates: confusion counts (one
row per actual/predicted pair) and the score frame (one row per distinct score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, col, r, ratio
from gridwright.functions.ordered import running_totals

# Smallest relative spacing of doubles: floor of |y| and clip of probabilities.
EPS = 2.220446049250313e-16


# -- from the confusion counts ---------------------------------------------------

def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(col(label).alias("actual"), col(prediction).alias("predicted")).agg(
        F.count("*").alias("n"))


def _classes(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("actual").alias("class")).union(
        counts.select(F.col("predicted").alias("class"))).distinct()


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Every actual x predicted cell of the sorted union of labels, zeros included."""
    cells = counts.agg(
        F.array_sort(F.array_distinct(F.concat(F.collect_set("actual"), F.collect_set("predicted")))).alias("k")
    )
    grid = cells.select(F.explode("k").alias("actual"), "k").select("actual", F.explode("k").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """One row per class: support, predicted count, hits, precision, recall, f1."""
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"),
                 F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")),
    )))
    sums = sides.groupBy("class").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    return sums.select(
        "class", "support", "predicted", "hits",
        ratio(F.col("hits"), F.col("predicted"), 0).alias("precision"),
        ratio(F.col("hits"), F.col("support"), 0).alias("recall"),
        ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("support"), 0).alias("f1"),
    )


def confusion_scores(counts: DataFrame) -> DataFrame:
    """One row: accuracy, f1, precision, recall, MCC and kappa."""
    s = F.sum("support").cast("double")
    c = F.sum("hits").cast("double")
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))

    def weighted(m: str) -> Column:
        return F.coalesce(ratio(F.sum(F.col(m) * F.col("support")), s), F.lit(0.0))

    expected = pt / (s * s)
    return per_class(counts).agg(
        (c / s).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        ratio(c * s - pt, F.sqrt((s * s - pp)) * F.sqrt(s * s - tt), 0).alias("mcc"),
        ratio(c / s - expected, 1 - expected, 0).alias("cohen_kappa"),
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Report rounding of every double column."""
    return df.select(*[r(col(n), digits).alias(n) if t == "double" else col(n) for n, t in df.dtypes])


def class_report(counts: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages."""
    rows = per_class(counts)
    base = rows.select(
        F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    s = F.sum("support")

    def weighted(m: str) -> Column:
        return ratio(F.sum(F.col(m) * F.col("support")), s)

    accuracy = ratio(F.sum("hits"), s)
    summary = rows.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1"), s.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), s.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                 weighted("recall").alias("recall"), weighted("f1").alias("f1"), s.alias("support")),
    ).alias("rows")).select(F.inline("rows"))
    return rounded(base.unionByName(summary))


# -- from the score frame ----------------------------------------------------------

def score_frame(df: DataFrame, positive: Column, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores in descending order with cumulative hits and misses.

    Rows are first combined per score, so ties cost nothing; the running totals
    come from ``running_totals``, which never orders the whole frame in one task.
    """
    g = [col(x) for x in groups]
    hit = F.when(positive, 1).otherwise(0).cast("long")
    per_score = df.groupBy(*g, col(score).cast("double").alias("threshold")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    return running_totals(per_score, "threshold", ["pos", "neg"], groups)


def ranking_scores(frame: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (average ranks on ties) and step-wise average precision."""
    above = F.col("cum_pos") - F.col("pos")
    area = F.col("neg").cast("double") * (above + F.col("pos") / 2.0)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    g = [col(x) for x in groups]
    return frame.groupBy(*g).agg(
        ratio(F.sum(area), F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("roc_auc"),
        ratio(F.sum(F.col("pos") * precision), F.max("total_pos")).alias("avg_precision"),
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
    )


def one_vs_rest_rows(df: DataFrame, label: str, probability: str, classes: Sequence[float]) -> DataFrame:
    """(class, hit, p): one row per input row and class, from an array column."""
    values = F.array(*[
        F.struct(F.lit(float(c)).alias("class"), F.col(probability)[i].alias("p"))
        for i, c in enumerate(classes)
    ])
    return df.select(col(label).cast("double").alias("label"), F.inline(values)).select(
        "class", (F.col("label") == F.col("class")).alias("hit"), "p")


def roc_auc_ovr(df: DataFrame, label: str, probability: str, classes: Sequence[float]) -> DataFrame:
    """One-vs-rest AUC weighted by class share."""
    long = one_vs_rest_rows(df, label, probability, classes)
    per = ranking_scores(score_frame(long, F.col("hit"), "p", ["class"]), ["class"])
    return per.agg(
        ratio(F.sum(F.col("roc_auc") * F.col("n_pos")), F.sum("n_pos")).alias("roc_auc_ovr"))


def log_loss_of(p_true: Column) -> Column:
    clipped = F.greatest(F.least(p_true, F.lit(1 - EPS)), F.lit(EPS))
    return F.avg(-F.ln(clipped))


def binary_log_loss(label: str, score: str) -> Column:
    p = F.when(col(label) == 1, col(score)).otherwise(1 - col(score))
    return log_loss_of(p)


def multiclass_log_loss(label: str, probability: str, classes: Sequence[float]) -> Column:
    total = add_all([F.col(probability)[i] for i in range(len(classes))])
    p = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        p = F.when(col(label) == float(c), F.col(probability)[i] / total).otherwise(p)
    return log_loss_of(p)


def brier(label: str, score: str) -> Column:
    gap = col(score) - F.when(col(label) == 1, 1.0).otherwise(0.0)
    return F.avg(gap * gap)


def classification_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str | None = None,
    probability: str | None = None,
    classes: Sequence[float] | None = None,
) -> DataFrame:
    """All metrics in one row. ``score`` is the probability of class 1 of a binary
    model; ``probability`` an array over ``classes`` of a multiclass model. Without
    either, the probability metrics are left out."""
    out = confusion_scores(confusion_counts(df, label, prediction))
    if score:
        ranks = ranking_scores(score_frame(df, col(label) == 1, score)).select("roc_auc", "avg_precision")
        points = df.agg(binary_log_loss(label, score).alias("log_loss"), brier(label, score).alias("brier_score"))
        out = _one_row(out, ranks, points)
    elif probability:
        points = df.agg(multiclass_log_loss(label, probability, classes).alias("log_loss"))
        out = _one_row(out, roc_auc_ovr(df, label, probability, classes), points)
    return rounded(out)


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side through a union and one tiny aggregate."""
    names = [c for f in frames for c in f.columns]
    parts = [
        f.select(*[(col(c) if c in f.columns else F.lit(None).cast("double")).alias(c) for c in names])
        for f in frames
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.agg(*[F.max(c).alias(c) for c in names])


# -- regression ----------------------------------------------------------------------

def regression_aggregates(label: str = "label", prediction: str = "prediction",
                          n_features: int | None = None) -> dict[str, Column]:
    """Aggregate expressions by name; all fit into one ``agg``."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    n = F.count(y).cast("double")
    r2 = 1 - ratio(F.sum(e * e), n * F.var_pop(y))
    out = {
        "r2": r2,
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "explained_variance": 1 - ratio(F.var_pop(e), F.var_pop(y)),
        "mape": 100 * F.avg(F.abs(e / (y + F.lit(1e-8)))),
        "mape_floor": 100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))),
        "residuals_mean": F.avg(e),
        "residuals_std": F.stddev_pop(e),
    }
    if n_features is not None:
        free = n - n_features - 1
        out["adjusted_r2"] = F.when(free > 0, 1 - (1 - r2) * (n - 1) / F.nullif(free, F.lit(0.0))).otherwise(r2)
    return out


REPORT = ("r2", "adjusted_r2", "rmse", "mae", "mse", "explained_variance", "mape",
          "residuals_mean", "residuals_std")


def regression_report(df: DataFrame, n_features: int, label: str = "label",
                      prediction: str = "prediction", names: Sequence[str] = REPORT) -> DataFrame:
    aggs = regression_aggregates(label, prediction, n_features)
    return rounded(df.agg(*[aggs[n].alias(n) for n in names]))


def quick_metrics(df: DataFrame, task: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    if task == "classification":
        return rounded(confusion_scores(confusion_counts(df, label, prediction)).select("accuracy", "f1_weighted"))
    return regression_report(df, 0, label, prediction, ("r2", "rmse"))
