"""Model selection: split, search with k folds, rank, keep the winner."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import as_double, col
from gridwright.models.common import Problem
from gridwright.models.linear import gram_loss
from gridwright.operators import metrics as M
from gridwright.operators.gram import grams
from gridwright.operators.preprocess import dictionary, encode
from gridwright.operators.profile import detect_task
from gridwright.operators.splits import folds, holdout, nested_samples
from gridwright.plans.registry import Algorithm, algorithms
from gridwright.session import checkpoint, spread

# More classes than this cannot be a classification target.
CLASS_CAP = 10_000
LABEL = "label"
FAILED = -999.0
TOP_COMPARED = 12

LEADERBOARD = (
    "name string, category string, cv_mean double, cv_std double, cv_scores array<double>, "
    "best_params map<string,string>, training_time double, accuracy double, f1_weighted double, "
    "precision double, recall double, roc_auc double, r2 double, rmse double, mae double, "
    "mse double, mape double, explained_variance double, error string, position int, "
    "confusion_matrix array<struct<actual:double,predicted:double,n:bigint>>, "
    "classification_report array<struct<class:string,precision:double,recall:double,f1:double,support:bigint>>"
)


# -- scorers ------------------------------------------------------------------------------

def score(df: DataFrame, scoring: str, problem: Problem) -> float | None:
    """One number, larger is better."""
    regression = {
        "r2": ("r2", 1), "explained_variance": ("explained_variance", 1),
        "neg_mean_squared_error": ("mse", -1), "neg_root_mean_squared_error": ("rmse", -1),
        "neg_mean_absolute_error": ("mae", -1), "neg_mean_absolute_percentage_error": ("mape_floor", -0.01),
    }
    if scoring in regression:
        name, sign = regression[scoring]
        value = df.agg(M.regression_aggregates(LABEL)[name]).first()[0]
        return None if value is None else sign * value
    confusion = {"accuracy": "accuracy", "f1_weighted": "f1_weighted", "f1_macro": "f1_macro",
                 "precision_weighted": "precision_weighted", "recall_weighted": "recall_weighted",
                 "matthews_corrcoef": "mcc"}
    if scoring in confusion:
        return M.confusion_scores(M.confusion_counts(df, LABEL)).first()[confusion[scoring]]
    if scoring == "neg_log_loss":
        return -df.agg(M.multiclass_log_loss(LABEL, "probability", problem.classes)).first()[0]
    if scoring == "roc_auc" and problem.n_classes == 2:
        staged = df.withColumn("_p", F.col("probability")[1])
        return M.ranking_scores(M.score_frame(staged, col(LABEL) == 1, "_p")).first()["roc_auc"]
    if scoring in ("roc_auc", "roc_auc_ovr_weighted"):
        return M.roc_auc_ovr(df, LABEL, "probability", problem.classes).first()[0]
    raise ValueError(f"unknown scoring {scoring!r}")


# -- search ----------------------------------------------------------------------------------

def cross_validate(df: DataFrame, problem: Problem, fit: Callable, params: dict, k: int, scoring: str,
                   fold: str = "fold", parallelism: int = 4) -> list[float]:
    """Score on each fold of a model fitted on the other folds."""
    def one(f: int) -> float:
        model = fit(df.filter(F.col(fold) != f), problem, params)
        return score(model.transform(df.filter(F.col(fold) == f)), scoring, problem)

    return _spread(one, range(k), parallelism)


def _spread(fn: Callable, items, parallelism: int) -> list:
    """Run independent Spark actions from a few driver threads, in input order."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.getActiveSession())(fn), items))


GRAM_SCORES = {
    "r2": lambda mse, r2: r2,
    "neg_mean_squared_error": lambda mse, r2: -mse,
    "neg_root_mean_squared_error": lambda mse, r2: -float(np.sqrt(mse)),
}


def search(df: DataFrame, problem: Problem, algorithm: Algorithm, points: Sequence[dict], k: int,
           scoring: str, parallelism: int = 4) -> tuple[dict, list[float]]:
    """Best grid point by mean fold score (the first on ties) and its fold scores.

    Least-squares models need one pass for the whole search: the cross products
    per fold give every fit and every score. Others are fitted point by point and
    fold by fold, a few at a time; each fit is itself a distributed job.
    """
    if algorithm.solve and scoring in GRAM_SCORES:
        parts = grams(df, [*problem.features, problem.label], "fold")
        whole = parts[0]
        for f in range(1, k):
            whole = whole + parts[f]
        results = [
            [GRAM_SCORES[scoring](*gram_loss(parts[f], *algorithm.solve(whole - parts[f], point)))
             for f in range(k)]
            for point in points
        ]
    else:
        def run(job: tuple[int, int]) -> float:
            point, f = points[job[0]], job[1]
            model = algorithm.fit(df.filter(F.col("fold") != f), problem, point)
            return score(model.transform(df.filter(F.col("fold") == f)), scoring, problem)

        # points that differ only in what the algorithm doesn't use are fitted once
        seen: dict[str, int] = {}
        first = [seen.setdefault(repr(algorithm.used(p)), i) for i, p in enumerate(points)]
        jobs = [(i, f) for i in sorted(set(first)) for f in range(k)]
        done = dict(zip(jobs, _spread(run, jobs, parallelism)))
        results = [[done[i, f] for f in range(k)] for i in first]
    best = int(np.argmax([np.mean(x) for x in results]))
    return points[best], results[best]


@dataclass
class TrainingOptions:
    task_type: str = "auto"
    test_size: float = 0.2
    cv_folds: int = 5
    tune_hyperparams: bool = True
    tuning_method: str = "random"
    n_iter: int = 10
    scoring: str | None = None
    selected_algorithms: list[str] | None = None
    parallelism: int = 4
    # fixed settings that override grid values, per algorithm
    overrides: dict[str, dict] = field(default_factory=dict)


@dataclass
class Training:
    """Everything a finished run leaves behind."""

    task: str
    problem: Problem
    labels: list[str] | None
    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    leaderboard: DataFrame
    models: dict[str, object]
    best_name: str | None

    @property
    def best_model(self):
        if self.best_name is None:
            raise ValueError("no model has been trained")
        return self.models[self.best_name]

    def summary(self) -> DataFrame:
        spark = self.train.sparkSession
        row = (self.task, self.n_train, self.n_test, len(self.problem.features),
               len(self.models), self.best_name)
        return spark.createDataFrame(
            [row], "task_type string, n_train long, n_test long, n_features long, "
                   "n_algorithms long, best_model string")

    def save(self, path: str) -> str:
        """Winner, its name, task, features and labels below one folder."""
        spark = self.train.sparkSession
        self.best_model.write().overwrite().save(os.path.join(path, "model"))
        facts = {"name": self.best_name, "task_type": self.task, "features": self.problem.features,
                 "labels": self.labels, "n_classes": self.problem.n_classes}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
            "overwrite").text(os.path.join(path, "facts"))
        return path


def label_frame(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str] | None]:
    """Add the numeric ``label``; classes become codes in ascending order."""
    if task != "classification":
        return df.withColumn(LABEL, as_double(df, target)), None
    kind = df.schema[target].dataType.simpleString()
    numeric = kind not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")
    if numeric:
        rows = df.select(as_double(df, target).alias("v")).filter("v IS NOT NULL").distinct().orderBy("v")
        values = [r["v"] for r in rows.limit(CLASS_CAP + 1).collect()]
        if len(values) > CLASS_CAP:
            raise ValueError(f"{target} has more than {CLASS_CAP} classes")
        codes = df.sparkSession.createDataFrame(
            [(v, float(i)) for i, v in enumerate(values)], "_v double, _code double")
        out = df.withColumn("_v", as_double(df, target)).join(F.broadcast(codes), "_v", "left")
        names = [str(int(v)) if float(v).is_integer() else str(v) for v in values]
        return out.withColumn(LABEL, F.col("_code")).drop("_v", "_code"), names
    codes = checkpoint(dictionary(df, target))
    n = codes.count()
    if n > CLASS_CAP:
        raise ValueError(f"{target} has more than {CLASS_CAP} classes")
    names = [r["value"] for r in codes.orderBy("code").collect()]
    return encode(df.withColumn(LABEL, col(target)), LABEL, codes, "double"), names


def split(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str],
          options: TrainingOptions) -> tuple[Problem, list[str] | None, DataFrame, DataFrame]:
    task = detect_task(df, target) if options.task_type == "auto" else options.task_type
    labelled, labels = label_frame(df, target, task)
    narrow = labelled.filter(col(LABEL).isNotNull()).select(
        *[col(k) for k in keys], *[col(f).cast("double").alias(f) for f in features if f not in keys], LABEL)
    strata = LABEL if task == "classification" else None
    # written once: every fit of the search reads these columns again
    marked = checkpoint(holdout(narrow, keys, options.test_size, strata))
    # neighbours at equal distance go by these keys, whatever the layout of the rows
    problem = Problem(list(features), task, n_classes=len(labels) if labels else 0, settings={"key": list(keys)})
    train, test = marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test")
    train = spread(checkpoint(folds(train, keys, options.cv_folds, strata)))
    return problem, labels, train, test


def train(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str],
          options: TrainingOptions | None = None) -> Training:
    """Fit and rank the roster; a failing algorithm becomes a row with its error."""
    options = options or TrainingOptions()
    problem, labels, fit_rows, test_rows = split(df, target, features, keys, options)
    scoring = options.scoring or ("f1_weighted" if problem.is_classification else "r2")
    rows, models = [], {}
    for position, algorithm in enumerate(algorithms(problem.task, options.selected_algorithms)):
        started = time.time()
        try:
            row, model = _one(algorithm, problem, fit_rows, test_rows, scoring, options)
            models[algorithm.name] = model
        except Exception as error:  # noqa: BLE001 - one failure must not end the run
            row = {"cv_mean": FAILED, "error": str(error)}
        row.update(name=algorithm.name, category=algorithm.category, position=position)
        row.setdefault("training_time", round(time.time() - started, 3))
        rows.append(row)
    spark = df.sparkSession
    names = [c.strip().split(" ")[0] for c in _split_schema(LEADERBOARD)]
    board = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LEADERBOARD)
    first = rank_models(board, problem.task).first()
    return Training(problem.task, problem, labels, fit_rows, test_rows, fit_rows.count(), test_rows.count(),
                    board, models, first["name"] if first else None)


def _split_schema(text: str) -> list[str]:
    depth, out, part = 0, [], ""
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def _one(algorithm: Algorithm, problem: Problem, fit_rows: DataFrame, test_rows: DataFrame, scoring: str,
         options: TrainingOptions) -> tuple[dict, object]:
    started = time.time()
    k = options.cv_folds
    fixed = options.overrides.get(algorithm.name, {})
    if options.tune_hyperparams and algorithm.grid:
        points = algorithm.points() if options.tuning_method == "grid" else algorithm.sample(options.n_iter)
        unique = []
        for p in ({**p, **fixed} for p in points):
            if p not in unique:
                unique.append(p)
        best, scores = search(fit_rows, problem, algorithm, unique, k, scoring, options.parallelism)
    else:
        best = dict(fixed)
        _, scores = search(fit_rows, problem, algorithm, [best], k, scoring, options.parallelism)
    model = algorithm.fit(fit_rows, problem, best)
    scored = checkpoint(model.transform(test_rows))  # read by every metric below
    elapsed = round(time.time() - started, 3)
    row = {
        "cv_mean": round(float(np.mean(scores)), 4), "cv_std": round(float(np.std(scores)), 4),
        "cv_scores": [round(float(s), 4) for s in scores],
        "best_params": {a: str(b) for a, b in best.items()}, "training_time": elapsed,
        **test_metrics(scored, problem),
    }
    return row, model


def test_metrics(scored: DataFrame, problem: Problem) -> dict:
    if not problem.is_classification:
        names = ["r2", "rmse", "mae", "mse", "explained_variance", "mape_floor"]
        row = M.regression_report(scored, 0, LABEL, names=names).first().asDict()
        row["mape"] = row.pop("mape_floor")
        return row
    counts = checkpoint(M.confusion_counts(scored, LABEL))
    row = M.rounded(M.confusion_scores(counts)).first()
    out = {"accuracy": row["accuracy"], "f1_weighted": row["f1_weighted"],
           "precision": row["precision_weighted"], "recall": row["recall_weighted"],
           "confusion_matrix": [tuple(r) for r in M.confusion_matrix(counts).collect()],
           "classification_report": [tuple(r) for r in M.class_report(counts).collect()]}
    if "probability" in scored.columns:
        auc = score(scored, "roc_auc", problem)
        out["roc_auc"] = None if auc is None else round(auc, 4)
    return out


def rank_models(board: DataFrame, task: str) -> DataFrame:
    """Failed rows go; classes rank by fold score, numbers by test R^2."""
    metric = "cv_mean" if task == "classification" else "r2"
    return board.filter(F.col("error").isNull() & F.col(metric).isNotNull()).orderBy(
        F.desc(metric), "position")


def comparison(board: DataFrame, task: str) -> DataFrame:
    metric = "cv_mean" if task == "classification" else "r2"
    return rank_models(board, task).limit(TOP_COMPARED).select(
        "name", F.col(metric).alias("score"), "training_time")


def write_leaderboard(board: DataFrame, path: str) -> None:
    """CSV without the two nested reports; maps and arrays as JSON text."""
    out = board.drop("confusion_matrix", "classification_report", "position")
    nested = {n for n, t in out.dtypes if t.startswith(("map", "array", "struct"))}
    out.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in out.columns]).coalesce(
        1).write.mode("overwrite").option("header", True).csv(path)


def learning_curve(df: DataFrame, problem: Problem, fit: Callable, params: dict, keys: Sequence[str],
                   steps: int = 8, k: int = 5, scoring: str | None = None,
                   parallelism: int = 4) -> DataFrame:
    """Train and validation scores over growing nested samples of the training folds.

    A sample is a hash prefix per fold, so a larger one contains the smaller.
    """
    scoring = scoring or ("accuracy" if problem.is_classification else "r2")
    shares = np.linspace(0.1, 1.0, steps).tolist()
    if "fold" not in df.columns:
        df = folds(df, keys, k, problem.label if problem.is_classification else None)
    marked = spread(checkpoint(nested_samples(df, keys, shares[:-1], ["fold"], seed="curve")))
    def one(job: tuple[int, int]) -> tuple[int, float, float]:
        i, f = job
        part = marked.filter((F.col("step") <= i) & (F.col("fold") != f))
        model = fit(part, problem, params)
        return (part.count(), score(model.transform(part), scoring, problem),
                score(model.transform(marked.filter(F.col("fold") == f)), scoring, problem))

    jobs = [(i, f) for i in range(steps) for f in range(k)]
    done = np.array(_spread(one, jobs, parallelism)).reshape(steps, k, 3)
    rows = [
        (i, float(done[i, :, 0].mean()), float(done[i, :, 1].mean()), float(done[i, :, 1].std()),
         float(done[i, :, 2].mean()), float(done[i, :, 2].std()))
        for i in range(steps)
    ]
    return df.sparkSession.createDataFrame(
        rows, "step int, train_size double, train_mean double, train_std double, "
              "validation_mean double, validation_std double")
