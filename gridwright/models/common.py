"""What every fit function shares: the problem description, scoring stages and
the summed-gradient fitter.

A fit function takes (df, problem, params) and returns a transformer that adds
``prediction`` (double) and, if the model has them, ``probability`` (array of
doubles, one per class in class order).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, col
from gridwright.models.base import FittedStage
from gridwright.session import checkpoint

VECTOR = "_features"
#: Sums of so many tasks are added up by the driver; of more, a few tasks do it first.
FEW_TASKS = 32
#: Most rows and bytes of a block, bytes that a task reads, and rows that are worth a task of their own.
BLOCK_ROWS, BLOCK_BYTES, TASK_BYTES, LEAST_ROWS = 10_000, 4 << 20, 32 << 20, 10_000
#: Rows of a block of cells, rows that are binned or put in order of their cells at once, and bytes of rows a task.
CELL_ROWS, GATHERED_ROWS, CELL_TASK_BYTES = 32_768, 1 << 18, 32 << 20
#: Numbers of a mapped feature matrix that stay near the processor.
NEAR_NUMBERS = 1 << 16
#: Rows of the part on which a search of margins begins, and how often it is taken up there.
PART_ROWS, PART_SEARCHES = 131_072, 30


@dataclass
class Problem:
    """Numeric feature columns and a numeric label; classes are 0..k-1."""

    features: list[str]
    task: str
    n_classes: int = 2
    label: str = "label"
    seed: int = 42
    settings: dict = field(default_factory=dict)

    @property
    def classes(self) -> list[float]:
        return [float(i) for i in range(self.n_classes)]

    @property
    def is_classification(self) -> bool:
        return self.task == "classification"


# -- MLlib models ----------------------------------------------------------------------

class Finish(FittedStage):
    """Turn MLlib output columns into ``prediction`` and a ``probability`` array."""

    def _transform(self, df: DataFrame) -> DataFrame:
        kind = self.state["probability"]
        drop = [c for c in (VECTOR, "rawPrediction", "probability") if c in df.columns]
        kept = [col(c) for c in df.columns if c not in drop]
        if kind == "none":
            return df.select(*kept)
        if kind == "vector":
            return df.select(*kept, vector_to_array("probability").alias("probability"))
        raw = vector_to_array("rawPrediction")
        scale = float(self.state.get("scale", 1.0))
        share = F.transform(raw, lambda m: 1.0 / (1.0 + F.exp(-scale * m)))
        total = F.aggregate(share, F.lit(0.0), lambda a, b: a + b)
        return df.select(*kept, F.transform(share, lambda s: s / total).alias("probability"))


def fit_vector(estimator: Estimator, df: DataFrame, problem: Problem, probability: str = "none",
               scale: float = 1.0) -> PipelineModel:
    assembler = VectorAssembler(inputCols=problem.features, outputCol=VECTOR)
    estimator = estimator.copy({estimator.getParam("featuresCol"): VECTOR,
                                estimator.getParam("labelCol"): problem.label})
    fitted = Pipeline(stages=[assembler, estimator]).fit(df)
    return PipelineModel([*fitted.stages, Finish({"probability": probability, "scale": scale})])


# -- linear scores as column expressions ----------------------------------------------------

def linear_score(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    terms = [col(c).cast("double") * F.lit(float(b)) for c, b in zip(features, coef)]
    return add_all([F.lit(float(intercept)), *terms])


def argmax(scores: Sequence[Column]) -> Column:
    """Index of the largest score, the first on ties."""
    best = F.array(*scores)
    return (F.array_position(best, F.array_max(best)) - 1).cast("double")


def softmax(scores: Sequence[Column]) -> Column:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = add_all(parts)
    return F.array(*[p / total for p in parts])


class LinearScores(FittedStage):
    """One linear score (regression, two classes) or one per class."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        scores = [linear_score(s["features"], b, a) for b, a in zip(s["coef"], s["intercept"])]
        if s["kind"] == "regression":
            return df.withColumn("prediction", scores[0])
        if len(scores) == 1:
            out = df.withColumn("prediction", F.when(scores[0] > 0, 1.0).otherwise(0.0))
            if s["kind"] == "probability":
                p = 1.0 / (1.0 + F.exp(-scores[0]))
                out = out.withColumn("probability", F.array(1.0 - p, p))
            return out
        names = [f"_s{i}" for i in range(len(scores))]
        staged = df.select(*[col(c) for c in df.columns], *[x.alias(n) for x, n in zip(scores, names)])
        cols = [F.col(n) for n in names]
        out = staged.withColumn("prediction", argmax(cols))
        if s["kind"] == "probability":
            out = out.withColumn("probability", softmax(cols))
        elif s["kind"] == "sigmoid":
            parts = [1.0 / (1.0 + F.exp(-c)) for c in cols]
            total = add_all(parts)
            out = out.withColumn("probability", F.array(*[x / total for x in parts]))
        return out.drop(*names)


# -- numpy scoring of row batches -----------------------------------------------------------

def score_matrix(df: DataFrame, features: Sequence[str], fn: Callable[[np.ndarray], np.ndarray],
                 nan_is_null: bool = True) -> Column:
    """Column of arrays: ``fn`` maps a batch matrix to one row of numbers per row."""

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        flat = x.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
        out = np.asarray(fn(flat.reshape(len(x), len(features))), dtype="float64").reshape(len(x), -1)
        ends = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), from_pandas=nan_is_null))

    return score(F.array(*[col(c).cast("double") for c in features]))


def with_outputs(df: DataFrame, values: Column, classification: bool, probability: bool = True) -> DataFrame:
    """Outputs from one array column: class shares, or a single prediction."""
    staged = df.withColumn("_out", values)
    if not classification:
        return staged.withColumn("prediction", F.col("_out")[0]).drop("_out")
    staged = staged.withColumn(
        "prediction", (F.array_position("_out", F.array_max("_out")) - 1).cast("double"))
    return staged.withColumnRenamed("_out", "probability") if probability else staged.drop("_out")


# -- summed gradients -------------------------------------------------------------------------

def sum_over_rows(df: DataFrame, columns: Sequence[str], size: int,
                  fn: Callable[[np.ndarray], np.ndarray], largest: int = 0, tasks: int | None = None) -> np.ndarray:
    """Sum of a per-batch vector over all rows (its last ``largest`` cells: the maximum).

    Each task adds up its batches into one row; those are added up by a few
    tasks, so the driver receives a few rows however many tasks ran. Where the
    caller knows that there are but few ``tasks``, their rows come at once.
    """
    narrow = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def matrices(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        if b.num_rows:
            yield np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])

    return _summed(narrow, matrices, size, fn, largest, tasks)


def _summed(df: DataFrame, matrices: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int,
            fn: Callable[[np.ndarray], np.ndarray], largest: int, tasks: int | None) -> np.ndarray:
    plain = size - largest

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        total[plain:] = -np.inf
        rows = 0
        for b in batches:
            for z in matrices(b):
                rows += len(z)
                part = fn(z)
                total[:plain] += part[:plain]
                total[plain:] = np.maximum(total[plain:], part[plain:])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    partials = df.mapInArrow(partial, "v array<double>")
    if tasks is None or tasks > FEW_TASKS:
        partials = added_up(partials, plain)
    parts = [v.values.to_numpy() for v in partials.toArrow().column("v")]
    out = np.zeros(size)
    if parts:
        out[:plain] = np.sum([p[:plain] for p in parts], axis=0)
        out[plain:] = np.max([p[plain:] for p in parts], axis=0)
    return out


class Blocks:
    """Columns as doubles, written once as blocks of rows for many passes.

    A block is one binary value (the columns one after another), so a pass
    converts no single rows. Blocks are dealt to tasks of bounded size.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.width = len(columns)
        narrow = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * self.width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in gathered(batches, most):
                for at in range(0, t.num_rows, most):
                    z = np.stack([c.to_numpy() for c in t.slice(at, most).columns])
                    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["b"])

        n = narrow.count()
        cores = df.sparkSession.sparkContext.defaultParallelism
        self.tasks = min(n // min(most, LEAST_ROWS) + 1, max(cores, 8 * self.width * n // TASK_BYTES))
        self.data = checkpoint(narrow.mapInArrow(run, "b binary").repartition(self.tasks))

    def sum(self, size: int, fn: Callable[[np.ndarray], np.ndarray], largest: int = 0, rows: int = BLOCK_ROWS) -> np.ndarray:
        """``sum_over_rows`` of these columns; ``fn`` gets up to ``rows`` rows at once."""
        width = self.width

        def matrices(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            for one in b.column(0):
                z = np.frombuffer(one.as_buffer(), dtype=np.float64).reshape(width, -1).T
                for at in range(0, len(z), rows):
                    yield z[at:at + rows]

        return _summed(self.data, matrices, size, fn, largest, self.tasks)

    def renewed(self, fn: Callable[[np.ndarray], np.ndarray]) -> Blocks:
        """These blocks with what ``fn`` makes of their rows as the last column, written anew."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for one in b.column(0):
                    z = np.frombuffer(one.as_buffer(), dtype=np.float64).reshape(width, -1).copy()
                    z[-1] = fn(z.T)
                    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["b"])

        out = copy(self)
        out.data = checkpoint(self.data.mapInArrow(run, "b binary"))
        return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of at least so many rows, but for the last one."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            waiting.append(b)
        if sum(w.num_rows for w in waiting) >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of the bins [column, row] of each row."""
    z = np.zeros(codes.shape[1], dtype=np.uint64)
    for c in codes:
        z = (z ^ c) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    return z


class Cells:
    """Rows in order of their cells (the same bins of all columns), written once for many passes.

    A block has the bins of its cells (``b``, [column, cell]), the rows of each (``n``) and the columns ``kept`` of
    those rows (``v``, [column, row], 8 bytes each), so a pass works out what depends on bins only once a cell. The
    rows of a cell meet in one task, in blobs of many rows; a cell of very many rows comes in several pieces.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], kept: Sequence[str], rows: int,
                 missing: bool = False):
        p, k = len(features), len(kept)
        self.columns, self.kept = p, k
        cores = df.sparkSession.sparkContext.defaultParallelism
        self.tasks = parts = max(1, min(rows // LEAST_ROWS + 1, max(cores, rows * (2 * p + 8 * k) // CELL_TASK_BYTES)))
        most, at_once = CELL_ROWS, GATHERED_ROWS

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in gathered(batches, at_once):
                codes = np.empty((p, t.num_rows), dtype=np.uint16)
                for j, (c, edge) in enumerate(zip(features, edges)):
                    x = t.column(c).to_numpy()
                    codes[j] = np.searchsorted(edge, x, side="left")
                    if missing:
                        codes[j][np.isnan(x)] = len(edge) + 1
                values = np.stack([t.column(c).to_numpy().view(np.float64) for c in kept])
                part = (_hashed(codes) >> np.uint64(16)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
                codes, values = (np.stack([c[order] for c in z]) for z in (codes, values))
                found, counts = np.unique(part, return_counts=True)
                ends = np.cumsum(counts)
                blobs = [codes[:, a:b].tobytes() + values[:, a:b].tobytes() for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "v"])

        def ordered(blobs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            codes, values = (np.concatenate(x, axis=1) for x in zip(*blobs))
            # by the last column inside a cell: the order in which rows arrive changes nothing
            order = np.lexsort((values[-1].view(np.int64), _hashed(codes)))
            codes, values = (np.stack([c[order] for c in z]) for z in (codes, values))
            start = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])
            n = np.diff(np.append(start, len(order)))
            first = np.unique(np.searchsorted(start, np.arange(0, len(order), most)))  # the cells that begin a block
            first = np.append(first[first < len(start)], len(start))
            bounds = np.append(start, len(order))
            for a, b in zip(first[:-1], first[1:]):
                arrays = codes[:, start[a:b]], n[a:b], values[:, bounds[a]:bounds[b]]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["b", "n", "v"])

        def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for b in batches:
                for one in b.column("v"):
                    raw = np.frombuffer(one.as_buffer(), dtype=np.uint8)
                    m = len(raw) // (2 * p + 8 * k)
                    waiting.append((raw[: 2 * p * m].view(np.uint16).reshape(p, m), np.frombuffer(raw[2 * p * m:].tobytes()).reshape(k, m)))
                    held += m
                    if held >= 8 * at_once:
                        yield from ordered(waiting)
                        waiting, held = [], 0
            if waiting:
                yield from ordered(waiting)

        spread_out = df.mapInArrow(dealt, "part int, v binary").repartitionById(parts, F.col("part"))
        self.data = checkpoint(spread_out.mapInArrow(by_cell, "b binary, n binary, v binary"))

    def sum(self, size: int, fn: Callable[[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray], largest: int = 0) -> np.ndarray:
        """``sum_over_rows`` of the blocks: ``fn`` gets bins, rows of each cell and the rows."""
        columns, kept = self.columns, self.kept
        return _summed(self.data, lambda b: read_cells(b, columns, kept), size, fn, largest, self.tasks)

    def renewed(self, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Cells:
        """These blocks with what ``fn`` makes of them as the first column of their rows, written anew."""
        columns, kept = self.columns, self.kept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, (codes, n, values) in enumerate(read_cells(b, columns, kept)):
                    values = values.copy()
                    values[0] = fn(codes, n, values)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, 1) for c in ("b", "n")), pa.array([values.tobytes()], pa.binary())], ["b", "n", "v"])

        out = copy(self)
        out.data = checkpoint(self.data.mapInArrow(run, self.data.schema))
        return out


def read_cells(batch: pa.RecordBatch, columns: int, kept: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins of the cells, rows of each and the rows of every block in a batch."""
    for b, n, v in zip(*(batch.column(c) for c in ("b", "n", "v"))):
        yield (np.frombuffer(b.as_buffer(), dtype=np.uint16).reshape(columns, -1), np.frombuffer(n.as_buffer(), dtype=np.int64),
               np.frombuffer(v.as_buffer(), dtype=np.float64).reshape(kept, -1))


def added_up(partials: DataFrame, plain: int) -> DataFrame:
    """One row of sums (``v``; from cell ``plain`` on: maxima) a task of a few, from one row a task of many."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for one in b.column(0):
                v = one.values.to_numpy()
                if total is None:
                    total = v.copy()
                else:
                    total[:plain] += v[:plain]
                    total[plain:] = np.maximum(total[plain:], v[plain:])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    width = max(1, min(32, partials.sparkSession.sparkContext.defaultParallelism // 4))
    return partials.repartition(width).mapInArrow(add, "v array<double>")


def fit_margins(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    n_outputs: int,
    loss: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    l2: float,
    mapping: Callable[[np.ndarray], np.ndarray] | None = None,
    center: bool = False,
    max_iter: int = 1000,
    bend: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Minimise mean loss + l2/2 |W|^2 of linear margins, all outputs in each pass.

    ``loss(margins, y)`` gives per-row values and slopes, both (rows, outputs).
    ``mapping`` expands the raw features inside the task, so a wide explicit
    feature map is never stored. The search runs on standardised features with
    the penalty expressed in the original scale. Returns (coef, intercept).

    With ``bend`` (margins, y: the loss's second derivative of every row, averaged over
    some width where it jumps; one output), the search on a table of more than twice
    ``PART_ROWS`` rows begins where a search on about so many rows, made by one task, ended,
    with the curvature found there. It goes on with all rows until it stops by the same
    rule, so the part decides how many passes that takes, not where it ends.
    """
    p = len(features)
    expand = mapping or (lambda x: x)
    d = expand(np.zeros((1, p))).shape[1]
    data, few = Blocks(df, [*features, label]), max(1, NEAR_NUMBERS // d)

    def moments(z: np.ndarray) -> np.ndarray:
        x, y = expand(z[:, :p]), z[:, p]
        return np.concatenate([[len(z), y.sum(), (y * y).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    m = data.sum(3 + 2 * d, moments, rows=few)
    n = m[0]
    mean = m[3:3 + d] / n
    sd = np.sqrt(np.maximum(m[3 + d:] / n - mean ** 2, 0.0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    y_mean = m[1] / n if center else 0.0
    y_sd = float(np.sqrt(max(m[2] / n - y_mean ** 2, 0.0))) or 1.0 if center else 1.0
    penalty = l2 * (y_sd / sd) ** 2

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w = theta.reshape(n_outputs, d + 1)

        def part(z: np.ndarray) -> np.ndarray:
            x = (expand(z[:, :p]) - mean) / sd
            margins = (x @ w[:, :d].T + w[:, d]) * y_sd + y_mean
            value, slope = loss(margins, z[:, p])
            slope = slope * y_sd
            grad = np.column_stack([slope.T @ x, slope.sum(axis=0)])
            return np.concatenate([[value.sum()], grad.ravel()])

        total = data.sum(1 + theta.size, part, rows=few) / n
        value = total[0] + 0.5 * float(np.sum(penalty * w[:, :d] ** 2))
        grad = total[1:].reshape(w.shape)
        grad[:, :d] += penalty * w[:, :d]
        return value / y_sd, grad.ravel() / y_sd

    start, metric = np.zeros(n_outputs * (d + 1)), None
    if bend is not None and n > 2 * PART_ROWS:
        mark = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) < int(math.ceil(PART_ROWS / n * (1 << 20)))
        names = [f"c{i}" for i in range(p + 1)]
        part_of = df.filter(mark).select(*[col(c).cast("double").alias(m) for c, m in zip([*features, label], names)])

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in gathered(batches, 8 * PART_ROWS):  # one table
                z = np.stack([t.column(c).to_numpy() for c in names])
                z = z[:, np.lexsort(z)]  # the order in which rows arrive changes nothing
                x = np.empty((z.shape[1], d + 1))
                for at in range(0, len(x), few):
                    x[at:at + few, :d] = (expand(z[:p, at:at + few].T) - mean) / sd
                x[:, d] = 1.0
                found, inverse = _part_search(x, z[p], loss, bend, np.append(penalty, 0.0), y_mean, y_sd, max_iter)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([found, inverse.ravel()])])], names=["v"])
                return

        found = [v.values.to_numpy() for v in part_of.repartition(1).mapInArrow(solve, "v array<double>").toArrow().column("v")]
        if found:
            start, metric = found[0][:d + 1], found[0][d + 1:].reshape(d + 1, d + 1)
    theta = minimize(objective, start, max_iter, metric=metric).reshape(n_outputs, d + 1)
    coef = theta[:, :d] * y_sd / sd
    return coef, y_mean + theta[:, d] * y_sd - coef @ mean


def _part_search(x: np.ndarray, y: np.ndarray, loss, bend, penalty: np.ndarray, y_mean: float, y_sd: float,
                 max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the objective of ``fit_margins`` on some rows is least, and the inverse of its curvature there."""
    n, width = x.shape

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = loss((x @ theta * y_sd + y_mean)[:, None], y)
        return (value.sum() / n + 0.5 * float(penalty @ theta ** 2)) / y_sd, slope[:, 0] @ x / n + penalty * theta / y_sd

    def inverse(theta: np.ndarray) -> np.ndarray:
        weight = bend((x @ theta * y_sd + y_mean)[:, None], y)
        rows = np.flatnonzero(weight)
        hess = (x[rows] * weight[rows, None]).T @ x[rows] * (y_sd / n) + np.diag(penalty / y_sd)
        return np.linalg.inv(hess + 1e-7 * max(np.trace(hess) / width, 1e-300) * np.eye(width))

    theta = minimize(objective, np.zeros(width), max_iter)
    value = objective(theta)[0]
    for _ in range(PART_SEARCHES):  # anew with the curvature of where the last search ended
        theta = minimize(objective, theta, max_iter, metric=inverse(theta), least=1e-8)
        last, value = value, objective(theta)[0]
        if last - value < 1e-6 * abs(value):
            break
    return theta, inverse(theta)


# The hinge is rounded off over this margin, so that smooth steps converge.
HINGE_ROUNDING = 0.1


def hinge(classes: Sequence[float]):
    """One-against-the-rest hinge loss; one output per entry of ``classes``.

    Its corner is a parabola of width ``HINGE_ROUNDING``: a kink would cost a
    quasi-Newton search several times as many passes over the data.
    """
    wanted = np.asarray(classes)

    def loss(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = np.where(y[:, None] == wanted[None, :], 1.0, -1.0)
        short = 1.0 - side * margins
        bent = np.clip(short / HINGE_ROUNDING, 0.0, 1.0)
        value = np.where(short < HINGE_ROUNDING, 0.5 * HINGE_ROUNDING * bent ** 2, short - 0.5 * HINGE_ROUNDING)
        return value, -side * bent

    return loss


def logistic(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[float], l2: float,
             joint: bool, max_iter: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Logistic fits by Newton's method: a handful of passes whatever the conditioning.

    ``joint``: one softmax over all classes; otherwise one independent fit per
    class, all in the same passes. Minimises mean loss + l2/2 |W|^2.
    """
    data = Blocks(df, [*features, label])
    p, k = len(features), len(classes)
    wanted = np.asarray(classes)
    stats = data.sum(1 + 2 * p, lambda z: np.concatenate(
        [[len(z)], z[:, :p].sum(axis=0), (z[:, :p] ** 2).sum(axis=0)]))
    n, mean = stats[0], stats[1:1 + p] / stats[0]
    sd = np.sqrt(np.maximum(stats[1 + p:] / n - mean ** 2, 0.0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    penalty = np.tile(np.concatenate([l2 / sd ** 2, [0.0]]), k)
    d = p + 1
    width = k * d
    cells = (width * width if joint else k * d * d)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = theta.reshape(k, d)

        def part(z: np.ndarray) -> np.ndarray:
            x = np.column_stack([(z[:, :p] - mean) / sd, np.ones(len(z))])
            t = (z[:, p, None] == wanted[None, :]).astype(float)
            s = x @ w.T
            if joint:
                top = s.max(axis=1, keepdims=True)
                e = np.exp(s - top)
                share = e / e.sum(axis=1, keepdims=True)
                value = (np.log(e.sum(axis=1)) + top[:, 0] - (s * t).sum(axis=1)).sum()
                hess = np.empty((k, d, k, d))
                for a in range(k):
                    for b in range(k):
                        v = share[:, a] * ((a == b) - share[:, b])
                        hess[a, :, b, :] = (x * v[:, None]).T @ x
            else:
                share = 1.0 / (1.0 + np.exp(-np.clip(s, -500, 500)))
                value = (np.logaddexp(0.0, s) - s * t).sum()
                hess = np.stack([(x * (share[:, a] * (1 - share[:, a]))[:, None]).T @ x for a in range(k)])
            return np.concatenate([[value], ((share - t).T @ x).ravel(), hess.ravel()])

        total = data.sum(1 + width + cells, part) / n
        if joint:
            hess = total[1 + width:].reshape(width, width)
        else:
            hess = np.zeros((width, width))
            for a, block in enumerate(total[1 + width:].reshape(k, d, d)):
                hess[a * d:(a + 1) * d, a * d:(a + 1) * d] = block
        value = total[0] + 0.5 * float(penalty @ theta ** 2)
        return value, total[1:1 + width] + penalty * theta, hess + np.diag(penalty)

    theta = np.zeros(width)
    value, grad, hess = evaluate(theta)
    for _ in range(max_iter):
        if np.max(np.abs(grad)) < tolerance:
            break
        # the softmax has a free direction (equal intercepts): smallest-norm step
        step = -np.linalg.lstsq(hess + 1e-12 * np.eye(width), grad, rcond=1e-12)[0]
        slope, size = float(grad @ step), 1.0
        for _ in range(30):
            new_value, new_grad, new_hess = evaluate(theta + size * step)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * slope + 1e-15 * abs(value):
                break
            size *= 0.5
        done = value - new_value <= 1e-13 * max(1.0, abs(value))
        theta, value, grad, hess = theta + size * step, new_value, new_grad, new_hess
        if done:
            break
    w = theta.reshape(k, d)
    coef = w[:, :p] / sd
    return coef, w[:, p] - coef @ mean


class NotConverged(UserWarning):
    """A search stopped at its limit of steps."""


def minimize(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray,
             max_iter: int = 1000, tolerance: float = 1e-5, memory: int = 10, metric: np.ndarray | None = None,
             least: float | None = None) -> np.ndarray:
    """Limited-memory BFGS with a backtracking step; each call is one Spark job.

    ``metric`` is the inverse curvature to begin with, if it is known. A search ends where a step gains
    ``least`` (a tenth of ``tolerance``) or less. One that ends at ``max_iter`` steps says so in a warning.
    """
    least = tolerance * 0.1 if least is None else least
    x = start.copy()
    f, g = value_and_gradient(x)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    for _ in range(max_iter):
        if np.max(np.abs(g)) < tolerance:
            break
        d = -g.copy()
        weights = []
        for s, y in zip(reversed(steps), reversed(changes)):
            a = s @ d / (y @ s)
            weights.append(a)
            d -= a * y
        if metric is not None:
            d = metric @ d
        elif steps:
            d *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(zip(steps, changes), reversed(weights)):
            d += s * (a - y @ d / (y @ s))
        slope = g @ d
        if slope >= 0:
            d, slope, steps, changes = -g, -(g @ g), [], []
        t = 1.0
        for _ in range(20):
            f_new, g_new = value_and_gradient(x + t * d)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            break
        s, y = t * d, g_new - g
        done = f - f_new <= least * max(1.0, abs(f))
        x, f, g = x + s, f_new, g_new
        if y @ s > 1e-12:
            steps, changes = [*steps[-memory + 1:], s], [*changes[-memory + 1:], y]
        if done:
            break
    else:
        if max_iter and np.max(np.abs(g)) >= tolerance:
            warnings.warn(f"not converged after {max_iter} steps", NotConverged, stacklevel=2)
    return x
