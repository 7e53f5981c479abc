"""Cleaning, imputation, encoding and scaling.

Every operator is a pair: ``fit_*`` runs small aggregates and returns a step (a
plain dict), ``apply_step`` turns the step into one projection. ``Preparation``
chains them in the fixed order and keeps the fitted steps for new rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import (
    as_double, categorical_columns, col, numeric_columns,
)
from gridwright.functions.ordered import join_sized, quantiles
from gridwright.models.base import FittedStage
from gridwright.operators import neighbors
from gridwright.operators.gram import gram
from gridwright.operators.profile import distinct_counts, high_correlations, value_counts
from gridwright.session import checkpoint

# More categories than this cannot become columns of one table.
ONE_HOT_LIMIT = 10_000
AUTO_ONE_HOT = 10
AUTO_KNN_COLUMNS = 10
SIMPLE_STRATEGIES = ("mean", "median", "most_frequent")
SCALERS = ("standard", "minmax", "robust", "maxabs", "power", "none")


def _map(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[
        changes[c].alias(c) if c in changes else col(c) for c in df.columns
    ])


def _aggregate(df: DataFrame, columns: Sequence[str], **stats) -> dict[str, dict]:
    """One job: ``{column: {stat: value}}``."""
    if not columns:
        return {}
    row = df.agg(*[
        f(as_double(df, c)).alias(f"{s}_{i}") for i, c in enumerate(columns) for s, f in stats.items()
    ]).first()
    return {c: {s: row[f"{s}_{i}"] for s in stats} for i, c in enumerate(columns)}


# -- columns that go ---------------------------------------------------------

def fit_drop_correlated(df: DataFrame, threshold: float = 0.95) -> dict:
    """Of each highly correlated pair the earlier column is dropped."""
    rows = {r["row"] for r in high_correlations(df, threshold).select("row").collect()}
    return {"op": "drop", "columns": [c for c in df.columns if c in rows]}


def fit_drop_low_variance(df: DataFrame, threshold: float = 0.0) -> dict:
    stats = _aggregate(df, numeric_columns(df), v=F.var_pop)
    return {"op": "drop", "columns": [
        c for c, s in stats.items() if s["v"] is None or not s["v"] > threshold
    ]}


# -- outliers ----------------------------------------------------------------

def fit_outliers(df: DataFrame, method: str, threshold: float = 3.0,
                 columns: Sequence[str] | None = None) -> dict:
    columns = numeric_columns(df) if columns is None else list(columns)
    if method == "zscore":
        stats = _aggregate(df, columns, m=F.avg, s=F.stddev_samp)
        # a column without spread has no outliers
        return {"op": "blank", "threshold": threshold, "columns": {
            c: [s["m"], s["s"]] for c, s in stats.items() if s["s"]
        }}
    if method == "iqr":
        q = quantiles(df, columns, [0.25, 0.75])
        bounds = {
            c: [a - 1.5 * (b - a), b + 1.5 * (b - a)] for c, (a, b) in q.items() if a is not None
        }
    elif method == "winsorize":
        bounds = {c: v for c, v in quantiles(df, columns, [0.05, 0.95]).items() if v[0] is not None}
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return {"op": "clip", "columns": bounds}


# -- gaps --------------------------------------------------------------------

def gapped_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.count_if(col(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def fit_fill(df: DataFrame, strategy: str, columns: Sequence[str] | None = None) -> dict:
    """Mean, median or most frequent value (smallest on ties); unknown -> median."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if strategy == "mean":
        values = {c: s["m"] for c, s in _aggregate(df, columns, m=F.avg).items()}
    elif strategy == "most_frequent":
        values = _most_frequent(df, columns)
    else:
        values = {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()}
    return {"op": "fill", "columns": {c: v for c, v in values.items() if v is not None}}


def _most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mode per column through the shared long frame of value counts."""
    out = {}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), (as_double(df, c) + F.lit(0.0)).alias("value"))
        for c in columns
    ])
    counts = (
        df.select(F.inline(cells)).filter("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("value"))
    for row in best.collect():
        out[row["column"]] = row["value"]
    return out


def fit_fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    """Most frequent text per categorical column, ``Unknown`` if there is none."""
    columns = categorical_columns(df) if columns is None else list(columns)
    gaps = gapped_columns(df, columns)
    values = dict.fromkeys(gaps, "Unknown")
    if gaps:
        best = value_counts(df, gaps).groupBy("column").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("value"))
        values.update({r["column"]: r["value"] for r in best.collect()})
    return {"op": "fill_text", "columns": values}


def fit_fill_iterative(df: DataFrame, columns: Sequence[str] | None = None,
                       rounds: int = 10, tolerance: float = 1e-3) -> dict:
    """Chained regressions: each gapped column on all the others.

    Columns go in ascending order of gaps; a round regresses each one on the
    current fill of the others by Bayesian ridge from one cross-product pass.
    The step keeps every fitted regression, so new rows replay the same chain.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    work = df.select(*[as_double(df, c).alias(c) for c in columns])
    stats = _aggregate(work, columns, m=F.avg, n=F.count, a=lambda x: F.max(F.abs(x)))
    n = work.count()
    start = {c: stats[c]["m"] if stats[c]["m"] is not None else 0.0 for c in columns}
    todo = sorted((c for c in columns if stats[c]["n"] < n), key=lambda c: n - stats[c]["n"])
    scale = tolerance * max((stats[c]["a"] or 0.0) for c in columns) if columns else 0.0
    chain: list[dict] = []
    if not todo or len(columns) < 2:
        return {"op": "chain", "start": start, "order": todo, "rounds": chain}
    # the originals tell which cells are gaps; the fill lives beside them
    filled = work.select(
        *[col(c) for c in columns],
        *[F.coalesce(col(c), F.lit(start[c])).alias(f"f_{c}") for c in columns],
    )
    filled = checkpoint(filled)
    for _ in range(rounds):
        fits = {}
        before = {c: col(f"f_{c}") for c in todo}
        current = filled
        for c in todo:
            others = [o for o in columns if o != c]
            seen = current.filter(col(c).isNotNull())
            g = gram(seen.select(*[col(f"f_{o}").alias(o) for o in others], col(c)), [*others, c])
            coef, intercept = bayesian_ridge(g)[:2]
            fits[c] = {"others": others, "coef": coef.tolist(), "intercept": intercept}
            value = linear(fits[c], {o: col(f"f_{o}") for o in others})
            current = current.select(
                *[col(x) if x != f"f_{c}" else F.coalesce(col(c), value).alias(x)
                  for x in current.columns],
                *([] if f"old_{c}" in current.columns else [before[c].alias(f"old_{c}")]),
            )
        chain.append(fits)
        current = checkpoint(current)
        moved = current.agg(*[
            F.max(F.abs(col(f"f_{c}") - col(f"old_{c}"))).alias(str(i)) for i, c in enumerate(todo)
        ]).first()
        filled = current.drop(*[f"old_{c}" for c in todo])
        if max(m or 0.0 for m in moved) < scale:
            break
    return {"op": "chain", "start": start, "order": todo, "rounds": chain}


def bayesian_ridge(g, alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6,
                   lambda_2: float = 1e-6, iterations: int = 300, tolerance: float = 1e-3):
    """Evidence maximisation (MacKay) on centred cross products; target last."""
    p = len(g.mean) - 1
    xx, xy, yy = g.scatter[:p, :p], g.scatter[:p, p], g.scatter[p, p]
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    projected = vectors.T @ xy
    n = g.n
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    coef = np.zeros(p)
    for i in range(iterations):
        old = coef
        coef = vectors @ (projected / (values + lam / alpha))
        rss = max(float(yy - 2 * coef @ xy + coef @ xx @ coef), 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * lambda_1) / (float(coef @ coef) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (rss + 2 * alpha_2)
        if i and np.sum(np.abs(old - coef)) < tolerance:
            break
    coef = vectors @ (projected / (values + lam / alpha))
    return coef, float(g.mean[p] - g.mean[:p] @ coef), alpha, lam


def linear(fit: dict, columns: dict[str, Column]) -> Column:
    out = F.lit(float(fit["intercept"]))
    for o, b in zip(fit["others"], fit["coef"]):
        out = out + columns[o] * F.lit(float(b))
    return out


# -- categories --------------------------------------------------------------

def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): rank of each distinct text in ascending order.

    The distinct texts are range-partitioned and numbered per partition, then
    shifted by the sizes of the partitions before - no single-task sort.
    """
    texts = df.select(col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    ranged = checkpoint(
        texts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offset, shifts = 0, []
    for part in sorted(sizes):
        shifts.append((part, offset))
        offset += sizes[part]
    shift = F.broadcast(df.sparkSession.createDataFrame(shifts, "part int, shift long"))
    w = Window.partitionBy("part").orderBy("value")
    return ranged.join(shift, "part").select(
        "value", (F.row_number().over(w) - 1 + F.col("shift")).cast("double").alias("code"))


def fit_one_hot(df: DataFrame, column: str) -> dict:
    n = distinct_counts(df, [column]).first()["n_unique"]
    if n > ONE_HOT_LIMIT:
        raise ValueError(f"{column}: {n} categories are too many for columns; use label encoding")
    values = sorted(r[0] for r in df.select(col(column).cast("string")).distinct().collect()
                    if r[0] is not None)
    return {"op": "one_hot", "column": column, "values": values[1:]}


def auto_encoding(n_unique: int) -> str:
    return "onehot" if n_unique != 2 and n_unique <= AUTO_ONE_HOT else "label"


def encode(df: DataFrame, column: str, codes: DataFrame, kind: str = "long",
           invalid: str = "error") -> DataFrame:
    """Replace texts by their codes; an unknown text fails or becomes NULL."""
    joined = join_sized(
        df.withColumn("_text", col(column).cast("string")),
        codes.select(F.col("value").alias("_text"), F.col("code").alias("_code")),
        ["_text"], "left", materialised=True,
    )
    code = F.col("_code").cast(kind)
    if invalid == "error":
        unknown = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col("_text")))
        code = F.when(F.col("_text").isNotNull() & F.col("_code").isNull(), unknown.cast(kind)).otherwise(code)
    return joined.select(*[code.alias(c) if c == column else col(c) for c in df.columns])


# -- scale -------------------------------------------------------------------

def fit_scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> dict:
    """Centre and divisor per column; a zero divisor counts as 1."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if method == "power":
        return fit_power(df, columns)
    if method == "minmax":
        s = _aggregate(df, columns, a=F.min, b=F.max)
        pairs = {c: (v["a"], None if v["a"] is None else v["b"] - v["a"]) for c, v in s.items()}
    elif method == "maxabs":
        s = _aggregate(df, columns, b=lambda x: F.max(F.abs(x)))
        pairs = {c: (0.0, v["b"]) for c, v in s.items()}
    elif method == "robust":
        q = quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()}
    else:
        s = _aggregate(df, columns, a=F.avg, b=F.stddev_pop)
        pairs = {c: (v["a"], v["b"]) for c, v in s.items()}
    return {"op": "scale", "columns": {
        c: [m, d if d else 1.0] for c, (m, d) in pairs.items() if m is not None
    }}


def yeo_johnson(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        up = F.log1p(x)
    else:
        up = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2) < 1e-12:
        down = -F.log1p(-x)
    else:
        down = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def fit_power(df: DataFrame, columns: Sequence[str], points: int = 17, passes: int = 5) -> dict:
    """Yeo-Johnson exponents by maximum likelihood, then mean and deviation.

    Every pass evaluates the log-likelihood of a grid of exponents for all
    columns in one aggregate and narrows the grid around the best one.
    """
    window = {c: (-5.0, 5.0) for c in columns}
    best: dict[str, float] = {}
    spread = _aggregate(df, columns, v=F.var_pop)
    live = [c for c in columns if spread[c]["v"]]
    for _ in range(passes):
        if not live:
            break
        grid = {c: np.linspace(*window[c], points).tolist() for c in live}
        aggs = []
        for i, c in enumerate(live):
            x = as_double(df, c)
            aggs.append(F.count(x).alias(f"n{i}"))
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"l{i}"))
            aggs += [F.var_pop(yeo_johnson(x, lam)).alias(f"v{i}_{j}") for j, lam in enumerate(grid[c])]
        row = df.agg(*aggs).first()
        for i, c in enumerate(live):
            score = [
                -0.5 * row[f"n{i}"] * math.log(row[f"v{i}_{j}"]) + (lam - 1) * row[f"l{i}"]
                if row[f"v{i}_{j}"] else -math.inf
                for j, lam in enumerate(grid[c])
            ]
            j = int(np.argmax(score))
            best[c] = grid[c][j]
            step = grid[c][1] - grid[c][0]
            window[c] = (best[c] - step, best[c] + step)
    lams = {c: best.get(c, 1.0) for c in columns}
    if not columns:
        return {"op": "power", "columns": {}}
    row = df.agg(*[
        f(yeo_johnson(as_double(df, c), lams[c])).alias(f"{s}{i}")
        for i, c in enumerate(columns) for s, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    return {"op": "power", "columns": {
        c: [lams[c], row[f"m{i}"], row[f"s{i}"] or 1.0]
        for i, c in enumerate(columns) if row[f"m{i}"] is not None
    }}


# -- replay ------------------------------------------------------------------

def apply_step(df: DataFrame, step: dict, tables: dict[str, DataFrame] | None = None,
               invalid: str = "error") -> DataFrame:
    tables = tables or {}
    op = step["op"]
    if op == "drop":
        return df.drop(*[col(c) for c in step["columns"] if c in df.columns])
    if op == "one_hot":
        c = step["column"]
        if c not in df.columns:
            return df
        text = col(c).cast("string")
        return df.select(
            *[col(x) for x in df.columns if x != c],
            *[F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in step["values"]],
        )
    if op == "codes":
        if step["column"] not in df.columns:
            return df
        return encode(df, step["column"], tables[step["table"]], step["type"], invalid)
    if op == "knn":
        return neighbors.impute_nearest(
            df, step["columns"], step["key"], step["k"], tables.get(step["table"]), step["means"])
    if op == "chain":
        return _replay_chain(df, step)
    changes: dict[str, Column] = {}
    for c, v in step["columns"].items():
        if c not in df.columns:
            continue
        if op == "fill_text":
            changes[c] = F.coalesce(col(c).cast("string"), F.lit(v))
            continue
        x = as_double(df, c)
        if op == "blank":
            z = F.abs((x - F.lit(v[0])) / F.lit(v[1]))
            changes[c] = F.when(z < step["threshold"], x)
        elif op == "clip":
            changes[c] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(v[1])), F.lit(v[0])))
        elif op == "fill":
            changes[c] = F.coalesce(x, F.lit(float(v)))
        elif op == "scale":
            changes[c] = (x - F.lit(float(v[0]))) / F.lit(float(v[1]))
        elif op == "power":
            changes[c] = (yeo_johnson(x, v[0]) - F.lit(v[1])) / F.lit(v[2])
        else:
            raise ValueError(f"unknown step {op!r}")
    return _map(df, changes)


def _replay_chain(df: DataFrame, step: dict) -> DataFrame:
    names = [c for c in step["start"] if c in df.columns]
    out = df.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(col(c).cast("double"), F.lit(step["start"][c])).alias(f"_f_{c}") for c in names],
    )
    # one nested projection per regression keeps the expression tree flat
    for fits in step["rounds"]:
        for c in step["order"]:
            value = linear(fits[c], {o: col(f"_f_{o}") for o in fits[c]["others"]})
            out = out.withColumn(f"_f_{c}", F.coalesce(col(c).cast("double"), value))
    return out.select(*[col(f"_f_{c}").alias(c) if c in names else col(c) for c in df.columns])


def finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL, NaN and infinities become 0 in every feature."""
    columns = numeric_columns(df) if columns is None else columns
    changes = {}
    for c in columns:
        x = col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        changes[c] = F.when(bad, F.lit(0.0)).otherwise(x)
    return _map(df, changes)


# -- the whole preparation -----------------------------------------------------

@dataclass
class PreparationOptions:
    missing_strategy: str = "auto"
    scaling: str = "standard"
    encoding: str = "auto"
    outlier_method: str = "none"
    outlier_threshold: float = 3.0
    drop_high_corr: bool = False
    corr_threshold: float = 0.95
    drop_low_variance: bool = False
    variance_threshold: float = 0.0


class Preparation(Estimator):
    """Fit all steps in order on the feature columns; ``passthrough`` columns
    (row keys, target, folds) travel along untouched."""

    def __init__(self, options: PreparationOptions | None = None, key: str | None = None,
                 passthrough: Sequence[str] = ()):
        super().__init__()
        self.options = options or PreparationOptions()
        self.key = key
        self.passthrough = list(dict.fromkeys([*passthrough, *([key] if key else [])]))

    def _fit(self, df: DataFrame) -> "PreparationModel":
        o = self.options
        steps: list[dict] = []
        tables: dict[str, DataFrame] = {}
        log: list[str] = []
        features = [c for c in df.columns if c not in self.passthrough]
        kept = [c for c in df.columns if c in self.passthrough]
        # every statistic below scans only its own columns of this projection
        work = df.select(*[col(c) for c in [*kept, *features]])

        def numbers() -> list[str]:
            return [c for c in numeric_columns(work) if c not in self.passthrough]

        def add(step: dict, message: str) -> None:
            nonlocal work
            steps.append(step)
            log.append(message)
            work = apply_step(work, step, tables)
            if step["op"] == "knn":
                work = checkpoint(work)  # the neighbour search runs once, not per statistic

        cats = [c for c in categorical_columns(work) if c in features]
        if o.drop_high_corr:
            step = fit_drop_correlated(work.select(*[col(c) for c in numbers()]), o.corr_threshold)
            add(step, f"removed {len(step['columns'])} correlated column(s): {step['columns']}")
        num = numbers()
        if o.outlier_method != "none" and num:
            add(fit_outliers(work, o.outlier_method, o.outlier_threshold, num),
                f"outliers: {o.outlier_method}")
        gaps = gapped_columns(work, num)
        if gaps:
            strategy = o.missing_strategy
            if strategy == "auto":
                strategy = "knn" if len(gaps) <= AUTO_KNN_COLUMNS else "median"
            add(self._fit_gaps(work, strategy, num, gaps, tables),
                f"filled {len(gaps)} numeric column(s): {strategy}")
        if cats:
            add(fit_fill_mode(work, cats), f"filled text columns with their mode: {cats}")
            unique = {r["column"]: r["n_unique"] for r in distinct_counts(work, cats).collect()}
            for c in cats:
                kind = o.encoding if o.encoding != "auto" else auto_encoding(unique[c])
                if kind == "onehot":
                    step = fit_one_hot(work, c)
                    add(step, f"one-hot {c}: {len(step['values'])} column(s)")
                elif kind in ("label", "ordinal"):
                    name = f"codes_{len(tables)}"
                    tables[name] = checkpoint(dictionary(work, c))
                    add({"op": "codes", "column": c, "table": name,
                         "type": "long" if kind == "label" else "double"}, f"{kind} codes for {c}")
                else:
                    raise ValueError(f"unknown encoding {kind!r}")
        if numbers() and o.scaling != "none":
            method = o.scaling if o.scaling in SCALERS else "standard"
            add(fit_scale(work, method, numbers()), f"{method} scaling of {len(numbers())} column(s)")
        if o.drop_low_variance:
            step = fit_drop_low_variance(work.select(*[col(c) for c in numbers()]), o.variance_threshold)
            add(step, f"removed {len(step['columns'])} column(s) of low variance: {step['columns']}")
        out = [c for c in work.columns if c not in self.passthrough]
        return PreparationModel({
            "steps": steps, "log": log, "features": out, "passthrough": self.passthrough,
            "options": asdict(o),
        }, tables)

    def _fit_gaps(self, work: DataFrame, strategy: str, num: list[str], gaps: list[str],
                  tables: dict[str, DataFrame]) -> dict:
        if strategy == "knn":
            if not self.key:
                raise ValueError("nearest-neighbour filling needs a row key")
            tables["donors"] = work.select(col(self.key), *[col(c) for c in num if c != self.key])
            means = {c: s["m"] for c, s in _aggregate(work, num, m=F.avg).items()}
            return {"op": "knn", "columns": num, "key": self.key, "k": 5, "table": "donors",
                    "means": means}
        if strategy == "iterative":
            return fit_fill_iterative(work, num)
        return fit_fill(work, strategy, num)


class PreparationModel(FittedStage):
    """Replays every fitted step on new rows, in the fitted order."""

    @property
    def features(self) -> list[str]:
        return self.state["features"]

    def _transform(self, df: DataFrame) -> DataFrame:
        for step in self.state["steps"]:
            df = apply_step(df, step, self.tables)
        return df

    def log(self, df_or_spark) -> DataFrame:
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        rows = list(enumerate(self.state["log"], 1))
        return spark.createDataFrame(rows, "step int, message string")
