"""Cross-product sums: the one pass behind wide correlations, PCA, ridge, LDA
and iterative imputation.

Each task adds up its own rows with numpy and emits one row per matrix cell; a
hash aggregation adds the cells. What reaches the driver is p x p numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_double, ratio


def _matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """Batch columns as a float matrix, missing values as NaN."""
    parts = [
        batch.column(i).to_numpy(zero_copy_only=False).astype("float64", copy=False)
        for i in range(first, batch.num_columns)
    ]
    return np.column_stack(parts) if parts else np.empty((batch.num_rows, 0))


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations (i, j, corr) for i <= j of a wide table."""
    columns = list(columns)
    p = len(columns)
    narrow = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    # shift by the means: keeps the sums of squares well conditioned
    means = narrow.agg(*[F.avg(c).alias(c) for c in narrow.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, p, p))
        for batch in batches:
            x = _matrix(batch) - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype("float64")
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        i, j = np.triu_indices(p)
        cells = total[:, i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype("int32")), pa.array(j.astype("int32")), *map(pa.array, cells)],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    cells = narrow.mapInArrow(
        sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - ratio(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - ratio(F.col("sy") * F.col("sy"), n)
    corr = F.when(F.col("i") == F.col("j"), F.when(vx > 0, F.lit(1.0))).otherwise(
        ratio(cov, F.sqrt(vx) * F.sqrt(vy))
    )
    return cells.select("i", "j", corr.alias("corr"))


class Gram:
    """Sums of complete rows about a fixed shift; adds and subtracts like a set of rows."""

    def __init__(self, shift: np.ndarray, sums: np.ndarray):
        self.shift, self.sums = shift, sums

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self._drift

    @property
    def _drift(self) -> np.ndarray:
        return self.sums[0, 1:] / self.n if self.n else np.zeros(len(self.shift))

    @property
    def scatter(self) -> np.ndarray:
        """Cross products about the mean."""
        return self.sums[1:, 1:] - self.n * np.outer(self._drift, self._drift)

    @property
    def raw(self) -> np.ndarray:
        """Cross products about zero."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.shift, self.sums + other.sums)

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.shift, self.sums - other.sums)


def grams(df: DataFrame, columns: Sequence[str], group: str | None = None) -> dict[int, Gram]:
    """Cross products of numeric columns without missing values, per group number.

    One pass over the data for all groups. Every task gives count, mean and cross
    products about that mean as one row a group; a few tasks merge those pairwise,
    so nothing depends on the order or the layout of the rows.
    """
    columns = list(columns)
    p = len(columns)
    narrow = df.select(
        (F.col(group).cast("int") if group else F.lit(0)).alias("g"),
        *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)],
    )
    upper = np.triu_indices(p)

    def row(k: int, n: float, mean: np.ndarray, scatter: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k], type=pa.int32()), pa.array([n]), pa.array([mean]), pa.array([scatter[upper]])], names=["g", "n", "mean", "s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch, 1)
            for k in np.unique(g):
                part = x[g == k]
                mean = part.mean(axis=0)
                total[k] = _merged(total.get(k), (float(len(part)), mean, (part - mean).T @ (part - mean)))
        for k, one in total.items():
            yield row(k, *one)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for k, *one in zip(*(c.to_pylist() for c in batch.columns)):
                total[k] = _merged(total.get(k), _unfolded(*one))
        for k, one in total.items():
            yield row(k, *one)

    kind = "g int, n double, mean array<double>, s array<double>"
    width = max(1, min(32, df.sparkSession.sparkContext.defaultParallelism // 4))
    found: dict[int, tuple] = {}
    for r in narrow.mapInArrow(sums, kind).repartition(width).mapInArrow(merge, kind).collect():  # a row a group and merging task
        found[r["g"]] = _merged(found.get(r["g"]), _unfolded(r["n"], r["mean"], r["s"]))
    if not found:
        return {}
    everything = None
    for one in found.values():
        everything = _merged(everything, one)
    shift = everything[1]
    out = {}
    for k, (n, mean, scatter) in found.items():
        full = np.zeros((p + 1, p + 1))
        full[0, 0] = n
        full[0, 1:] = full[1:, 0] = n * (mean - shift)
        full[1:, 1:] = scatter + n * np.outer(mean - shift, mean - shift)
        out[int(k)] = Gram(shift, full)
    return out


def _unfolded(n: float, mean: Sequence[float], upper: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    p = len(mean)
    scatter = np.zeros((p, p))
    scatter[np.triu_indices(p)] = upper
    return n, np.array(mean, dtype=float), scatter + np.triu(scatter, 1).T


def _merged(one: tuple | None, other: tuple) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and cross products about the mean of two sets of rows together."""
    if one is None:
        return other
    n = one[0] + other[0]
    gap = other[1] - one[1]
    return n, one[1] + gap * (other[0] / n), one[2] + other[2] + np.outer(gap, gap) * (one[0] * other[0] / n)


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    return grams(df, columns).get(0) or Gram(
        np.zeros(len(columns)), np.zeros((len(columns) + 1, len(columns) + 1)))
