"""Diagnostic curves as DataFrames of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col, hash_key, r, ratio
from gridwright.functions.ordered import quantiles
from gridwright.operators.metrics import one_vs_rest_rows, score_frame
from gridwright.operators.profile import histogram


def roc_points(frame: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score of a score frame."""
    return frame.select(
        *[col(g) for g in groups], "threshold",
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )


def roc_points_per_class(df: DataFrame, label: str, probability: str, classes: Sequence[float]) -> DataFrame:
    long = one_vs_rest_rows(df, label, probability, classes)
    return roc_points(score_frame(long, F.col("hit"), "p", ["class"]), ["class"])


def precision_recall_points(frame: DataFrame) -> DataFrame:
    return frame.select(
        "threshold",
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos"), 1.0).alias("recall"),
    )


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per right-closed uniform bin."""
    p = col(score).cast("double")
    slot = F.greatest(F.ceil(p * bins) - 1, F.lit(0).cast("long"))
    return df.groupBy(slot.alias("bin")).agg(
        r(F.avg(p)).alias("mean_predicted"),
        r(F.avg(F.when(col(label) == 1, 1.0).otherwise(0.0))).alias("fraction_positive"),
        F.count("*").alias("n"),
    )


def prediction_points(df: DataFrame, keys: Sequence[str], label: str = "label",
                      prediction: str = "prediction", limit: int | None = None, seed: int = 42) -> DataFrame:
    """Actual, predicted and residual of every row; ``limit`` draws a hash sample
    for plotting (ordered limit: each task keeps only ``limit`` rows)."""
    points = df.select(
        *[col(k) for k in keys],
        col(label).cast("double").alias("actual"),
        col(prediction).cast("double").alias("predicted"),
        (col(label).cast("double") - col(prediction).cast("double")).alias("residual"),
    )
    if limit is None:
        return points
    return points.orderBy(hash_key(keys, seed)).limit(limit)


def diagonal(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """End points of the identity line of an actual-versus-predicted plot."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    return df.agg(
        F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       bins: int = 30) -> DataFrame:
    residual = df.select((col(label).cast("double") - col(prediction).cast("double")).alias("residual"))
    mean = residual.agg(F.avg("residual")).first()[0]
    return histogram(residual, "residual", bins).withColumn("mean", r(F.lit(mean)))


def error_by_decile(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE per decile [q_i, q_i+1) of the target; the top value stays outside."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    edges = quantiles(df.select(y.alias("y")), ["y"], [i / 10 for i in range(11)])["y"]
    spark = df.sparkSession
    deciles = spark.range(10).select((F.col("id") + 1).alias("decile"))
    if edges[0] is None:
        return deciles.withColumn("mae", F.lit(0.0))
    slot: Column = F.lit(None).cast("long")
    for i in range(10):
        slot = F.when((y >= edges[i]) & (y < edges[i + 1]), F.lit(i + 1).cast("long")).otherwise(slot)
    errors = df.groupBy(slot.alias("decile")).agg(F.avg(F.abs(y - p)).alias("mae"))
    return deciles.join(errors, "decile", "left").select(
        "decile", r(F.coalesce("mae", F.lit(0.0))).alias("mae"))


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    label: str = "label",
    repeats: int = 10,
    seed: int = 42,
    prediction: str = "prediction",
) -> DataFrame:
    """Drop in R^2 when one feature is shuffled among rows.

    A shuffle is a random one-to-one assignment of rows: the rows are ordered by
    two different hashes and matched by position. Rows are dealt once to hash
    buckets of equal size, and a task orders a bucket anew for every repeat, so the
    rows cross the network once however many repeats there are. All features of a
    repeat are scored in one ``transform``.
    """
    features = list(features)
    n = df.count()
    buckets = max(1, n // 100_000)
    base = df.select(*[col(k) for k in keys], col(label).cast("double").alias("_y"),
                     *[col(f).cast("double").alias(f) for f in features])
    y = F.col("_y")
    e = y - F.col(prediction)
    r2 = 1 - ratio(F.sum(e * e), F.count(y).cast("double") * F.var_pop(y))
    plain = predict(base).agg(r2.alias("r2")).first()["r2"]
    own, given = ([f"{side}{i}" for i in range(len(features))] for side in ("f", "p"))
    dealt = base.select(
        F.pmod(F.xxhash64(hash_key(keys, f"{seed}:0:bucket")), F.lit(buckets)).alias("_b"),
        F.concat_ws(":", F.lit(""), *[col(k).cast("string") for k in keys]).alias("_k"), "_y",
        *[col(f).alias(c) for f, c in zip(features, own)])

    def shuffled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(list(rows)).combine_chunks()
        values = bucket.select(["_y", *own])
        # rows of equal keys are told apart by their values
        first = np.lexsort([c.to_numpy() for c in values.columns])
        values = values.take(pa.array(first))
        names = [k.encode() for k in bucket.column("_k").take(pa.array(first)).to_pylist()]

        def order(salt: str) -> np.ndarray:
            start = salt.encode()
            parts = np.frombuffer(b"".join([md5(start + k).digest() for k in names]), dtype=">u8").reshape(-1, 2)
            return np.lexsort((parts[:, 1], parts[:, 0]))

        for rep in range(repeats):
            takers, donors = (pa.array(order(f"{seed}:{rep}:{side}")) for side in ("a", "b"))
            for at in range(0, len(names), 10_000):
                mine, theirs = (values.take(x[at: at + 10_000]) for x in (takers, donors))
                columns = [pa.array(np.full(mine.num_rows, rep, dtype=np.int32)), *mine.columns, *theirs.columns[1:]]
                yield from pa.table(columns, ["_rep", "_y", *own, *given]).combine_chunks().to_batches()

    pairs = dealt.groupBy("_b").applyInArrow(
        shuffled, ", ".join(["_rep int", "_y double", *(f"{c} double" for c in [*own, *given])]))
    variants = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("_rep").alias("repeat"),
                 *[(F.col(p) if g == f else F.col(o)).alias(g) for g, o, p in zip(features, own, given)])
        for f in features
    ])
    drops = predict(pairs.select("_y", F.inline(variants))).groupBy("feature", "repeat").agg((F.lit(plain) - r2).alias("drop"))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
