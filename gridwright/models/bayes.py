"""Gaussian naive Bayes from one group-by."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, col
from gridwright.models.base import FittedStage
from gridwright.models.common import Problem, argmax, softmax


class GaussianBayes(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        names = []
        staged = df
        for k, row in enumerate(s["classes"]):
            terms = [F.lit(row["log_prior"])]
            for c, m, v in zip(s["features"], row["mean"], row["var"]):
                gap = col(c).cast("double") - F.lit(m)
                terms.append(F.lit(-0.5 * math.log(2.0 * math.pi * v)) - gap * gap / F.lit(2.0 * v))
            names.append(f"_j{k}")
            staged = staged.withColumn(names[-1], add_all(terms))
        cols = [F.col(n) for n in names]
        return (
            staged.withColumn("prediction", argmax(cols)).withColumn("probability", softmax(cols)).drop(*names)
        )


def gaussian_naive_bayes(df: DataFrame, problem: Problem, params: dict) -> GaussianBayes:
    """Class means and variances; the smoothing is a share of the largest variance."""
    x = problem.features
    rows = df.groupBy(col(problem.label).alias("_y")).agg(
        F.count("*").alias("n"),
        *[f(col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(x)
          for s, f in (("m", F.avg), ("v", F.var_pop))],
    ).orderBy("_y").collect()
    # total variance from the class parts: no second pass over the rows
    total = sum(r["n"] for r in rows)
    spread = []
    for i in range(len(x)):
        mean = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        spread.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows) / total)
    eps = params.get("var_smoothing", 1e-9) * max(spread)
    return GaussianBayes({"features": x, "classes": [
        {"log_prior": math.log(r["n"] / total),
         "mean": [r[f"m{i}"] for i in range(len(x))],
         "var": [max(r[f"v{i}"] + eps, 1e-300) for i in range(len(x))]}
        for r in rows
    ]})
