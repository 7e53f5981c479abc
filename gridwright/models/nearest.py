"""k-nearest-neighbour classifier and regressor on the exact join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col, order_text
from gridwright.models.base import FittedStage
from gridwright.models.common import Problem
from gridwright.operators.neighbors import feature_array, knn_join
from gridwright.session import checkpoint


class NearestNeighbors(FittedStage):
    """Training rows are kept as a table: the model is as large as its data."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        # fixed row numbers: the frame is written once before it is searched
        rows = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
        queries = rows.select(
            F.col("_row").cast("string").alias("qid"), feature_array(df, s["features"]).alias("x"))
        near = knn_join(queries, self.tables["train"], s["k"], s["metric"])
        if s["classes"]:
            shares = [F.count_if(F.col("v") == c) / F.count("*") for c in s["classes"]]
            out = near.groupBy("qid").agg(F.array(*shares).alias("probability"))
            top = F.array_position("probability", F.array_max("probability")) - 1
            out = out.withColumn("prediction", top.cast("double"))
        else:
            out = near.groupBy("qid").agg(F.avg("v").alias("prediction"))
        joined = rows.join(out, F.col("_row").cast("string") == F.col("qid"), "left")
        extra = [c for c in ("prediction", "probability") if c in out.columns]
        return joined.select(*[col(c) for c in df.columns], *extra)


def nearest_neighbors(df: DataFrame, problem: Problem, params: dict) -> NearestNeighbors:
    # ties go to the smaller key
    keys = problem.settings.get("key") or []
    keys = [keys] if isinstance(keys, str) else list(keys)
    row = F.concat_ws("\x01", *[order_text(df, k) for k in keys]) if keys else order_text(
        df.withColumn("_row", F.monotonically_increasing_id()), "_row")
    rows = df if keys else df.withColumn("_row", F.monotonically_increasing_id())
    train = checkpoint(rows.select(
        row.alias("did"),
        feature_array(df, problem.features).alias("x"), col(problem.label).cast("double").alias("v")))
    return NearestNeighbors(
        {"features": problem.features, "k": int(params.get("n_neighbors", 5)),
         "metric": params.get("metric", "euclidean"),
         "classes": problem.classes if problem.is_classification else []},
        {"train": train})
