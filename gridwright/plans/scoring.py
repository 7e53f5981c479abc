"""Scoring with a fitted model: batches, single records, probabilities, facts."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.pipeline import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import col, r
from gridwright.models.trees import importances
from gridwright.plans.trainer import Training

TOP_FEATURES = 20


@dataclass
class Scorer:
    """A model with the facts needed to score raw rows."""

    model: object
    name: str
    task: str
    features: list[str]
    labels: list[str] | None

    @classmethod
    def of(cls, training: Training) -> "Scorer":
        return cls(training.best_model, training.best_name, training.task,
                   training.problem.features, training.labels)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        facts = json.loads(spark.read.text(os.path.join(path, "facts")).first()[0])
        where = os.path.join(path, "model")
        meta = DefaultParamsReader.loadMetadata(where, spark)
        if meta["class"].endswith("PipelineModel"):
            model = PipelineModel.load(where)
        else:
            model = DefaultParamsReader.loadParamsInstance(where, spark)
        return cls(model, facts["name"], facts["task_type"], facts["features"], facts["labels"])

    def align(self, df: DataFrame) -> DataFrame:
        return align(df, self.features)

    def _raw(self, df: DataFrame) -> DataFrame:
        """Original columns plus aligned features under their own names."""
        others = [col(c) for c in df.columns if c not in self.features]
        return df.select(*others, *aligned(df, self.features))

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._raw(df))
        if self.labels:
            names = F.array(*[F.lit(v) for v in self.labels])
            out = out.withColumn("prediction", names[F.col("prediction").cast("int")])
        return out

    def probabilities(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, class, p), most likely class first within a key."""
        out = self.model.transform(self._raw(df))
        if "probability" not in out.columns:
            raise ValueError(f"{self.name} gives no probabilities")
        pairs = F.array(*[
            F.struct(F.lit(c).alias("class"), F.col("probability")[i].alias("p"))
            for i, c in enumerate(self.labels or [])
        ])
        return out.select(*[col(k) for k in keys], F.inline(F.sort_array(
            F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["class"].alias("class"))), asc=False)))

    def score_batch(self, df: DataFrame) -> DataFrame:
        """Input columns, ``__prediction__`` and one ``__prob_<class>__`` per class."""
        kept = [col(c) for c in df.columns]
        missing = [f for f in self.features if f not in df.columns]
        out = self.predict(df)
        extra = [F.col("prediction").alias("__prediction__")]
        if self.labels and "probability" in out.columns:
            extra += [r(F.col("probability")[i]).alias(f"__prob_{c}__") for i, c in enumerate(self.labels)]
        return out.select(*kept, *[col(m) for m in missing], *extra)

    def predict_records(self, spark: SparkSession, records: dict | list[dict]) -> DataFrame:
        rows = [records] if isinstance(records, dict) else list(records)
        names = list(dict.fromkeys(k for row in rows for k in row))
        schema = "_record long, " + ", ".join(f"`{n}` double" for n in names)
        data = [(i, *[None if row.get(n) is None else float(row[n]) for n in names]) for i, row in enumerate(rows)]
        return self.predict(spark.createDataFrame(data, schema))

    def importance(self, spark: SparkSession, top: int | None = TOP_FEATURES) -> DataFrame:
        found = importances(self.model, self.features)
        kind, values = found if found else ("none", [])
        rows = sorted(zip(self.features, values), key=lambda t: -t[1])[:top]
        return spark.createDataFrame(
            [(kind, f, float(v), i) for i, (f, v) in enumerate(rows, 1)],
            "kind string, feature string, importance double, rank int")

    def info(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.name, self.task, self.features, self.labels)],
            "name string, task_type string, features array<string>, labels array<string>")


def aligned(df: DataFrame, features: Sequence[str]) -> list:
    """Fixed feature order; absent columns and missing values are 0."""
    return [
        (F.coalesce(col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f)
        for f in features
    ]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(k) for k in keep], *aligned(df, features))
