"""A log of runs: one parquet table, appended by any number of sessions."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, timestamp timestamp, name string, task_type string, best_model string, "
    "metrics map<string,double>, config map<string,string>, dataset_info map<string,string>, "
    "tags array<string>"
)


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def list(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def count(self) -> int:
        return self.list().count()

    def log(self, name: str | None = None, task_type: str | None = None, best_model: str | None = None,
            metrics: dict | None = None, config: dict | None = None, dataset_info: dict | None = None,
            tags: list[str] | None = None) -> str:
        run = uuid.uuid4().hex[:8]
        row = (
            run, datetime.now(timezone.utc), name or f"run_{self.count() + 1}", task_type, best_model,
            {k: float(v) for k, v in (metrics or {}).items() if v is not None},
            {k: str(v) for k, v in (config or {}).items()},
            {k: str(v) for k, v in (dataset_info or {}).items()}, list(tags or []),
        )
        self.append(self.spark.createDataFrame([row], SCHEMA))
        return run

    def append(self, runs: DataFrame) -> None:
        """Append whole frames of runs, e.g. one per group of a table."""
        names = [f.name for f in self.spark.createDataFrame([], SCHEMA).schema.fields]
        runs.select(*names).write.mode("append").parquet(self.path)

    def get(self, run: str) -> DataFrame:
        found = self.list().filter(F.col("id") == run)
        if found.isEmpty():
            raise KeyError(f"no run {run}")
        return found

    def clear(self) -> None:
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(self.path)

    def compare(self) -> DataFrame:
        return compare(self.list())


def compare(runs: DataFrame) -> DataFrame:
    """One row per run and one column per metric.

    The metric names are few and come from one small aggregate, so the pivot
    needs no shuffle: each column is a map lookup.
    """
    names = [r[0] for r in runs.select(F.explode(F.map_keys("metrics"))).distinct().orderBy("col").collect()]
    return runs.select(
        "id", "name", F.col("best_model").alias("model"), F.col("task_type").alias("task"),
        *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names])
