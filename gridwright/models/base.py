"""Base of all fitted stages written in Python.

A stage keeps its small state as JSON and anything that grows with the data as
tables; both are saved with the stage, so a ``PipelineModel`` can hold it.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class _Writer(MLWriter):
    def __init__(self, instance: "FittedStage"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        stage = self.instance
        DefaultParamsWriter.saveMetadata(
            stage, path, self.sparkSession,
            extraMetadata={"state": json.dumps(stage.state), "tables": sorted(stage.tables)},
        )
        for name, frame in stage.tables.items():
            frame.write.parquet(os.path.join(path, "tables", name))


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "FittedStage":
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        tables = {
            name: spark.read.parquet(os.path.join(path, "tables", name)) for name in meta["tables"]
        }
        stage = self.cls(json.loads(meta["state"]), tables)
        stage._resetUid(meta["uid"])
        return stage


class FittedStage(Model, MLWritable, MLReadable):
    """A transformer defined by ``state`` (JSON) and ``tables`` (DataFrames)."""

    def __init__(self, state: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.state = state or {}
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


def active_session() -> SparkSession:
    return SparkSession.getActiveSession()
