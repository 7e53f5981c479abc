"""Session-level settings shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "local").startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Only a single-machine session without that
    setting gets a temporary folder, which goes when Python ends; a cluster
    without it is a set-up error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="gridwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the session's own, made just now
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """Give a checkpointed frame that is read many times one task per core.

    Only a frame with fewer partitions than the cluster has cores is shuffled
    (a table of few files); a large one keeps its partitions.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return checkpoint(df.repartition(wanted))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written between steps."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
