"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder and read from there.

    The folder is the one the session names in spark.checkpoint.dir. Only where
    neither that nor the context names one, and the master is local, a
    temporary folder is used.
    """
    spark = df.sparkSession
    _ensure_folder(spark)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder, which all executors share, that nothing else has."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _ensure_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graniteq-checkpoints-")
    context.setCheckpointDir(folder)
