"""Parquet tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``: a Parquet file or a folder of such files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whichever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
