"""What the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteq.checkpoints import checkpointed
from graniteq.deploy import ship_package

__all__ = ["checkpointed", "hex64", "output", "take"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def take(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``df`` whose names are the values of ``names``, under its keys.

    Goes by place, so other columns may have names that differ only in case. Of
    columns with the same name the first is taken. As every operator starts
    here, this also sees to it that workers can import the package.
    """
    missing = [n for n in names.values() if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing} among {df.columns}")
    ship_package(df.sparkSession)
    placed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return placed.select(*[F.col(f"c{df.columns.index(n)}").alias(alias) for alias, n in names.items()])


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def output(columns: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    """A batch from values by name, each with its Arrow type."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for kind, x in columns.values()], names=list(columns))
