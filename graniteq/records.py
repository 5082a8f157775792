"""The native record relation and the validity predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

ROWS_PER_BLOCK = 100
STRING_WIDTH = 120

#: Unsigned 32-bit numbers are held as long, so that order stays unsigned.
RECORD_SCHEMA = StructType(
    [
        StructField("recid", LongType(), False),
        StructField("num", LongType(), False),
        StructField("str", StringType(), False),
        StructField("valid", BooleanType(), False),
        StructField("block_id", LongType(), False),
        StructField("block_valid", BooleanType(), False),
    ]
)


def valid_records() -> Column:
    """A record takes part if it and its block are valid."""
    return F.col("valid") & F.col("block_valid")


def keep_valid(df: DataFrame, valid: Column | str | None) -> DataFrame:
    """Rows for which ``valid`` is true; null counts as false, None keeps all rows."""
    return df if valid is None else df.filter(F.expr(valid) if isinstance(valid, str) else valid)


def describe(df: DataFrame) -> DataFrame:
    """One printable line for each valid record, in the column ``line``."""
    shown = keep_valid(df, F.col("valid"))
    return shown.select(F.format_string("BL %d, RC %d, %d, %s", "block_id", "recid", "num", "str").alias("line"))


def size_in_blocks(df: DataFrame) -> DataFrame:
    """One row: ``n_blocks``, the blocks of ROWS_PER_BLOCK slots that the relation fills."""
    return df.agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).cast("long").alias("n_blocks"))
