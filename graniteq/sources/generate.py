"""Generated record relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteq.functions import random_letters, random_letters_sql, random_long, random_long_sql
from graniteq.records import ROWS_PER_BLOCK, STRING_WIDTH

NUM_BOUND = 100_000
INVALID_IN_HUNDRED = 2


def generate_relation(spark: SparkSession, n_blocks: int, seed: int) -> DataFrame:
    """``n_blocks`` full blocks: recid 1, 2, ..., a random num and str, about 98 % valid.

    The same seed gives the same rows, however they are partitioned.
    """
    if n_blocks < 0:
        raise ValueError("n_blocks must not be negative")
    recid = F.col("recid")
    rows = spark.range(1, n_blocks * ROWS_PER_BLOCK + 1).withColumnRenamed("id", "recid")
    return rows.select(
        recid,
        random_long(NUM_BOUND, seed, recid).alias("num"),
        random_letters(STRING_WIDTH - 1, seed + 1, recid).alias("str"),
        (random_long(100, seed + 3, recid) >= INVALID_IN_HUNDRED).alias("valid"),
        F.floor((recid - 1) / ROWS_PER_BLOCK).alias("block_id"),
        F.lit(True).alias("block_valid"),
    )


def generate_pair(spark: SparkSession, left_blocks: int, right_blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two relations from one seed; their recids overlap, as both start at 1, and nothing else does."""
    return generate_relation(spark, left_blocks, seed), generate_relation(spark, right_blocks, seed + 10)


def generate_relation_sql(n_blocks: int, seed: int) -> str:
    """DuckDB SQL for ``generate_relation``."""
    return f"""select recid, {random_long_sql(NUM_BOUND, seed, "recid")} as num, {random_letters_sql(STRING_WIDTH - 1, seed + 1, "recid")} as str,
  {random_long_sql(100, seed + 3, "recid")} >= {INVALID_IN_HUNDRED} as valid, (recid - 1) // {ROWS_PER_BLOCK} as block_id, true as block_valid from range(1, {n_blocks * ROWS_PER_BLOCK + 1}) t(recid)"""
