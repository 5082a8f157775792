"""One whole row for each distinct key, and the count of distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteq.keys import resolve_key
from graniteq.records import keep_valid


def distinct_on(
    df: DataFrame,
    key: int | str | Sequence[str],
    valid: Column | str | None = None,
    keep: str = "first",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """One valid row for each distinct key; null keys form a group.

    ``keep`` "first" takes the smallest row by ``order`` and then by all other
    columns (nulls first), which needs orderable columns; "any" takes some row.
    Rows are reduced before they are shuffled, so a frequent key costs no more
    than a rare one.
    """
    names = resolve_key(key, df.columns)
    rows = keep_valid(df, valid)
    if keep == "any":
        return rows.dropDuplicates(names)
    if keep != "first":
        raise ValueError(f"unknown keep {keep!r}: expected 'first' or 'any'")
    if set(names) == set(df.columns):
        return rows.distinct()
    ahead = [c for c in (order or ()) if c not in names]
    rest = [*ahead, *(c for c in df.columns if c not in names and c not in ahead)]
    if "__row" in names:
        raise ValueError("a key column is named '__row'")
    least = rows.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row"))
    return least.select([F.col(f"`{c}`") if c in names else F.col("__row").getField(c).alias(c) for c in df.columns])


def unique_count(df: DataFrame, key: int | str | Sequence[str], valid: Column | str | None = None) -> DataFrame:
    """One row: ``nunique``, the number of distinct keys among valid rows; null counts as a key."""
    names = resolve_key(key, df.columns)
    keys = keep_valid(df, valid).select(*[F.col(f"`{n}`") for n in names]).distinct()
    return keys.agg(F.count(F.lit(1)).alias("nunique"))
