"""Ascending sorts: a total order, sorted runs, and a row's place in the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteq.checkpoints import checkpointed
from graniteq.keys import check_memory_blocks, resolve_key
from graniteq.records import keep_valid

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def _order(df: DataFrame, key, tie_break: Sequence[str] | str | None) -> list[Column]:
    names = resolve_key(key, df.columns)
    if tie_break == "all":
        tie_break = [c for c in df.columns if c not in names]
    return [F.col(f"`{n}`").asc_nulls_first() for n in [*names, *(tie_break or ())]]


def sort_by(
    df: DataFrame,
    key: int | str | Sequence[str],
    valid: Column | str | None = None,
    tie_break: Sequence[str] | str | None = None,
) -> DataFrame:
    """Valid rows in ascending order of ``key``, nulls first.

    Rows with equal keys come in any order unless ``tie_break`` lists further
    columns, or is "all" for every other column.
    """
    return keep_valid(df, valid).sort(*_order(df, key, tie_break))


def sort_runs(
    df: DataFrame,
    key: int | str | Sequence[str],
    n_runs: int | None = None,
    valid: Column | str | None = None,
) -> DataFrame:
    """Valid rows as sorted runs, one for each partition, that follow one another in key order.

    With ``n_runs`` None each existing partition is sorted in place, without a
    shuffle; the runs then overlap.
    """
    rows, order = keep_valid(df, valid), _order(df, key, None)
    if n_runs is not None:
        if n_runs < 1:
            raise ValueError("n_runs must be 1 or more")
        rows = rows.repartitionByRange(n_runs, *order)
    return rows.sortWithinPartitions(*order)


def sort_chunks(
    df: DataFrame,
    key: int | str | Sequence[str],
    block_id: str,
    nmem_blocks: int,
    valid: Column | str | None = None,
    tie_break: Sequence[str] | str | None = "all",
) -> DataFrame:
    """Valid rows with ``run``, the chunk of ``nmem_blocks`` blocks they lie in, and ``run_pos``, their place in it, from 1.

    ``block_id`` is an SQL expression. A chunk, which the memory bounds, is sorted
    in one task.
    """
    check_memory_blocks(nmem_blocks)
    clash = {c.lower() for c in df.columns} & {"run", "run_pos"}
    if clash:
        raise ValueError(f"the columns {sorted(clash)} are there already")
    order = _order(df, key, tie_break)
    rows = keep_valid(df, valid).withColumn("run", F.floor(F.expr(block_id) / nmem_blocks))
    return rows.withColumn("run_pos", F.row_number().over(Window.partitionBy("run").orderBy(*order)).cast("long"))


def with_position(
    df: DataFrame,
    key: int | str | Sequence[str],
    name: str = "sort_pos",
    valid: Column | str | None = None,
    tie_break: Sequence[str] | str | None = "all",
) -> DataFrame:
    """Valid rows with their place, from 1, in the ascending order of ``key``.

    No partition ever holds all rows: each sorted partition numbers its own, and
    the offsets come from the partitions' counts, of which there are as many as
    partitions. The sorted rows are checkpointed, for both uses must see the
    same partitions.
    """
    mark, part, start = "__mark", "__part", "__start"
    _check_free(df, name, mark, part, start)
    local = _numbered(sort_by(df, key, valid, tie_break), mark, part)
    within = F.col(mark) - F.shiftleft(F.col(part), _ROW_BITS)
    placed = local.join(_starts(local, part, F.count(F.lit(1)), start), part).withColumn(name, F.col(start) + within + 1)
    return placed.drop(mark, part, start)


def with_total_before(
    df: DataFrame,
    key: int | str | Sequence[str],
    value: str,
    name: str,
    tie_break: Sequence[str] | str | None = "all",
) -> DataFrame:
    """All rows with the sum of ``value``, a long column, over the rows before theirs in the ascending order of ``key``.

    As in ``with_position``, each sorted partition adds up its own rows.
    """
    mark, part, start, within = "__mark", "__part", "__start", "__within"
    _check_free(df, name, mark, part, start, within)
    local = _numbered(sort_by(df, key, None, tie_break), mark, part)
    before = Window.partitionBy(part).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    summed = local.withColumn(within, F.coalesce(F.sum(value).over(before), F.lit(0)))
    return summed.join(_starts(local, part, F.sum(value), start), part).withColumn(name, F.col(start) + F.col(within)).drop(mark, part, start, within)


def _check_free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the columns {sorted(taken)} are there already")


def _numbered(rows: DataFrame, mark: str, part: str) -> DataFrame:
    """Sorted rows, checkpointed, with a number that rises in their order and the partition they lie in."""
    return checkpointed(rows.withColumn(mark, F.monotonically_increasing_id())).withColumn(part, F.shiftright(mark, _ROW_BITS))


def _starts(local: DataFrame, part: str, total: Column, start: str) -> DataFrame:
    """For each partition the sum of ``total`` over those before it: one row a partition, broadcast."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(part).agg(total.alias("__n"))
    return F.broadcast(sums.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start)))
