"""Column expressions for texts that keep their work inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_totals(values: Column) -> Column:
    """The sums of each array of longs up to and including each place.

    Sums blocks of values first, so that the arrays that grow stay short.
    """
    return let(values, _totals)


def _totals(values: Column) -> Column:
    zero = F.array(F.lit(0).cast("long"))
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    within = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, F.lit(_BLOCK)), zero, add))
    whole = F.aggregate(within, zero, lambda acc, block: add(acc, F.element_at(block, -1)))
    return let(whole, lambda before: F.flatten(F.transform(within, lambda block, i: F.transform(F.slice(block, F.lit(2), F.lit(_BLOCK)), lambda x: x + F.get(before, i)))))


def blocks_of_spans(spans: Column) -> Column:
    """Structs whose first field is start, and that have end, by start in blocks of few: first (start), reach (largest end), spans.

    Whoever looks for spans about a place can pass over most blocks.
    """

    def block(rows: Column) -> Column:
        return F.struct(F.get(rows, F.lit(0))["start"].alias("first"), F.array_max(F.transform(rows, lambda x: x["end"])).alias("reach"), rows.alias("spans"))

    def cut(ordered: Column) -> Column:
        starts = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: let(F.slice(ordered, s, F.lit(_BLOCK)), block))

    return let(F.array_sort(spans), cut)


def words_of(lowered: Column) -> Column:
    """Runs of a to z, digits and characters beyond ASCII, in order.

    Splitting at what stands between them takes an eighth of the time of matching them.
    """
    return F.array_remove(F.split(lowered, SEPARATOR, -1), "")


SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
