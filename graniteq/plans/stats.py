"""Counters of the operators: result rows, sorted runs, passes and block transfers.

They describe operators that work in a memory of so many blocks. Everything is
computed from counts of blocks, runs and keys; no rows are joined for them, and
what reaches the driver are single rows of sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graniteq.keys import check_memory_blocks, resolve_key
from graniteq.operators.sort import with_position
from graniteq.records import ROWS_PER_BLOCK


@dataclass(frozen=True)
class OpStats:
    """Counters of one sort: runs with valid rows, passes, blocks read and written."""

    nsorted_segs: int
    npasses: int
    nios: int


@dataclass(frozen=True)
class DedupStats:
    """Counters of one duplicate elimination: distinct keys, blocks read and written."""

    nunique: int
    nios: int


@dataclass(frozen=True)
class JoinStats:
    """Counters of one join: pairs, and blocks read and written; None where these depend on how keys are hashed."""

    nres: int
    nios: int | None


@dataclass(frozen=True)
class Blocked:
    """A relation whose rows lie in blocks: SQL expressions for a row's block and its validity, and the key."""

    rows: DataFrame
    block_id: str
    valid: str
    key: int | str | Sequence[str]


def observed_count(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get["n"]`` is its row count after the next action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def sort_run_counts(df: DataFrame, block_id: str, valid: str, nmem_blocks: int) -> DataFrame:
    """A row for each memory-sized chunk with valid rows: run, n_blocks, n_valid.

    ``block_id`` and ``valid`` are SQL expressions over the columns of ``df``.
    """
    check_memory_blocks(nmem_blocks)
    blocks = df.groupBy(F.expr(block_id).alias("b")).agg(F.sum(F.expr(valid).cast("long")).alias("v"))
    runs = blocks.groupBy(F.floor(F.col("b") / nmem_blocks).alias("run"))
    counts = runs.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("v").alias("n_valid"))
    return counts.filter("n_valid > 0")


def sort_pass_stats(df: DataFrame, block_id: str, valid: str, nmem_blocks: int) -> OpStats:
    """Counters of an external merge sort of ``df`` with a memory of ``nmem_blocks`` blocks.

    A chunk of ``nmem_blocks`` blocks becomes a run; ``nmem_blocks - 1`` runs are
    merged at a time. Counted are blocks: each chunk read, each chunk with valid
    rows written, and at each merge the blocks read up to the end of the valid
    rows and those written; a merge that is not its pass's last one, in a pass
    that isn't the last, fills its output to the full length. What reaches the
    driver at once is one row of sums; the runs stay a DataFrame.
    """
    return _sorted(df, block_id, valid, nmem_blocks)[0]


def _full(rows: int) -> int:
    """Blocks for so many rows."""
    return -(-rows // ROWS_PER_BLOCK)


def _blocks(df: DataFrame, block_id: str) -> int:
    return df.select(F.expr(block_id).alias("b")).distinct().count()


def _sorted(df: DataFrame, block_id: str, valid: str, nmem_blocks: int, nunique: int | None = None) -> tuple[OpStats, int]:
    """Counters of a sort, and the blocks of its result.

    With ``nunique`` the last pass writes only so many rows, and there is one even
    if a single run is left.
    """
    check_memory_blocks(nmem_blocks)
    full = lambda c: F.ceil(F.col(c) / ROWS_PER_BLOCK)
    runs = sort_run_counts(df, block_id, valid, nmem_blocks)
    segs, written, rows = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum("n_valid"), F.lit(0))).first()
    nios, npasses, left, length = _blocks(df, block_id) + written, 1, segs, nmem_blocks
    size = written if segs < 2 else _full(rows)
    runs = runs.select(F.col("run").alias("at"), F.col("n_blocks").alias("b"), F.col("n_valid").alias("v"))
    ways = nmem_blocks - 1
    while left > 1 or (left == 1 and nunique is not None):
        last_pass = left <= ways
        # A run's number among those with valid rows; as many tasks number them as it takes.
        merged = with_position(runs, "at", "place", tie_break=None).withColumn("to", F.floor((F.col("place") - 1) / ways)).withColumn(
            "read", full("v") + (((F.col("v") % ROWS_PER_BLOCK) == 0) & (full("v") < F.col("b"))).cast("long")
        )
        merged = merged.groupBy("to").agg(F.sum("read").alias("read"), F.sum("v").alias("v"))
        groups = -(-left // ways)
        padded = F.lit(not last_pass) & (F.col("to") < groups - 1)
        out = F.lit(_full(nunique)) if last_pass and nunique is not None else full("v")
        merged = merged.withColumn("b", F.when(padded, F.lit(length * ways)).otherwise(out))
        nios += merged.agg(F.sum(F.col("read") + F.col("b"))).first()[0]
        if last_pass and nunique is not None:
            return OpStats(int(segs), npasses + 1, int(nios)), _full(nunique)
        runs = merged.select(F.col("to").alias("at"), "b", "v")
        left, length, npasses = groups, length * ways, npasses + 1
    return OpStats(int(segs), npasses, int(nios)), int(size)


def dedup_stats(relation: Blocked, nmem_blocks: int) -> DedupStats:
    """Counters of eliminating duplicate keys.

    A relation of at most ``nmem_blocks`` blocks is read once and its distinct rows
    are written. A larger one is sorted, and the last pass writes distinct rows only.
    """
    check_memory_blocks(nmem_blocks)
    df = relation.rows
    names = resolve_key(relation.key, df.columns)
    nunique = df.filter(F.expr(relation.valid)).select(*[F.col(f"`{n}`") for n in names]).distinct().count()
    blocks = _blocks(df, relation.block_id)
    if blocks <= nmem_blocks:
        return DedupStats(nunique, blocks + _full(nunique))
    return DedupStats(nunique, _sorted(df, relation.block_id, relation.valid, nmem_blocks, nunique)[0].nios)


def _keys(relation: Blocked) -> DataFrame:
    """(k, n): each key among valid rows, as a struct, and how often it occurs."""
    names = resolve_key(relation.key, relation.rows.columns)
    k = F.struct(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)])
    return relation.rows.filter(F.expr(relation.valid)).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(left: DataFrame, right: DataFrame) -> int:
    """Pairs of rows with equal keys; a null in a key matches nothing."""
    known = lambda d: d.filter(" and ".join(f"k.{f.name} is not null" for f in d.schema["k"].dataType))
    both = known(left).join(known(right).select("k", F.col("n").alias("m")), "k")
    return int(both.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0])


def hash_join_stats(left: Blocked, right: Blocked, nmem_blocks: int) -> JoinStats:
    """Counters of a hash join.

    If a side leaves two of the memory's blocks free, the smaller one is read into
    a hash table, the other one past it, and the pairs are written, two records
    each. Otherwise both are partitioned by a hash of the key; how many blocks that
    moves isn't a fact about the relations, so ``nios`` is None.
    """
    check_memory_blocks(nmem_blocks)
    sizes = [_blocks(x.rows, x.block_id) for x in (left, right)]
    if not all(sizes):
        return JoinStats(0, 0)
    nres = _pairs(_keys(left), _keys(right))
    return JoinStats(nres, sum(sizes) + _full(2 * nres) if min(sizes) < nmem_blocks - 1 else None)


def _up_to(keys: DataFrame, greatest) -> int:
    """Rows whose key is at most ``greatest``."""
    top = F.struct(*[F.lit(x).alias(f.name) for x, f in zip(greatest, keys.schema["k"].dataType, strict=True)])
    return int(keys.filter(F.col("k") <= top).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def merge_join_stats(left: Blocked, right: Blocked, nmem_blocks: int) -> JoinStats:
    """Counters of a merge join.

    If a side leaves two of the memory's blocks free, one side is held and sorted in
    memory (the larger, if both could be) and the other one is sorted outside and
    read past it. Otherwise both are sorted outside; the one that is then larger is
    read block by block past a window on the other, of ``nmem_blocks - 2`` blocks. The
    window moves on with the keys, and back wherever a key that repeats has left it.
    Reading ends with the last key that may match. Pairs are written, two records each.
    """
    check_memory_blocks(nmem_blocks)
    sides = (left, right)
    sizes = [_blocks(x.rows, x.block_id) for x in sides]
    if not all(sizes):
        return JoinStats(0, 0)
    keys = [_keys(x) for x in sides]
    nres = _pairs(*keys)
    (rows0, top0), (rows1, top1) = (k.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("k")).first() for k in keys)
    rows, tops = (int(rows0), int(rows1)), (top0, top1)
    sort = lambda i: _sorted(sides[i].rows, sides[i].block_id, sides[i].valid, nmem_blocks)
    last_read = lambda stop, size: min(size, stop // ROWS_PER_BLOCK + 1)
    fits = [s < nmem_blocks - 1 for s in sizes]
    if any(fits):
        held = (0 if sizes[0] >= sizes[1] else 1) if all(fits) else (0 if sizes[0] < sizes[1] else 1)
        stats, size = sort(1 - held)
        nios = stats.nios + sizes[held]
        if rows[held] and size:
            nios += last_read(_up_to(keys[1 - held], tops[held]), size) + _full(2 * nres)
        return JoinStats(nres, nios)
    sorts = [sort(i) for i in (0, 1)]
    nios = sum(s.nios for s, _ in sorts)
    if not all(size for _, size in sorts):
        return JoinStats(nres, nios)
    small = 0 if sorts[0][1] <= sorts[1][1] else 1
    size, other = sorts[small][1], sorts[1 - small][1]
    window = min(size, nmem_blocks - 2)
    stop = _up_to(keys[1 - small], tops[small])
    reached = rows[small] if stop < rows[1 - small] else _up_to(keys[small], tops[1 - small])
    nios += last_read(stop, other) + max(window, last_read(reached, size)) + _full(2 * nres)
    return JoinStats(nres, nios + _moved_back(sides[small], keys[1 - small], size, window))


def _moved_back(small: Blocked, others: DataFrame, size: int, window: int) -> int:
    """Blocks read again for keys whose rows span more than the window, each time that the other side repeats them."""
    names = resolve_key(small.key, small.rows.columns)
    rows = small.rows.filter(F.expr(small.valid)).select(F.struct(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)]).alias("k"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (window - 1) * ROWS_PER_BLOCK)
    if not counts.limit(1).count():
        return 0
    spans = with_position(rows, "k", "place", tie_break=None).groupBy("k").agg((F.min("place") - 1).alias("first"), F.max("place").alias("last"))
    first, last = F.floor(F.col("first") / ROWS_PER_BLOCK), F.least(F.floor(F.col("last") / ROWS_PER_BLOCK), F.lit(size - 1))
    beyond = spans.select("k", (last - first - window + 1).alias("x")).filter("x > 0").join(others, "k")
    again = (F.col("n") - 1) * (F.least("x", F.lit(window)) + F.col("x"))
    return int(beyond.agg(F.coalesce(F.sum(again), F.lit(0))).first()[0])
