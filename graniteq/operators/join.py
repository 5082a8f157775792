"""Inner equi-joins on the same key columns of both inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteq.checkpoints import checkpointed
from graniteq.keys import resolve_key
from graniteq.operators.sort import with_position, with_total_before
from graniteq.records import keep_valid

_HINTS = {"merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast"}
STRATEGIES = ("auto", *_HINTS)

#: A side is broadcast only up to this many bytes by the optimizer's estimate.
MAX_BROADCAST_BYTES = 64 << 20


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A partition of the side that is built into a hash table may have this many bytes on average; a merge spills beyond.
MAX_BUILD_PARTITION_BYTES = 256 << 20


def _hash_limit(df: DataFrame) -> int:
    return MAX_BUILD_PARTITION_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def equi_join(
    left: DataFrame,
    right: DataFrame,
    key: int | str | Sequence[str],
    right_key: int | str | Sequence[str] | None = None,
    strategy: str = "auto",
    left_valid: Column | str | None = None,
    right_valid: Column | str | None = None,
    prefixes: tuple[str, str] | None = None,
    in_order: bool = False,
    deal_frequent: bool = False,
) -> DataFrame:
    """Every pair of valid rows with equal keys; null keys match nothing.

    ``right_key`` names the right side's columns where they differ, one for each
    of ``key``. The strategy "merge" sorts both sides, "hash" builds a hash table
    from the smaller one in each partition, "broadcast" sends the right side to
    every executor (a left side as small is dealt out to all tasks, for the pairs may be many); where the estimated sizes don't allow one of these two, the
    sides are merged. "auto" leaves the choice to the optimizer. ``prefixes`` go before every column name
    of the left and the right side, which tells clashing names apart; without
    them a name in both inputs raises ValueError. ``in_order`` sorts the result
    by the left key. ``deal_frequent`` counts the keys of both sides first and deals
    out the rows of frequent ones in cells of CELL_ROWS rows of either side, which a
    merge or hash join's tasks share, whatever the sizes in bytes.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}: expected one of {STRATEGIES}")
    left_names = resolve_key(key, left.columns)
    right_names = resolve_key(key if right_key is None else right_key, right.columns)
    if len(left_names) != len(right_names):
        raise ValueError(f"keys differ in length: {left_names} and {right_names}")
    first, second = prefixes or ("", "")
    clash = {(first + c).lower() for c in left.columns} & {(second + c).lower() for c in right.columns}  # Spark heeds no case
    if clash:
        raise ValueError(f"both sides have columns named {sorted(clash)}; give prefixes")
    a = _prefixed(keep_valid(left, left_valid), first)
    b = _prefixed(keep_valid(right, right_valid), second)
    if strategy == "broadcast" and _estimated_bytes(b) > MAX_BROADCAST_BYTES:
        strategy = "merge"
    if strategy == "hash" and min(map(_estimated_bytes, (a, b))) > _hash_limit(a):
        strategy = "merge"
    if strategy == "broadcast" and _estimated_bytes(a) <= MAX_BROADCAST_BYTES:
        pairs = _broadcast_groups(a, b, [first + x for x in left_names], [second + y for y in right_names])
    else:
        columns, cells = [*a.columns, *b.columns], []
        if deal_frequent and strategy != "broadcast":
            a, b, cells = _in_cells(a, b, [first + x for x in left_names], [second + y for y in right_names])
        if strategy != "auto":
            b = b.hint(_HINTS[strategy])
        equal = [F.col(f"`{first}{x}`") == F.col(f"`{second}{y}`") for x, y in zip(left_names, right_names, strict=True)]
        pairs = a.join(b, [*equal, *cells], "inner").select(*[F.col(f"`{c}`") for c in columns])
    return pairs.sort(*[F.col(f"`{first}{x}`") for x in left_names]) if in_order else pairs


#: A key's rows are dealt out by so many of each side, each such part of the left meeting each of the right in a cell of its own.
CELL_ROWS = 4096

#: Tasks are as many as it takes for so many pairs in each, on average.
PAIRS_PER_TASK = 1 << 23


def join_with_position(
    left: DataFrame,
    right: DataFrame,
    key: int | str | Sequence[str],
    right_key: int | str | Sequence[str] | None = None,
    name: str = "sort_pos",
    prefixes: tuple[str, str] = ("", ""),
) -> DataFrame:
    """The pairs of a merge join with their place, from 1, in ascending order of the key, the left's other columns and the right's.

    The pairs are neither sorted nor stored. A left row's pairs follow those of the
    left rows before it, which the keys' counts give; within them the place is the
    right row's own among those of its key (equal left rows take turns). No task
    gets more of a frequent key than cells of CELL_ROWS rows of either side.
    """
    first, second = prefixes
    names = resolve_key(key, left.columns)
    others = resolve_key(key if right_key is None else right_key, right.columns)
    if len(names) != len(others):
        raise ValueError(f"keys differ in length: {names} and {others}")
    columns = [*(first + c for c in left.columns), *(second + c for c in right.columns), name]
    if len({c.lower() for c in columns}) < len(columns):
        raise ValueError(f"both sides have columns of one name, or one named {name!r}; give prefixes")
    # Both sides get names of their own: l0, l1 ... and r0, r1 ...; k0, k1 ... are the keys.
    at, to = [left.columns.index(n) for n in names], [right.columns.index(n) for n in others]
    known = lambda df, keys: df.dropna("any", subset=keys)
    lk, rk = [f"l{i}" for i in at], [f"r{i}" for i in to]
    a = known(left.toDF(*(f"l{i}" for i in range(len(left.columns)))), lk)
    b = known(right.toDF(*(f"r{i}" for i in range(len(right.columns)))), rk)
    same = lambda keys: [F.col(x) == F.col(f"k{i}") for i, x in enumerate(keys)]

    b = with_position(b, rk, "place")
    found = a.groupBy(*[F.col(x).alias(f"j{i}") for i, x in enumerate(lk)]).agg(F.count(F.lit(1)).alias("n_left"))
    keys = b.groupBy(*[F.col(x).alias(f"k{i}") for i, x in enumerate(rk)]).agg(F.count(F.lit(1)).alias("n_right"), F.min("place").alias("at"))
    keys = keys.join(found, [F.col(f"k{i}") == F.col(f"j{i}") for i in range(len(lk))]).drop(*(f"j{i}" for i in range(len(lk))))
    parts = lambda n: F.ceil(F.col(n) / CELL_ROWS)
    keys = checkpointed(keys.select("*", parts("n_left").alias("lefts"), parts("n_right").alias("rights")))
    n_pairs = keys.agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] or 0
    n_tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // PAIRS_PER_TASK))

    a = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("times"))
    a = a.join(keys, same(lk)).withColumn("n", F.col("times") * F.col("n_right"))
    a = with_total_before(a.select(*(f"l{i}" for i in range(len(left.columns))), "times", "lefts", "rights", "n"), lk, "n", "before")
    a = a.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") * F.col("rights") - 1)))
    a = a.withColumn("turn", F.floor(F.col("copy") / F.col("rights"))).withColumn("cell_right", F.col("copy") % F.col("rights"))
    a = a.withColumn("cell_left", F.pmod(F.xxhash64(*(f"l{i}" for i in range(len(left.columns))), "turn"), F.col("lefts")))
    b = b.join(keys.select(*(f"k{i}" for i in range(len(rk))), "at", F.col("lefts").alias("n_lefts"), F.col("rights").alias("n_rights")), same(rk))
    b = b.withColumn("rank", F.col("place") - F.col("at")).withColumn("part_right", F.col("rank") % F.col("n_rights"))
    b = b.withColumn("part_left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lefts") - 1)))
    a = a.select(*(f"l{i}" for i in range(len(left.columns))), "times", "turn", "before", "cell_left", "cell_right").repartition(n_tasks, *lk, "cell_left", "cell_right")
    b = b.select(*(f"r{i}" for i in range(len(right.columns))), "rank", "part_left", "part_right").repartition(n_tasks, *rk, "part_left", "part_right")
    equal = [F.col(x) == F.col(y) for x, y in zip([*lk, "cell_left", "cell_right"], [*rk, "part_left", "part_right"], strict=True)]
    place = F.col("before") + F.col("rank") * F.col("times") + F.col("turn") + 1
    kept = [*(f"l{i}" for i in range(len(left.columns))), *(f"r{i}" for i in range(len(right.columns)))]
    return a.join(b.hint("merge"), equal).select(*kept, place).toDF(*columns)


def _in_cells(left: DataFrame, right: DataFrame, left_names: list[str], right_names: list[str]) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides with the cells of their rows, and the conditions by which cells meet.

    A key's rows of a side make one part for every CELL_ROWS of them. A row lies in
    one part of its own side, by a hash of the whole row, and is repeated for each
    part of the other side: two rows more for every CELL_ROWS pairs, at most about.
    The keys that have more than one part are broadcast.
    """

    def parts(df: DataFrame, names: list[str], tag: str) -> DataFrame:
        counts = df.groupBy(*[F.col(f"`{n}`").alias(f"__{tag}{i}") for i, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("__n"))
        return counts.filter(F.col("__n") > CELL_ROWS).withColumn(f"__{tag}", F.ceil(F.col("__n") / CELL_ROWS)).drop("__n")

    def dealt(df: DataFrame, names: list[str], own: str, other: str, cell: str) -> DataFrame:
        rows = df
        for tag, side, keys in (("p", left, left_names), ("q", right, right_names)):
            rows = rows.join(F.broadcast(parts(side, keys, tag)), [F.col(f"`{n}`") == F.col(f"__{tag}{i}") for i, n in enumerate(names)], "left")
        n_own, n_other = (F.coalesce(f"__{x}", F.lit(1).cast("long")) for x in (own, other))
        part = F.when(n_own > 1, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), n_own)).otherwise(0)
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(f"{cell}_{own}"), F.explode(F.sequence(F.lit(0).cast("long"), n_other - 1)).alias(f"{cell}_{other}"))

    a, b = dealt(left, left_names, "p", "q", "__l"), dealt(right, right_names, "q", "p", "__r")
    return a, b, [F.col(f"__l_{x}") == F.col(f"__r_{x}") for x in "pq"]


#: Equal keys of these types are the same value; others may differ in bits (0.0 and -0.0).
_EXACT = {"boolean", "tinyint", "smallint", "int", "bigint", "date", "timestamp", "string", "binary"}


def _broadcast_groups(left: DataFrame, right: DataFrame, left_names: list[str], right_names: list[str]) -> DataFrame:
    """A broadcast join of two small sides, which may make many pairs all the same.

    A small left side lies in one or two splits, whose tasks would make all pairs:
    it is dealt out in the order of its keys and rows. The right side's rows are
    broadcast as one list for each key, which takes a look-up for each left row
    rather than a step through a hash table for each pair.
    """
    spark = left.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    a = left.repartitionByRange(n_tasks, *[F.col(f"`{c}`") for c in [*left_names, *(c for c in left.columns if c not in left_names)]])
    types, group = dict(right.dtypes), [f"__k{i}" for i in range(len(right_names))]
    listed = [c for c in right.columns if c not in right_names or types[c] not in _EXACT] or right.columns
    rows = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(listed)])).alias("__rows")
    b = right.groupBy(*[F.col(f"`{y}`").alias(k) for k, y in zip(group, right_names, strict=True)]).agg(rows)
    pairs = a.join(F.broadcast(b), [F.col(f"`{x}`") == F.col(k) for x, k in zip(left_names, group, strict=True)])
    pairs = pairs.select(*[F.col(f"`{c}`") for c in left.columns], *group, F.explode("__rows").alias("__row"))
    of_right = [F.col("__row").getField(f"r{listed.index(c)}") if c in listed else F.col(group[right_names.index(c)]) for c in right.columns]
    return pairs.select(*[F.col(f"`{c}`") for c in left.columns], *[x.alias(c) for x, c in zip(of_right, right.columns, strict=True)])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def flatten_pairs(pairs: DataFrame, left_prefix: str, right_prefix: str, pair_id: Sequence[str]) -> DataFrame:
    """Two rows for each pair, ``pos`` 0 from its left and 1 from its right side.

    Both sides must have the same columns behind their prefixes. ``pair_id``
    names columns of ``pairs`` that are kept, to tell which rows belong together.
    """
    if left_prefix == right_prefix or not left_prefix or not right_prefix:
        raise ValueError("the two prefixes must differ and not be empty")
    names = [c.removeprefix(left_prefix) for c in pairs.columns if c.startswith(left_prefix)]
    others = [c.removeprefix(right_prefix) for c in pairs.columns if c.startswith(right_prefix)]
    if set(names) != set(others):
        raise ValueError(f"the sides differ: {names} and {others}")
    side = lambda p: F.struct(*[F.col(f"`{p}{n}`").alias(n) for n in names])
    kept = [F.col(f"`{c}`") for c in pair_id]
    flat = pairs.select(*kept, F.posexplode(F.array(side(left_prefix), side(right_prefix))).alias("pos", "__row"))
    return flat.select(*kept, "pos", *[F.col("__row").getField(n).alias(n) for n in names])
