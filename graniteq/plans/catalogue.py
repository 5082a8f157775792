"""The relational queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteq.checkpoints import new_folder
from graniteq.operators import distinct_on, equi_join, flatten_pairs, join_with_position, sort_by, sort_chunks, unique_count, with_position
from graniteq.plans import counters_sql
from graniteq.plans.stats import Blocked, dedup_stats, hash_join_stats, merge_join_stats, sort_pass_stats, sort_run_counts
from graniteq.records import ROWS_PER_BLOCK, describe, size_in_blocks, valid_records
from graniteq.sources import generate_pair, generate_relation, generate_relation_sql, read_blocks, table, write_blocks

VALID = "l_partkey % 50 <> 0"
MEMORY = 22

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Sorts: the place in the order is a column, so that a comparison without regard to order still sees it.


def _sort(name: str, source: str, key: list[str], columns: str, valid: str | None = None) -> None:
    others = [c for c in columns.split() if c not in key]
    order = ", ".join(f"{c} nulls first" for c in [*key, *others])
    where = f" where {valid}" if valid else ""
    sql = f"select {', '.join(columns.split())}, row_number() over (order by {order}) as sort_pos from {source}{where}"

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_position(table(spark, sf_dir, source).select(*columns.split()), key, valid=valid)


ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
PART = "p_partkey p_name p_brand p_type p_size p_retailprice"

_sort("sort_int_unique", "orders", ["o_orderkey"], ORDERS)
_sort("sort_int_dups", "lineitem", ["l_partkey"], LINEITEM)
_sort("sort_string", "part", ["p_name"], PART)
_sort("sort_composite", "part", ["p_size", "p_brand"], PART)
_sort("sort_valid_only", "lineitem", ["l_partkey"], LINEITEM, VALID)


@_query("sort_rows", "select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_orderkey")
def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sort_by(rows, "o_custkey", tie_break=["o_orderkey"])


# Joins.


def _joins(kind: str, strategies, left, right, key, right_key, out: dict[str, str], sql: str) -> None:
    """``out``: result columns by the prefixed input columns."""
    for strategy in strategies:

        @_query(f"join_{strategy}_{kind}", sql)
        def run(spark: SparkSession, sf_dir: str, strategy=strategy) -> DataFrame:
            a = table(spark, sf_dir, left[0]).select(*left[1])
            b = table(spark, sf_dir, right[0]).select(*right[1])
            pairs = equi_join(a, b, key, right_key, strategy=strategy, prefixes=("a_", "b_"))
            return pairs.select([F.col(k).alias(v) for k, v in out.items()])


_joins(
    "int_unique",
    ("merge", "hash", "auto"),
    ("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_linenumber"]),
    "o_orderkey",
    "l_orderkey",
    {"a_o_orderkey": "orderkey", "a_o_custkey": "custkey", "a_o_totalprice": "totalprice", "b_l_partkey": "partkey", "b_l_quantity": "quantity", "b_l_linenumber": "linenumber"},
    "select o_orderkey as orderkey, o_custkey as custkey, o_totalprice as totalprice, l_partkey as partkey, l_quantity as quantity, l_linenumber as linenumber from orders join lineitem on o_orderkey = l_orderkey",
)
_joins(
    "int_dups",
    ("merge", "hash"),
    ("supplier", ["s_suppkey", "s_nationkey"]),
    ("customer", ["c_custkey", "c_nationkey"]),
    "s_nationkey",
    "c_nationkey",
    {"a_s_suppkey": "suppkey", "b_c_custkey": "custkey", "a_s_nationkey": "nationkey"},
    "select s_suppkey as suppkey, c_custkey as custkey, s_nationkey as nationkey from supplier join customer on s_nationkey = c_nationkey",
)
_joins(
    "string",
    ("merge", "hash", "broadcast"),
    ("documents", ["doc_id", "text"]),
    ("documents", ["doc_id", "text"]),
    "text",
    "text",
    {"a_doc_id": "left_id", "b_doc_id": "right_id"},
    "select a.doc_id as left_id, b.doc_id as right_id from documents a join documents b on a.text = b.text",
)
_joins(
    "composite",
    ("merge", "hash", "broadcast"),
    ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    ["c_nationkey", "c_mktsegment"],
    ["c_nationkey", "c_mktsegment"],
    {"a_c_custkey": "left_key", "b_c_custkey": "right_key", "a_c_mktsegment": "segment"},
    "select a.c_custkey as left_key, b.c_custkey as right_key, a.c_mktsegment as segment from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment",
)
_joins(
    "small",
    ("broadcast",),
    ("orders", ["o_orderkey", "o_custkey"]),
    ("customer", ["c_custkey", "c_name"]),
    "o_custkey",
    "c_custkey",
    {"a_o_orderkey": "orderkey", "b_c_name": "name"},
    "select o_orderkey as orderkey, c_name as name from orders join customer on o_custkey = c_custkey",
)


@_query(
    "join_valid_only",
    "select o_orderkey as orderkey, l_linenumber as linenumber, l_partkey as partkey from (select * from orders where o_custkey % 50 <> 0) join (select * from lineitem where l_partkey % 50 <> 0) on o_orderkey = l_orderkey",
)
def join_valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = equi_join(orders, lines, "o_orderkey", "l_orderkey", left_valid="o_custkey % 50 <> 0", right_valid=VALID)
    return pairs.select(F.col("o_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"))


@_query("join_empty_side", "select o_orderkey as orderkey, l_partkey as partkey from orders join lineitem on o_orderkey = l_orderkey where false")
def join_empty_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = equi_join(orders, lines, "o_orderkey", "l_orderkey", strategy="merge", right_valid="false")
    return pairs.select(F.col("o_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"))


@_query(
    "join_skewed_key",
    "select l_orderkey as orderkey, l_linenumber as linenumber, l_partkey as partkey, flag from lineitem join (select distinct l_returnflag as flag from lineitem) on l_returnflag = flag",
)
def join_skewed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    flags = distinct_on(lines.select(F.col("l_returnflag").alias("flag")), "flag")
    pairs = equi_join(lines, flags, "l_returnflag", "flag")
    return pairs.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"), "flag")


@_query(
    "join_hot_key",
    """select l_orderkey as line_order, l_linenumber as linenumber, l_partkey as partkey, o_orderkey as orderkey
from (select *, case when l_orderkey % 3 = 0 then 0 else l_orderkey end as k from lineitem) a join (select *, case when o_orderkey % 7500 = 0 then 0 else o_orderkey end as k from orders) b on a.k = b.k""",
)
def join_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the left side has one key, which repeats on the right side too."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("case when l_orderkey % 3 = 0 then 0 else l_orderkey end").alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 7500 = 0 then 0 else o_orderkey end").alias("k"))
    pairs = equi_join(lines, orders, "k", strategy="merge", prefixes=("a_", "b_"), deal_frequent=True)
    return pairs.select(F.col("a_l_orderkey").alias("line_order"), F.col("a_l_linenumber").alias("linenumber"), F.col("a_l_partkey").alias("partkey"), F.col("b_o_orderkey").alias("orderkey"))


@_query(
    "join_merge_in_order",
    "select c_nationkey as nationkey, s_suppkey as suppkey, c_custkey as custkey, row_number() over (order by c_nationkey, s_suppkey, c_custkey) as sort_pos from supplier join customer on s_nationkey = c_nationkey",
)
def join_merge_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pairs = join_with_position(suppliers, customers, "s_nationkey", "c_nationkey")
    return pairs.select(F.col("c_nationkey").alias("nationkey"), F.col("s_suppkey").alias("suppkey"), F.col("c_custkey").alias("custkey"), "sort_pos")


@_query(
    "join_pairs_flat",
    "with p as (select s_suppkey as l, c_custkey as r, s_nationkey as n from supplier join customer on s_nationkey = c_nationkey) select l as pair_left, r as pair_right, 0 as pos, l as key, n as nation from p union all select l, r, 1, r, n from p",
)
def join_pairs_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    pairs = equi_join(a, b, "nation", strategy="hash", prefixes=("l_", "r_"))
    named = pairs.withColumn("pair_left", F.col("l_key")).withColumn("pair_right", F.col("r_key"))
    return flatten_pairs(named, "l_", "r_", ["pair_left", "pair_right"])


for _strategy in ("merge", "hash"):

    @_query(f"join_count_{_strategy}", "select count(*) as nres from orders join lineitem on o_orderkey = l_orderkey")
    def join_count(spark: SparkSession, sf_dir: str, strategy=_strategy) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey")
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
        return equi_join(orders, lines, "o_orderkey", "l_orderkey", strategy=strategy).agg(F.count(F.lit(1)).alias("nres"))


# Duplicate elimination.


def _dedup(name: str, source: str, key: list[str], columns: str, valid: str | None = None) -> None:
    names = columns.split()
    rest = ", ".join(f"{c} nulls first" for c in names if c not in key)
    where = f" where {valid}" if valid else ""
    sql = f"select {', '.join(names)} from (select *, row_number() over (partition by {', '.join(key)} order by {rest}) as place from {source}{where}) where place = 1"

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return distinct_on(table(spark, sf_dir, source).select(*names), key, valid=valid)


DOCUMENTS = "doc_id text lang source n_chars"

_dedup("dedup_int_unique", "orders", ["o_orderkey"], ORDERS)
_dedup("dedup_int_dups", "orders", ["o_custkey"], ORDERS)
_dedup("dedup_string", "part", ["p_name"], PART)
_dedup("dedup_string_long", "documents", ["text"], DOCUMENTS)
_dedup("dedup_composite", "lineitem", ["l_partkey", "l_returnflag"], LINEITEM)
_dedup("dedup_valid_only", "lineitem", ["l_partkey"], LINEITEM, VALID)
_dedup("dedup_all_invalid", "lineitem", ["l_partkey"], LINEITEM, "1 = 0")


@_query("dedup_keys_only", "select distinct l_partkey, l_returnflag from lineitem")
def dedup_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return distinct_on(keys, ["l_partkey", "l_returnflag"])


@_query("dedup_any", "select distinct o_custkey from orders")
def dedup_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_on(table(spark, sf_dir, "orders"), "o_custkey", keep="any").select("o_custkey")


@_query("unique_count", "select count(*) as nunique from (select distinct l_partkey, l_returnflag from lineitem)")
def count_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_count(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"])


# Counters.

_RUNS = f"""with placed as (select (row_number() over (order by o_orderkey) - 1) // {ROWS_PER_BLOCK} as b, o_custkey % 50 <> 0 as valid from orders),
runs as (select b // {MEMORY} as run, count(distinct b) as n_blocks, sum(case when valid then 1 else 0 end)::bigint as n_valid from placed group by 1)
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


_BLOCK, _IS_VALID = f"(sort_pos - 1) div {ROWS_PER_BLOCK}", "o_custkey % 50 <> 0"


@_query("sort_run_counts", _RUNS + "select run, n_blocks, n_valid from runs where n_valid > 0")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_run_counts(_placed(spark, sf_dir), _BLOCK, _IS_VALID, MEMORY)


@_query(
    "sort_pass_stats",
    _RUNS
    + f"""select count(*) as nsorted_segs, 1 + case when count(*) > 1 then ceil(ln(count(*)) / ln({MEMORY - 1}))::bigint else 0 end as npasses,
(select sum(n_blocks) from runs)::bigint + sum(n_blocks)::bigint + case when count(*) > 1 then sum(ceil(n_valid / 100.0) + case when n_valid % 100 = 0 and n_valid // 100 < n_blocks then 1 else 0 end)::bigint + ceil(sum(n_valid) / 100.0)::bigint else 0 end as nios
from runs where n_valid > 0""",
)
def pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL covers inputs of up to 21 runs; the operator itself any number."""
    s = sort_pass_stats(_placed(spark, sf_dir), _BLOCK, _IS_VALID, MEMORY)
    return spark.range(1).select(
        F.lit(s.nsorted_segs).cast("long").alias("nsorted_segs"), F.lit(s.npasses).cast("long").alias("npasses"), F.lit(s.nios).cast("long").alias("nios")
    )


@_query("relation_blocks", f"select ceil(count(*) / {ROWS_PER_BLOCK}.0)::bigint as n_blocks from orders")
def relation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_in_blocks(table(spark, sf_dir, "orders"))


_PLACED_ORDERS = f"(select *, (row_number() over (order by o_orderkey) - 1) // {ROWS_PER_BLOCK} as block from orders)"


@_query(
    "sort_chunk_runs",
    f"select o_orderkey, o_custkey, run, row_number() over (partition by run order by o_custkey, o_orderkey) as run_pos from (select *, block // {MEMORY} as run from {_PLACED_ORDERS}) where o_custkey % 50 <> 0",
)
def sort_chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_chunks(_placed(spark, sf_dir), "o_custkey", _BLOCK, MEMORY, valid=_IS_VALID, tie_break=["o_orderkey"]).select("o_orderkey", "o_custkey", "run", "run_pos")


@_query(
    "sort_valid_blocks",
    f"select o_orderkey, o_custkey, block, row_number() over (order by o_custkey, o_orderkey) as sort_pos from {_PLACED_ORDERS} where block % 7 <> 0 and o_custkey % 50 <> 0",
)
def sort_valid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of validity: that of a row's block, and its own."""
    rows = _placed(spark, sf_dir).select("o_orderkey", "o_custkey", F.expr(_BLOCK).alias("block"), F.expr(_IS_VALID).alias("valid"), F.expr(f"{_BLOCK} % 7 <> 0").alias("block_valid"))
    return with_position(rows, "o_custkey", valid=valid_records(), tie_break=["o_orderkey"]).select("o_orderkey", "o_custkey", "block", "sort_pos")


def _row(spark: SparkSession, *rows: dict) -> DataFrame:
    """A DataFrame of rows of counters, all of whose values are long or text."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def _blocked(spark: SparkSession, sf_dir: str, name: str, place: str, key: str, valid: str = "true") -> Blocked:
    rows = table(spark, sf_dir, name).select(place, F.expr(key).cast("long").alias("k"), F.expr(valid).alias("ok"))
    return Blocked(with_position(rows, place, tie_break=None), _BLOCK, "ok", "k")


def _counted(place: str, key: str, source: str, valid: str = "true") -> str:
    return f"select (row_number() over (order by {place}) - 1) // {ROWS_PER_BLOCK} as b, ({key})::bigint as k, {valid} as ok from {source}"


_ORDERS_BY_CUSTOMER = _counted("o_orderkey", "o_custkey", "orders", "o_custkey % 50 <> 0")


@_query("dedup_stats_in_memory", counters_sql.dedup(_counted("c_custkey", "c_nationkey", "customer"), MEMORY))
def dedup_stats_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In memory up to 22 blocks, sorted beyond. The SQL covers inputs of up to 21 runs; the operator itself any number."""
    s = dedup_stats(_blocked(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), MEMORY)
    return _row(spark, {"nunique": s.nunique, "nios": s.nios})


@_query("dedup_stats_external", counters_sql.dedup(_ORDERS_BY_CUSTOMER, MEMORY))
def dedup_stats_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL covers inputs of up to 21 runs; the operator itself any number."""
    s = dedup_stats(_blocked(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_custkey % 50 <> 0"), MEMORY)
    return _row(spark, {"nunique": s.nunique, "nios": s.nios})


@_query("hash_join_stats", counters_sql.hash_join(_counted("c_custkey", "c_custkey", "customer"), _ORDERS_BY_CUSTOMER, MEMORY))
def hash_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hash_join_stats(_blocked(spark, sf_dir, "customer", "c_custkey", "c_custkey"), _blocked(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_custkey % 50 <> 0"), MEMORY)
    return _row(spark, {"nres": s.nres, "nios": s.nios})


#: name: both sides as (table, place, key)
_MERGES = {
    "merge_join_stats_held": (("customer", "c_custkey", "c_custkey + 300"), ("orders", "o_orderkey", "o_custkey")),
    "merge_join_stats_window": (("orders", "o_orderkey", "o_custkey"), ("events", "event_id", "user_id * 3")),
    "merge_join_stats_moved_back": (("orders", "o_orderkey", "o_custkey % 4"), ("events", "event_id", "event_id % 4 + 1")),
}

for _name, (_left, _right) in _MERGES.items():

    @_query(_name, counters_sql.merge_join(_counted(*_left[1:], _left[0]), _counted(*_right[1:], _right[0]), MEMORY))
    def merge_stats(spark: SparkSession, sf_dir: str, left=_left, right=_right) -> DataFrame:
        """The SQL covers inputs of up to 21 runs; the operator itself any number."""
        s = merge_join_stats(_blocked(spark, sf_dir, *left), _blocked(spark, sf_dir, *right), MEMORY)
        return _row(spark, {"nres": s.nres, "nios": s.nios})


# Block files, printing and the generated relations.


@_query("block_file_round_trip", "select o_orderkey as recid, o_custkey as num, o_orderpriority as str, o_custkey % 50 <> 0 as valid from orders")
def block_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as block files and read again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recid"), F.col("o_custkey").alias("num"), F.col("o_orderpriority").alias("str"), F.expr(_IS_VALID).alias("valid"))
    folder = new_folder(spark, "blocks")
    write_blocks(rows, folder)
    return read_blocks(spark, folder, blocks_per_split=50).select("recid", "num", "str", "valid")


@_query("printed_records", f"select 'BL ' || block_id || ', RC ' || recid || ', ' || num || ', ' || str as line from ({generate_relation_sql(76, 1)}) where valid")
def printed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(generate_relation(spark, 76, seed=1))


@_query("generate_two_relations", f"select 0 as side, recid, num, str, valid, block_id from ({generate_relation_sql(7, 3)}) union all select 1, recid, num, str, valid, block_id from ({generate_relation_sql(5, 13)})")
def generate_two_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (r.drop("block_valid") for r in generate_pair(spark, 7, 5, seed=3))
    return left.select(F.lit(0).alias("side"), "*").union(right.select(F.lit(1).alias("side"), "*"))


DEMO_BLOCKS = (76, 60)


@_query("demo_counters", counters_sql.demo(generate_relation_sql(DEMO_BLOCKS[0], 1), generate_relation_sql(DEMO_BLOCKS[1], 11), MEMORY))
def demo_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a sort by num, a hash join by str, a duplicate elimination by num and str, and a merge join by recid."""
    left, right = generate_pair(spark, *DEMO_BLOCKS, seed=1)
    side = lambda df, key: Blocked(df, "block_id", "valid and block_valid", key)
    sort = sort_pass_stats(left, "block_id", "valid and block_valid", MEMORY)
    hashed, unique = hash_join_stats(side(left, 2), side(right, 2), MEMORY), dedup_stats(side(left, 3), MEMORY)
    merged = merge_join_stats(side(left, 0), side(right, 0), MEMORY)
    found = (("sort", sort), ("hash join", hashed), ("dedup", unique), ("merge join", merged))
    return _row(spark, *({"call": call, "counter": c, "value": v} for call, x in found for c, v in asdict(x).items() if v is not None))


# Composition.


@_query(
    "pipeline_dedup_join_sort",
    """with one as (select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as place from orders) where place = 1),
pairs as (select o_custkey, o_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice from one join lineitem on o_orderkey = l_orderkey)
select *, row_number() over (order by o_custkey, o_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) as sort_pos from pairs""",
)
def pipeline_dedup_join_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = distinct_on(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    pairs = equi_join(one, lines, "o_orderkey", "l_orderkey").drop("l_orderkey")
    return with_position(pairs.select("o_custkey", "o_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"), "o_custkey")


@_query("generate_relation", generate_relation_sql(76, 1))
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_relation(spark, 76, seed=1)
