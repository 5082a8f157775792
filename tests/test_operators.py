"""Operators against a plain Python model, over random and edge relations."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graniteq import distinct_on, equi_join, flatten_pairs, join_with_position, sort_by, sort_chunks, sort_runs, unique_count, with_position
from graniteq.plans import catalogue, plan_nodes
from graniteq.records import RECORD_SCHEMA, valid_records
from graniteq.sources import generate_relation

FIELDS = {0: ("recid",), 1: ("num",), 2: ("str",), 3: ("num", "str")}
STRINGS = ["", "a", "B", "ab", "z", "é", "x" * 119]


def relation(seed, n, keys=6):
    r = random.Random(seed)
    return [(i + 1 if r.random() < 0.9 else 2**31 + i, r.randrange(keys), r.choice(STRINGS), r.random() < 0.9, i // 100, r.random() < 0.9) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def live(rows):
    return [r for r in rows if r[3] and r[5]]


def key_of(row, field):
    k = {"recid": row[0], "num": row[1], "str": row[2].encode()}
    return tuple(k[c] for c in FIELDS[field])


EDGES = {
    "empty": [],
    "all invalid": [(i, i, "a", False, i // 100, True) for i in range(300)],
    "invalid block": [(i, i, "a", True, 0, False) for i in range(50)],
    "one key": [(i, 7, "same", True, 0, True) for i in range(120)],
    "random": relation(1, 400),
}


@pytest.mark.parametrize("field", FIELDS)
@pytest.mark.parametrize("name", EDGES)
def test_sort_is_a_sorted_permutation(spark, name, field):
    rows = EDGES[name]
    out = [tuple(r) for r in sort_by(frame(spark, rows), field, valid=valid_records()).collect()]
    assert Counter(out) == Counter(live(rows))
    assert [key_of(r, field) for r in out] == sorted(key_of(r, field) for r in out)


def test_positions_follow_the_order(spark):
    rows = EDGES["random"]
    out = with_position(frame(spark, rows), 3, valid=valid_records()).orderBy("sort_pos").collect()
    assert [r.sort_pos for r in out] == list(range(1, len(live(rows)) + 1))
    assert [(r.num, r.str.encode()) for r in out] == sorted((r[1], r[2].encode()) for r in live(rows))


def test_runs_follow_one_another(spark):
    out = sort_runs(frame(spark, EDGES["random"]), "num", 3).withColumn("p", F.spark_partition_id()).collect()
    keys = [r.num for r in sorted(out, key=lambda r: r.p)]
    assert keys == sorted(keys)
    nodes = plan_nodes(sort_runs(frame(spark, EDGES["random"]), "num"))
    assert "Sort" in nodes and "Exchange" not in nodes


@pytest.mark.parametrize("field", FIELDS)
@pytest.mark.parametrize("strategy", ["auto", "merge", "hash", "broadcast"])
def test_join_makes_all_pairs(spark, field, strategy):
    a, b = relation(2, 90), relation(3, 70)
    pairs = equi_join(frame(spark, a), frame(spark, b), field, strategy=strategy, left_valid=valid_records(), right_valid=valid_records(), prefixes=("l_", "r_"))
    by = defaultdict(list)
    for r in live(b):
        by[key_of(r, field)].append(r)
    expected = Counter(x + y for x in live(a) for y in by[key_of(x, field)])
    assert Counter(tuple(r) for r in pairs.collect()) == expected


@pytest.mark.parametrize(("strategy", "node"), [("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")])
def test_strategy_reaches_the_plan(spark, strategy, node):
    a = generate_relation(spark, 1, seed=1)  # a size that the optimizer knows
    assert node in plan_nodes(equi_join(a, a, 1, strategy=strategy, prefixes=("l_", "r_")))


@pytest.mark.parametrize("key", ["k", ["k", "s"], ["d", "k"], ["k", "s", "d"]])
def test_small_sides_are_dealt_to_all_tasks_of_a_broadcast_join(spark, tmp_path, key):
    r = random.Random(3)
    rows = [(i % 7 or None, r.choice([None, "", "a", "b"]), r.choice([0.0, -0.0, 1.5]), i % 40) for i in range(300)]
    spark.createDataFrame(rows, "k long, s string, d double, v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select(*({"k", "s", "d", "v"} if key == "k" else ("v", "d", "s", "k") if key != ["k", "s", "d"] else key))
    names = [key] if isinstance(key, str) else key
    out = equi_join(df, df, key, strategy="broadcast", prefixes=("l_", "r_"))
    at = [df.columns.index(n) for n in names]
    own = [tuple(x) for x in df.collect()]
    pairs = Counter(map(repr, (x + y for x in own for y in own if all(x[i] is not None and x[i] == y[i] for i in at))))
    assert Counter(repr(tuple(x)) for x in out.collect()) == pairs and out.columns == [p + c for p in ("l_", "r_") for c in df.columns]
    assert "BroadcastHashJoin" in plan_nodes(out)
    assert len({x.p for x in out.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 3


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k long, v long")
    assert [tuple(r) for r in equi_join(a, a, "k", prefixes=("l_", "r_")).collect()] == [(1, 2, 1, 2)]


def test_flat_pairs_alternate(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, s string")
    flat = flatten_pairs(equi_join(a, a, "k", prefixes=("l_", "r_")).withColumn("id", F.col("l_k")), "l_", "r_", ["id"])
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 0, 1, "x"), (1, 1, 1, "x"), (2, 0, 2, "y"), (2, 1, 2, "y")]


def test_joined_rows_in_order(spark):
    a, b = frame(spark, relation(4, 60)), frame(spark, relation(5, 60))
    keys = [r.l_num for r in equi_join(a, b, 1, prefixes=("l_", "r_"), in_order=True).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("field", FIELDS)
@pytest.mark.parametrize("name", EDGES)
def test_one_smallest_row_for_each_key(spark, name, field):
    rows = EDGES[name]
    df = frame(spark, rows)
    out = [tuple(r) for r in distinct_on(df, field, valid=valid_records(), order=["recid"]).collect()]
    least = {}
    for r in live(rows):
        k = key_of(r, field)
        least[k] = min(least.get(k, r), r, key=lambda x: (x[0], x[1], x[2].encode(), *x[3:]))
    assert Counter(out) == Counter(least.values())
    assert unique_count(df, field, valid_records()).first().nunique == len(least)
    assert distinct_on(df, field, valid=valid_records(), keep="any").count() == len(least)


def test_dedup_reduces_before_the_shuffle(spark):
    nodes = plan_nodes(distinct_on(frame(spark, EDGES["random"]), 1))
    assert len([n for n in nodes if "Aggregate" in n]) == 2


def test_wrong_arguments(spark):
    df = frame(spark, EDGES["random"])
    for key in (4, -1, True, "none", [], ["num", "num"]):
        with pytest.raises(ValueError):
            sort_by(df, key)
    with pytest.raises(ValueError):
        equi_join(df, df, 1)
    with pytest.raises(ValueError):
        equi_join(df, df, 1, strategy="nested", prefixes=("l_", "r_"))
    with pytest.raises(ValueError):
        distinct_on(df, 1, keep="last")


def test_names_that_clash_or_hold_dots(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 3, "z")], "`a.b` long, k long, `c d` string")
    assert sorted(map(tuple, distinct_on(df, "a.b").collect())) == [(1, 1, "y"), (2, 3, "z")]
    assert unique_count(df, "a.b").first().nunique == 2
    assert [r[0] for r in sort_by(df, "a.b", tie_break="all").collect()] == [1, 1, 2]
    assert sorted(r.sort_pos for r in with_position(df, "a.b").collect()) == [1, 2, 3]
    pairs = equi_join(df, df, "a.b", prefixes=("l_", "r_"))
    assert pairs.count() == 5 and flatten_pairs(pairs.withColumn("p.q", F.lit(1)), "l_", "r_", ["p.q"]).count() == 10
    for name in ("sort_pos", "SORT_POS", "__mark", "__start"):
        with pytest.raises(ValueError):
            with_position(df.withColumn(name, F.lit(1)), "k")
    with pytest.raises(ValueError):
        equi_join(df.select("k"), df.select(F.col("k").alias("K")), "k", "K")
    with pytest.raises(ValueError):
        sort_chunks(df.withColumn("Run", F.lit(1)), "k", "k", 3)


def test_hot_key_on_both_sides(spark):
    a = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    b = spark.range(4000).selectExpr("id", "if(id % 400 = 0, 0, id) as k")
    out = equi_join(a, b, "k", strategy="merge", prefixes=("l_", "r_"))
    assert "SortMergeJoin" in plan_nodes(out) and out.count() == 1334 * 10 + sum(1 for i in range(4000) if i % 3 and i % 400)


def test_frequent_keys_are_dealt_out_to_tasks(spark, monkeypatch):
    monkeypatch.setattr("graniteq.operators.join.CELL_ROWS", 20)
    monkeypatch.setattr("graniteq.operators.join.MAX_BROADCAST_BYTES", 0)
    r = random.Random(5)
    a, b = ([(r.choice([None, 0, 0, 0, 1, 2, i]), r.choice(["x", "y"]), i) for i in range(n)] for n in (400, 150))
    left, right = spark.createDataFrame(a, "k long, s string, v long"), spark.createDataFrame(b, "k int, s string, v long")
    for key, same in (("k", lambda x, y: x[0] == y[0]), (["k", "s"], lambda x, y: x[:2] == y[:2])):
        for strategy in ("auto", "merge", "hash", "broadcast"):
            out = equi_join(left, right, key, strategy=strategy, prefixes=("l_", "r_"), deal_frequent=True)
            assert Counter(map(tuple, out.collect())) == Counter(x + y for x in a for y in b if x[0] is not None and same(x, y))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = catalogue.QUERIES["join_hot_key"](spark, "/root/testdata/sf0.001")
        counts = [x["count"] for x in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert "SortMergeJoin" in plan_nodes(out) and len(counts) == 8 and max(counts) < sum(counts) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hash_tables_are_built_of_sides_of_a_checked_size_only(spark):
    a, b = (spark.range(10**13).withColumnRenamed("id", x) for x in "ab")
    assert "ShuffledHashJoin" not in plan_nodes(equi_join(a, b, "a", "b", strategy="hash"))


@pytest.mark.parametrize("rows_of_a_cell", [3, 4096])
def test_places_of_pairs_need_no_sort_of_pairs(spark, monkeypatch, rows_of_a_cell):
    monkeypatch.setattr("graniteq.operators.join.CELL_ROWS", rows_of_a_cell)
    monkeypatch.setattr("graniteq.operators.join.PAIRS_PER_TASK", 100)
    r = random.Random(7)
    left = [(r.choice([None, "a", "b"]), r.choice([1, 1, 1, 2, 3, 5, None]), r.choice([0.5, 2.5])) for _ in range(60)]
    right = [(r.choice([1, 1, 2, 4, 5, None]), r.choice([None, 10, 20, 30])) for _ in range(50)]
    a, b = spark.createDataFrame(left, "s string, k int, v double"), spark.createDataFrame(right, "k long, w long")
    out = join_with_position(a, b, "k", name="at", prefixes=("l_", "r_"))
    nodes = plan_nodes(out)
    assert "SortMergeJoin" in nodes and out.columns == ["l_s", "l_k", "l_v", "r_k", "r_w", "at"]
    least = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    order = lambda p: (p[1], (p[0] is not None, p[0] or ""), p[2], least(p[4]))
    pairs = sorted((x + y for x in left for y in right if x[1] is not None and x[1] == y[0]), key=order)
    assert sorted((tuple(x) for x in out.collect()), key=lambda x: x[-1]) == [(*p, i) for i, p in enumerate(pairs, 1)]
    assert join_with_position(a, b.limit(0), "k", prefixes=("l_", "r_")).count() == 0
    with pytest.raises(ValueError):
        join_with_position(a, b, "k")


def test_ordered_join_query_stores_no_pairs(spark):
    assert "SortMergeJoin" in plan_nodes(catalogue.QUERIES["join_merge_in_order"](spark, "/root/testdata/sf0.001"))


def test_generated_relation(spark):
    df = generate_relation(spark, 3, seed=5)
    rows = df.collect()
    assert [r.recid for r in rows] == list(range(1, 301)) and rows == generate_relation(spark, 3, seed=5).repartition(3).sort("recid").collect()
    assert all(0 <= r.num < 100_000 and 1 <= len(r.str) <= 119 and r.str.isalpha() and r.str.islower() for r in rows)
    assert 0.9 < sum(r.valid for r in rows) / 300 < 1 and {r.block_id for r in rows} == {0, 1, 2}
