"""Counters against a step-by-step model; block files as a round trip."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graniteq import equi_join
from graniteq.plans import OpStats, observed_count, sort_pass_stats
from graniteq.records import describe
from graniteq.sources import generate_relation, read_blocks, table_exists, write_blocks


def model(counts, blocks, memory):
    """Counters from the valid rows of each block, by going through the passes."""
    runs, nios = [], blocks
    for at in range(0, blocks, memory):
        chunk = counts[at : at + memory]
        if sum(chunk):
            runs.append((sum(chunk), len(chunk)))
            nios += len(chunk)
    segs, passes, length, ways = len(runs), 1, memory, memory - 1
    while len(runs) > 1:
        last_pass, out = len(runs) <= ways, []
        for i in range(0, len(runs), ways):
            group = runs[i : i + ways]
            nios += sum(math.ceil(v / 100) + (v % 100 == 0 and math.ceil(v / 100) < b) for v, b in group)
            v = sum(x for x, _ in group)
            b = math.ceil(v / 100) if last_pass or i + ways >= len(runs) else length * ways
            nios += b
            out.append((v, b))
        runs, length, passes = out, length * ways, passes + 1
    return OpStats(segs, passes, nios)


@pytest.mark.parametrize(("blocks", "memory", "p"), [(0, 3, 1), (5, 3, 1), (30, 3, 0.9), (23, 4, 0.5), (12, 3, 0), (9, 22, 0.98)])
def test_pass_counters(spark, blocks, memory, p):
    r = random.Random(blocks)
    counts = [sum(r.random() < p for _ in range(100)) if i % 5 else 100 * (p > 0) for i in range(blocks)]
    rows = [(b, i < n) for b, n in enumerate(counts) for i in range(100)]
    df = spark.createDataFrame(rows, "b long, ok boolean")
    assert sort_pass_stats(df, "b", "ok", memory) == model(counts, blocks, memory)


def test_too_little_memory(spark):
    with pytest.raises(ValueError):
        sort_pass_stats(spark.range(1), "id", "true", 2)


def test_observed_pairs(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    pairs, seen = observed_count(equi_join(a, a, "k", prefixes=("l_", "r_")))
    pairs.collect()
    assert seen.get["n"] == 5


def test_block_files_round_trip(spark, tmp_path):
    df = generate_relation(spark, 3, seed=9).limit(250).coalesce(1)
    write_blocks(df, str(tmp_path / "out"))
    files = sorted(p for p in (tmp_path / "out").iterdir())
    assert len(files) == 1 and files[0].stat().st_size == 3 * 13220
    back = read_blocks(spark, str(files[0]), blocks_per_split=2)
    assert back.rdd.getNumPartitions() == 2
    columns = ["recid", "num", "str", "valid"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, df.select(columns).collect()))
    assert back.agg(F.max("block_id")).first()[0] == 2
    assert sorted(r.line for r in describe(back).collect()) == sorted(f"BL {r.block_id}, RC {r.recid}, {r.num}, {r.str}" for r in back.collect() if r.valid)
    assert sorted(map(tuple, read_blocks(spark, f"file://{tmp_path}/out").select(columns).collect())) == sorted(map(tuple, df.select(columns).collect()))
    assert table_exists(spark, str(files[0])) and not table_exists(spark, str(tmp_path / "none"))


def test_many_files_and_odd_texts(spark, tmp_path):
    rows = [(2**32 - 1 - i, i, t, i % 3 > 0) for i, t in enumerate(["", "a", "é" * 59, "x" * 119, "naïve"] * 90)]
    df = spark.createDataFrame(rows, "recid long, num long, str string, valid boolean").repartition(3)
    write_blocks(df, f"file:{tmp_path}/many")
    back = read_blocks(spark, f"{tmp_path}/many").select("recid", "num", "str", "valid")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(FileExistsError):
        write_blocks(df, f"{tmp_path}/many")
    with pytest.raises(Exception, match="at most 119"):
        write_blocks(spark.createDataFrame([(1, 1, "x" * 120, True)], df.schema), f"{tmp_path}/long")


def test_block_file_of_a_wrong_size(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        read_blocks(spark, str(tmp_path / "x")).collect()
