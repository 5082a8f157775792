"""Embedding near-dedup: rows that share an id, dense cells and extra columns, against brute force and SQL."""

import random

import duckdb
import numpy as np
import pytest

from graniteq.llm import catalogue, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_rows(rows, least=0.98):
    """(id, n_links, component_id, kept) of each row, by comparing all pairs of rows."""
    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    near = [[j for j in range(n) if j != i and rows[i][2] == rows[j][2] is not None and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        c = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), c, c == rows[i][0]))
    return sorted(out)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (0, [0.01, 1.0, 0.0], 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalogue.QUERIES["op3_embedding_dedup"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert got == by_rows(rows) and (2, 1, 1, False) in got
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(out.columns)} from ({catalogue.ORACLES['op3_embedding_dedup']})").fetchall())


@pytest.mark.parametrize("cell_rows", [2, 50, 16384])
def test_repeated_ids_and_dense_cells_equal_brute_force(spark, cell_rows):
    r, q = np.random.default_rng(4), random.Random(4)
    rows = []
    for _ in range(5):
        c = r.normal(size=24)
        rows += [(q.randrange(80), (c + r.normal(size=24) * s).astype(np.float32).tolist(), q.choice([1, 1, 2])) for s in r.choice([0, 0.03, 0.1, 0.15, 0.3], 40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cid", "2 as Label", "3 as VEC_ID", "4 as grp", "5 as key")
    assert sorted(map(tuple, embedding_dedup.link_vectors(df, cell_rows=cell_rows).collect())) == by_rows(rows)


def test_recall_at_the_least_cosine():
    """Pairs of a cosine of exactly 0.98 meet in a cell of one of the tables."""
    r = np.random.default_rng(5)
    for dims in (16, 64, 256):
        x, z = r.normal(size=(2, 3000, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = embedding_dedup.cells(x), embedding_dedup.cells(y)
        met = (a == b[:, :, :1]).any((1, 2)) | (b == a[:, :, :1]).any((1, 2))
        assert met.mean() > 0.995
