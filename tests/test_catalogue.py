"""Every relational query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graniteq.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_goes_without_what_cannot_be_imported(monkeypatch):
    import builtins
    import sys

    import __spark_entry__

    own = builtins.__import__

    def without(name, *args, **kw):
        if name.split(".")[0] in ("ahocorasick", "xxhash", "tokenizers"):
            raise ModuleNotFoundError(f"no {name}", name=name)
        return own(name, *args, **kw)

    for m in [m for m in sys.modules if m.startswith("graniteq.llm") or m in ("corpus_pipeline", "ahocorasick", "xxhash")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and __spark_entry__.oracle_sql() == catalogue.ORACLES


def test_every_relational_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
