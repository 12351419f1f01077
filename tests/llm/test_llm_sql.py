"""Queries with SQL, on the smallest tables, and the registry."""

from __future__ import annotations

import os

import pytest

from weftnet.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda found, names: sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in found)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), columns)


def test_ten_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
