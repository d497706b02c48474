"""Every network query with SQL against DuckDB, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from kinweave.plans import queries as network

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return float(v)
    return round(float(v), 9) + 0.0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(network.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = network.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(network.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(network.queries()) - set(network.oracle_sql())))
def test_has_rows(spark, name):
    assert network.queries()[name](spark, DATA).count() > 0
