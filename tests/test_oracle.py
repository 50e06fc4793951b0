"""Every core query with SQL gives DuckDB's rows."""

import os

import pytest

from textquarry import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted((tuple(one(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(core.SQL[name])
    assert found == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(core.QUERIES) <= set(e.queries())
