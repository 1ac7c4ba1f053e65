"""Every query with SQL gives the same rows as that SQL in DuckDB, on small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessel import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r.asDict(recursive=True)[c]) for c in columns) for r in df.collect()]
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got, "a comparison of no rows proves nothing"
    want = [tuple(plain(float(x) if type(x).__name__ == "Decimal" else x) for x in (row[names.index(c)] for c in columns)) for row in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) or sorted(got, key=str) == sorted(want, key=str)
