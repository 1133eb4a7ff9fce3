"""Every query of the core with SQL gives the rows that DuckDB gives for it; the others give rows."""

import collections
import datetime
import math
import os

import duckdb
import pytest

from docskein.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    answer = duck.execute(registry.SQL[name])
    names = [d[0] for d in answer.description]
    assert columns == sorted(names)
    places = [names.index(c) for c in columns]
    assert got == collections.Counter(tuple(plain(r[i]) for i in places) for r in answer.fetchall())


def test_flagship(spark, data):
    assert registry.FLAGSHIP in registry.QUERIES
