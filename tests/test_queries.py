"""Every registered query over the smallest tables, against its SQL where it has one."""

import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("FX_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(b)
    return a == b


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert len(got) == len(want)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
