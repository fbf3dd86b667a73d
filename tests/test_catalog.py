"""The entry module: SQL and queries agree on the smallest data, where that is present."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = {k: v for k, v in entry.oracle_sql().items() if not k[:2] in {f"p{n}" for n in range(1, 10)}}


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 5)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(_norm(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    cur = db.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(cols)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_name_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
