import os

import duckdb
import pytest

from treeparity.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    b = sorted(repr([plain(r[want.columns.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b
