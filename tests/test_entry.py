"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from weftwork.plans.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def _plain(rows, columns):
    return sorted(str(tuple("~" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in (r[c] for c in columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _plain([r.asDict() for r in df.collect()], sorted(names)) == _plain([dict(zip(names, r)) for r in want.fetchall()], sorted(names))
