"""Every query that has SQL gives the SQL's rows over the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
NAMES = sorted(n for n, f in entry.queries().items() if "llm" not in f.__module__)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["child", "image_id", "group_id", "period", "state"]
