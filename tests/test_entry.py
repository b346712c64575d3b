"""Every query against its SQL on the smallest test tables, where they are there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TIDELOG_TESTDATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def told(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    result = sql.execute(entry.oracle_sql()[name])
    at = [x[0] for x in result.description]
    assert sorted(at) == names
    want = sorted((tuple(told(r[at.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(told, r)) for r in df.select(*names).collect()), key=repr) == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_needs_the_text_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/tidelog/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "tidelog.llm" not in f.read(), path
