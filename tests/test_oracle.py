"""Every query of the engine against its SQL on the smallest test tables."""

import decimal
import os

import duckdb
import pytest

from chronoweave import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, decimal.Decimal):
            return int(v)
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(Q.ORACLE[name])
    assert sorted(want.columns) == cols
    assert plain(df.select(cols).collect()) == plain(con.sql(f"select {','.join(cols)} from ({Q.ORACLE[name]})").fetchall())


def test_pipeline_query_runs(spark):
    assert Q.yes_no_pipeline(spark, DATA).columns == ["window", "label", "patient_id", "level", "pattern", "horizontal"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = Q.cohort_yes(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan
