"""Every registered query against its SQL, value by value, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from formbook import oracle, queries

QUERIES, SQL = queries.registered(), oracle.statements()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, folder, name):
    _, rows, verdict = compare(spark, duck, folder, name, QUERIES[name], SQL[name])
    assert verdict.startswith("exact"), verdict
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"team", "exp_att", "points"} <= set(df.columns)


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_products(spark, folder, name):
    plan = _plan(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in plan


def test_scans_are_pruned_and_filtered(spark, folder):
    plan = _plan(QUERIES["season_range_filter"](spark, folder))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan
    assert "partial_min" in plan and "partial_max" in plan
