"""Every named relational query against DuckDB, and the plans it should get."""

import duckdb
import pytest

import __spark_entry__
from tidemark.plans.catalogue import CATALOGUE, run
from tidemark.sources.parquet import RELATIONS
from tidemark.statements import STATEMENTS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in RELATIONS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CATALOGUE)
def test_rows_equal_the_oracle(spark, oracle, name):
    got = run(name, spark, DATA)
    want = oracle.execute(CATALOGUE[name][1])
    assert got.columns == [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.fetchall()))


@pytest.mark.parametrize("name", STATEMENTS)
def test_statements_equal_the_oracle(spark, oracle, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    want = oracle.execute(__spark_entry__.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    rows = sorted(tuple(str(x) for x in r) for r in got.collect())
    assert rows and rows == sorted(tuple(str(x) for x in r) for r in want.fetchall())


@pytest.mark.parametrize(("name", "column", "descending"), [("order_by_asc", "p_size", False), ("order_by_join", "s_acctbal", False), ("distinct_order_by", "o_orderstatus", False)])
def test_sorted_by_the_key(spark, name, column, descending):
    values = [r[column] for r in run(name, spark, DATA).collect()]
    assert values == sorted(values, reverse=descending)


def test_descending_by_a_column_that_is_not_kept(spark):
    nation = {r.c_custkey: r.c_nationkey for r in run("scan_region", spark, DATA).sparkSession.read.parquet(f"{DATA}/customer.parquet").collect()}
    keys = [nation[r.c_custkey] for r in run("order_by_desc_unprojected", spark, DATA).collect()]
    assert keys == sorted(keys, reverse=True)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "PushedFilters: [IsNotNull(c_nationkey), LessThan(c_nationkey,5)" in plan(run("join_three_way_filter", spark, DATA))
    assert "Cartesian" not in plan(run("join_comma_equi", spark, DATA))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan(run("distinct_column", spark, DATA))
    assert "<empty>" in plan(run("filter_const_false", spark, DATA))
    assert "Python" not in plan(run("join_three_way", spark, DATA))
    assert plan(run("distinct_self_theta_ne", spark, DATA)).count("HashAggregate") >= 2  # nations meet, and not suppliers


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
