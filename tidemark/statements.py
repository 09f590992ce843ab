"""Named statements that run as SQL text over the relational test tables, as users' statements do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Engine
from tidemark.sources.parquet import register_tables

STATEMENTS: dict[str, str] = {
    "sql_decimal_literal": "SELECT p.p_partkey FROM part p WHERE p.p_size < 10.5",
    "sql_literal_left": "SELECT p.p_partkey FROM part p WHERE 10 > p.p_size AND 3 <= p.p_size",
    "sql_repeated_items": "SELECT n.n_nationkey AS one, n.n_nationkey AS two, n.n_name FROM nation n",
    "sql_star_and_column": "SELECT r.*, r.r_regionkey AS again FROM region r",
    "sql_left_join": "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey < 2",
    "sql_right_join": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_suppkey < 10",
    "sql_full_join": "SELECT s.s_suppkey, n.n_name FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_suppkey < 10 AND n.n_regionkey < 2",
    "sql_semi_join": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "sql_join_using": "SELECT a.r_name, b.r_regionkey AS same FROM region a JOIN region b USING (r_regionkey)",
    "sql_group_by_having": "SELECT c.c_nationkey, count(*) AS customers FROM customer c GROUP BY c.c_nationkey HAVING count(*) > 5",
    "sql_order_by_limit": "SELECT o.o_orderkey FROM orders o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 7",
    "sql_distinct_order_by": "SELECT DISTINCT o.o_custkey, o.o_orderstatus FROM orders o ORDER BY o.o_orderstatus, o.o_custkey",
    "sql_theta_self_join": "SELECT a.n_nationkey AS less, b.n_nationkey AS more FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "sql_order_by_desc": "/* after a comment */ SELECT p.p_partkey, p.p_size FROM part p WHERE p.p_size >= 40 ORDER BY p.p_size DESC",
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The lazy result of a statement over the Parquet tables of a folder."""
    register_tables(spark, folder)
    return Engine(spark).sql(STATEMENTS[name])
