"""Named queries over the relational test tables.

Each is built with the DataFrame operators; beside it stands SQL of the same
meaning, for another engine to check the rows against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import all_of, compare
from tidemark.operators import join, project, select, sort, unique
from tidemark.sources import read_tables


class Tables(dict[str, DataFrame]):
    """The Parquet tables of a folder, each opened when a plan first names it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = read_tables(self.spark, self.folder, [name])[name].alias(name)
        return self[name]


Plan = Callable[[Tables], DataFrame]

CATALOGUE: dict[str, tuple[Plan, str]] = {}


def query(sql: str) -> Callable[[Plan], Plan]:
    def enter(plan: Plan) -> Plan:
        CATALOGUE[plan.__name__] = (plan, sql)
        return plan

    return enter


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The lazy result of a query over the Parquet tables of a folder."""
    return CATALOGUE[name][0](Tables(spark, folder))


def _customer_orders(t: Tables) -> DataFrame:
    return join(t["customer"], t["orders"], compare("c_custkey", "=", "o_custkey"))


def _customer_orders_lineitem(t: Tables) -> DataFrame:
    return join(_customer_orders(t), t["lineitem"], compare("o_orderkey", "=", "l_orderkey"))


def _supplier_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t["supplier"].alias("s1"), t["supplier"].alias("s2")


@query("SELECT * FROM region")
def scan_region(t: Tables) -> DataFrame:
    return t["region"]


@query("SELECT * FROM lineitem")
def scan_lineitem(t: Tables) -> DataFrame:
    return t["lineitem"]


@query("SELECT part.p_partkey FROM part")
def project_column(t: Tables) -> DataFrame:
    return project(t["part"], "part.p_partkey")


@query("SELECT s.s_suppkey FROM supplier s")
def project_alias(t: Tables) -> DataFrame:
    return project(t["supplier"].alias("s"), "s.s_suppkey")


@query("SELECT nation.n_name, nation.n_nationkey FROM nation")
def project_reorder(t: Tables) -> DataFrame:
    return project(t["nation"], "nation.n_name", "nation.n_nationkey")


@query("SELECT * FROM part p WHERE p.p_size < 10")
def filter_lt_literal(t: Tables) -> DataFrame:
    return select(t["part"], compare("p_size", "<", 10))


@query("SELECT * FROM part p WHERE p.p_size <= 10")
def filter_le_literal(t: Tables) -> DataFrame:
    return select(t["part"], compare("p_size", "<=", 10))


@query("SELECT * FROM part p WHERE p.p_size > 40")
def filter_gt_literal(t: Tables) -> DataFrame:
    return select(t["part"], compare("p_size", ">", 40))


@query("SELECT * FROM part p WHERE p.p_size >= 40")
def filter_ge_literal(t: Tables) -> DataFrame:
    return select(t["part"], compare("p_size", ">=", 40))


@query("SELECT * FROM customer c WHERE c.c_nationkey = 7")
def filter_eq_literal(t: Tables) -> DataFrame:
    return select(t["customer"], compare("c_nationkey", "=", 7))


@query("SELECT * FROM customer c WHERE c.c_nationkey != 7")
def filter_ne_literal(t: Tables) -> DataFrame:
    return select(t["customer"], compare("c_nationkey", "<>", 7))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l WHERE l.l_linenumber >= l.l_quantity")
def filter_column_column(t: Tables) -> DataFrame:
    return project(select(t["lineitem"], compare("l_linenumber", ">=", "l_quantity")), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l.l_orderkey, l.l_partkey FROM lineitem l WHERE l.l_quantity > 10 AND l.l_quantity <= 20 AND l.l_linenumber = 1")
def filter_and_chain(t: Tables) -> DataFrame:
    wanted = all_of(compare("l_quantity", ">", 10), compare("l_quantity", "<=", 20), compare("l_linenumber", "=", 1))
    return project(select(t["lineitem"], wanted), "l_orderkey", "l_partkey")


@query("SELECT l.l_orderkey FROM lineitem l WHERE l.l_quantity >= l.l_linenumber AND l.l_quantity < l.l_linenumber")
def filter_contradiction(t: Tables) -> DataFrame:
    wanted = all_of(compare("l_quantity", ">=", "l_linenumber"), compare("l_quantity", "<", "l_linenumber"))
    return project(select(t["lineitem"], wanted), "l_orderkey")


@query("SELECT * FROM orders WHERE 1 = 2")
def filter_const_false(t: Tables) -> DataFrame:
    return select(t["orders"], compare(1, "=", 2))


@query("SELECT * FROM orders WHERE 1 = 1")
def filter_const_true(t: Tables) -> DataFrame:
    return select(t["orders"], compare(1, "=", 1))


@query("SELECT * FROM region, nation")
def cross_join(t: Tables) -> DataFrame:
    return join(t["region"], t["nation"])


@query("SELECT * FROM customer, orders WHERE customer.c_custkey = orders.o_custkey")
def join_comma_equi(t: Tables) -> DataFrame:
    return select(join(t["customer"], t["orders"]), compare("c_custkey", "=", "o_custkey"))


@query("SELECT * FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_on_equi(t: Tables) -> DataFrame:
    return _customer_orders(t)


@query("SELECT * FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey")
def join_three_way(t: Tables) -> DataFrame:
    return _customer_orders_lineitem(t)


@query("SELECT * FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND c.c_nationkey < 5")
def join_three_way_filter(t: Tables) -> DataFrame:
    return select(_customer_orders_lineitem(t), compare("c_nationkey", "<", 5))


@query("SELECT s1.s_suppkey AS left_key, s2.s_suppkey AS right_key FROM supplier s1, supplier s2 WHERE s1.s_suppkey < s2.s_suppkey")
def join_theta_self(t: Tables) -> DataFrame:
    left, right = _supplier_pairs(t)
    pairs = join(left, right, compare("s1.s_suppkey", "<", "s2.s_suppkey"))
    return project(pairs, F.col("s1.s_suppkey").alias("left_key"), F.col("s2.s_suppkey").alias("right_key"))


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey < 2")
def join_project_filter(t: Tables) -> DataFrame:
    pairs = join(t["supplier"], t["nation"], compare("s_nationkey", "=", "n_nationkey"))
    return project(select(pairs, compare("n_regionkey", "<", 2)), "s_suppkey", "n_nationkey")


@query("SELECT DISTINCT o.o_custkey FROM orders o")
def distinct_column(t: Tables) -> DataFrame:
    return unique(project(t["orders"], "o_custkey"))


@query("SELECT DISTINCT * FROM nation")
def distinct_star(t: Tables) -> DataFrame:
    return unique(t["nation"])


@query("SELECT DISTINCT c.c_nationkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey")
def distinct_join(t: Tables) -> DataFrame:
    return unique(project(_customer_orders(t), "c_nationkey"))


@query("SELECT DISTINCT s1.s_nationkey AS left_nation, s2.s_nationkey AS right_nation FROM supplier s1, supplier s2 WHERE s1.s_suppkey > s2.s_suppkey AND s1.s_nationkey != s2.s_nationkey")
def distinct_self_theta_ne(t: Tables) -> DataFrame:
    # a supplier of one nation is above one of another exactly if the largest is above the least: nations meet, and not suppliers
    ends = t["supplier"].groupBy("s_nationkey").agg(F.min("s_suppkey").alias("least"), F.max("s_suppkey").alias("largest"))
    left, right = project(ends, F.col("s_nationkey").alias("left_nation"), "largest"), project(ends, F.col("s_nationkey").alias("right_nation"), "least")
    return project(join(left, right, all_of(compare("largest", ">", "least"), compare("left_nation", "!=", "right_nation"))), "left_nation", "right_nation")


@query("SELECT * FROM part ORDER BY part.p_size")
def order_by_asc(t: Tables) -> DataFrame:
    return sort(t["part"], "part.p_size")


@query("SELECT * FROM part p WHERE p.p_size <= 20 ORDER BY p.p_size, p.p_partkey")
def order_by_multi(t: Tables) -> DataFrame:
    return sort(select(t["part"], compare("p_size", "<=", 20)), "p_size", "p_partkey")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey ORDER BY c.c_nationkey DESC")
def order_by_desc_unprojected(t: Tables) -> DataFrame:
    return project(sort(_customer_orders(t), "c_nationkey DESC"), "c_custkey", "o_orderkey")


@query("SELECT * FROM supplier s, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey ORDER BY s.s_acctbal")
def order_by_join(t: Tables) -> DataFrame:
    placed = join(t["supplier"], t["nation"], compare("s_nationkey", "=", "n_nationkey"))
    return sort(join(placed, t["region"], compare("n_regionkey", "=", "r_regionkey")), "s_acctbal")


@query("SELECT DISTINCT o.o_orderpriority, o.o_orderstatus FROM orders o ORDER BY o.o_orderstatus")
def distinct_order_by(t: Tables) -> DataFrame:
    return sort(unique(project(t["orders"], "o_orderpriority", "o_orderstatus")), "o_orderstatus")
