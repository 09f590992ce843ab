"""Scan, select, project, join, sort and duplicate elimination.

Each operator adds one node to a lazy plan and decides nothing physical:
pushdown, pruning, the join algorithm, partial aggregation and spilling are
Catalyst's and AQE's. A plan of these may be run any number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, table: str, alias: str | None = None) -> DataFrame:
    """A registered table, under ``alias`` or its own name."""
    return spark.table(table).alias(alias or table)


def select(child: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true."""
    return child.filter(condition)


def project(child: DataFrame, *items: Column | str) -> DataFrame:
    """Columns by name or expression, in any order and number; ``*`` is all."""
    return child.select(*(F.expr(x) if isinstance(x, str) and x != "*" else x for x in items))


def join(left: DataFrame, right: DataFrame, condition: Column | str | None = None, how: str = "inner") -> DataFrame:
    """Columns of the left, then of the right, for pairs that meet the condition; all pairs without one.

    An equality in the condition, or in a later select, becomes a hash or
    sort-merge join. Only a condition without one is a nested loop.
    """
    if condition is None:
        return left.crossJoin(right)
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, how)


def sort(child: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows by the keys; a string may end in ASC or DESC. Ties come in any order."""
    return child.orderBy(*(sort_key(k) if isinstance(k, str) else k for k in keys))


def sort_key(text: str) -> Column:
    """A key as ORDER BY has it; nulls come first ascending and last descending."""
    head, _, tail = text.strip().rpartition(" ")
    if tail.upper() in ("ASC", "DESC") and head:
        return F.expr(head).desc() if tail.upper() == "DESC" else F.expr(head).asc()
    return F.expr(text).asc()


def unique(child: DataFrame) -> DataFrame:
    """Rows without duplicates, wherever they stand: partial aggregation, one shuffle, final aggregation."""
    return child.distinct()


def collect_rows(df: DataFrame) -> list[Row]:
    """All rows at the driver, for results known to be small."""
    return df.collect()


def dump(df: DataFrame, rows: int = 20) -> None:
    """Print rows."""
    df.show(rows, truncate=False)
