"""Predicates as columns, for plans built without SQL text."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six comparisons, by their SQL signs.
COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(left: Column | str | float, sign: str, right: Column | str | float) -> Column:
    """A comparison of columns (strings are column names) and literals on either side."""
    sides = [F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (left, right)]
    return COMPARISONS[sign](*sides)


def all_of(*conditions: Column) -> Column:
    """Conjunction; true without conditions."""
    return reduce(operator.and_, conditions, F.lit(True))
