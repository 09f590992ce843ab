"""Statements: splitting scripts, running them, and rows in a fixed order."""

from tidemark.plans.ordered import Select, ordered_select, parse_select
from tidemark.plans.script import split_statements

__all__ = ["Select", "ordered_select", "parse_select", "split_statements"]
