"""Relational operators over DataFrames."""

from tidemark.operators.relational import collect_rows, dump, join, project, scan, select, sort, unique

__all__ = ["collect_rows", "dump", "join", "project", "scan", "select", "sort", "unique"]
