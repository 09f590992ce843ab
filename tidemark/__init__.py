"""Relational queries over text and Parquet tables, planned and run by Spark."""

from tidemark.engine import Engine
from tidemark.session import local_session

__all__ = ["Engine", "local_session"]
