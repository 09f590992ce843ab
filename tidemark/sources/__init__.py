"""Tables read from text and Parquet, and results written as text."""

from tidemark.sources.parquet import read_tables, register_tables
from tidemark.sources.sink import write_directory, write_single_file
from tidemark.sources.text import POSITION, read_schema, read_table

__all__ = ["POSITION", "read_schema", "read_table", "read_tables", "register_tables", "write_directory", "write_single_file"]
