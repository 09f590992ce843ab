"""Structured Streaming over text tables: rows as their files arrive.

The batch engine has no streams of its own; this reads the same line format
incrementally, so that a select or project of a table also runs on arrivals.
A bad line fails the stream, as it fails a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.text import checked


def stream_table(spark: SparkSession, folder: str, columns: list[str], files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of int columns over the text files that appear in ``folder``."""
    return checked(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), columns)
