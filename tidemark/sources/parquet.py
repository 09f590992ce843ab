"""Parquet tables of one folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

RELATIONS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_tables(spark: SparkSession, folder: str, names: Iterable[str] = RELATIONS) -> dict[str, DataFrame]:
    """A lazy DataFrame for each ``<folder>/<name>.parquet``."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def register_tables(spark: SparkSession, folder: str, names: Iterable[str] = RELATIONS) -> None:
    """The same tables as temporary views under their own names."""
    for name, df in read_tables(spark, folder, names).items():
        df.createOrReplaceTempView(name)
