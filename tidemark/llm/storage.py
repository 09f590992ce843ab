"""Intermediate tables in the folder that the cluster shares.

A written table ends the lineage: a lost executor costs the tasks it ran,
not the work before the table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written so far within ``passing``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode without one, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.gettempdir() + "/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    The table stays until the folder is cleaned, as checkpoint files do,
    unless it is written within ``passing``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _passing.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within are removed at the end, also of a failure, but for those that are taken out of the list."""
    made: list[str] = []
    token = _passing.set(made)
    try:
        yield made
    finally:
        _passing.reset(token)
        for path in made:
            remove(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``make`` returns, written; tables that it wrote on the way are removed.

    Nothing else may go on reading those: ``make`` returns all that is needed.
    """
    with passing(spark) as made:
        out = written(make(), name)
        path = made.pop()
    outer = _passing.get()
    if outer is not None:
        outer.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
