"""Results as comma-separated lines without a header."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame) -> DataFrame:
    """One string column; repeated column names are told apart by place, nulls print as nothing."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain.columns)).alias("value"))


def write_single_file(df: DataFrame, path: str) -> int:
    """Write ``df`` in its order to one local file and return the number of rows.

    Rows come to the driver a partition at a time. The file appears only
    when the last row is written, so a failing query leaves none.
    """
    folder = os.path.dirname(os.path.abspath(path))
    handle, partial = tempfile.mkstemp(prefix=".partial-", dir=folder)
    rows = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            for (line,) in _lines(df).toLocalIterator():
                out.write(line + "\n")
                rows += 1
        os.chmod(partial, 0o644)
        os.replace(partial, path)
    except BaseException:
        os.unlink(partial)
        raise
    return rows


def write_directory(df: DataFrame, path: str) -> None:
    """The same lines as part files, written by the executors: for results of any size."""
    _lines(df).write.mode("overwrite").text(path)
