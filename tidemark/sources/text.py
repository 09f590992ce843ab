"""Integer tables in delimited text files, described by a schema file.

A line's values stand between commas, blanks or tabs. The cast and the
arity check run inside the scan stage and fail the query on a bad line:
no row is ever dropped or filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hidden column with a row's place in its file.
POSITION = "_pos"


def read_schema(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Column names by table from ``path``: one table a line, its name first.

    Runs of white space separate names and blank lines are skipped. A
    missing file, a table without columns or a repeated name raises.
    """
    tables: dict[str, list[str]] = {}
    for (line,) in spark.read.text(path, wholetext=False).collect():
        names = line.split()
        if not names:
            continue
        table, columns = names[0], names[1:]
        if not columns:
            raise ValueError(f"table {table} has no columns in {path}")
        if table in tables or len({c.lower() for c in columns}) < len(columns):
            raise ValueError(f"a name is repeated in the entry of {table} in {path}")
        tables[table] = columns
    return tables


def _values(line: Column) -> Column:
    """The fields of a line: white space runs count as commas, commas at the end don't count."""
    commas = F.regexp_replace(line, r"\s+", ",")
    return F.split(F.regexp_replace(commas, r",+$", ""), ",", -1)


def checked(lines: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """Lines, in a column ``value``, as int columns, and more columns of the same rows.

    The whole line is checked, whichever columns a query keeps.
    """
    rows = lines.select(_values(F.col("value")).alias("v"), F.col("value").alias("line"), *more)
    valid = (F.size("v") == len(columns)) & F.forall("v", lambda x: x.try_cast("int").isNotNull())
    check = F.assert_true(valid, F.concat(F.lit(f"expected {len(columns)} integers: "), F.col("line")))
    # assert_true gives null when it holds, so coalesce reads on to the value
    fields = [F.coalesce(check.cast("int"), F.get("v", F.lit(i)).cast("int")).alias(c) for i, c in enumerate(columns)]
    return rows.select(*fields, *(F.col(c) for c in rows.columns[2:]))


def read_table(spark: SparkSession, path: str, columns: list[str], position: bool = False) -> DataFrame:
    """Scan a text table as int columns, with ``POSITION`` if asked for.

    The position orders rows as they stand in the file, however the file
    is split: by the split's first byte, then by the order within the task.
    Files need a line for each row; a blank line, an empty field, a
    non-integer or a wrong number of fields fails the query when it runs.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return checked(spark.read.text(path), columns, *([place.alias(POSITION)] if position else []))
