"""A catalog of text tables and the batch run of a script over it."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.ordered import PLACED, ordered_select
from tidemark.plans.script import lexemes, split_statements
from tidemark.sources.sink import write_single_file
from tidemark.sources.text import POSITION, read_schema, read_table

log = logging.getLogger(__name__)


@dataclass
class Outcome:
    """What became of one statement: its number from 1, and rows written or the error."""

    number: int
    statement: str
    rows: int | None = None
    error: Exception | None = None


class Engine:
    """SQL over the tables of one database folder.

    ``<folder>/schema.txt`` names tables and columns, ``<folder>/data/<table>``
    has the rows. Opening another folder replaces the tables of the first.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.tables: dict[str, list[str]] = {}
        self.unreadable: dict[str, AnalysisException] = {}
        if folder is not None:
            self.open(folder)

    def open(self, folder: str) -> None:
        """Register every table as a view. Files are read when a query runs.

        A table without its file has no view: statements that name it fail.
        """
        found = read_schema(self.spark, f"{folder}/schema.txt")
        for name in {**self.tables, **found}:
            self.spark.catalog.dropTempView(name)
            self.spark.catalog.dropTempView(name + PLACED)
        self.tables, self.unreadable = {}, {}
        for name, columns in found.items():
            path = f"{folder}/data/{name}"
            try:
                read_table(self.spark, path, columns).createOrReplaceTempView(name)
            except AnalysisException as e:
                log.error("table %s can't be read: %s", name, e)
                self.unreadable[name] = e
                continue
            read_table(self.spark, path, columns, position=True).select(*columns, POSITION).createOrReplaceTempView(name + PLACED)
            self.tables[name] = columns

    def sql(self, statement: str, preserve_order: bool = False) -> DataFrame:
        """The lazy result of one SELECT."""
        begin = "".join(x for x, _ in lexemes(statement)).lstrip("( \t\r\n").upper()  # behind comments
        if not begin.startswith(("SELECT", "WITH", "VALUES")):
            raise ValueError(f"only SELECT statements run here: {statement}")
        try:
            return ordered_select(self.spark, statement) if preserve_order else self.spark.sql(statement)
        except AnalysisException as e:
            for name, reason in self.unreadable.items():
                if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" and f"`{name}`".lower() in str(e).lower().replace(PLACED.lower(), ""):
                    raise reason from e
            raise

    def run_script(self, text: str, output: str, preserve_order: bool = False) -> list[Outcome]:
        """Write the result of statement i to ``<output>/query<i>``.

        A statement that fails is logged, leaves no file and does not stop
        the rest. Other files in the folder are left alone.
        """
        os.makedirs(output, exist_ok=True)
        outcomes = []
        for i, statement in enumerate(split_statements(text), 1):
            path = f"{output}/query{i}"
            try:
                outcomes.append(Outcome(i, statement, rows=write_single_file(self.sql(statement, preserve_order), path)))
            except Exception as e:  # the rest of the batch goes on
                log.error("statement %d failed: %s", i, e)
                if os.path.exists(path):
                    os.unlink(path)
                outcomes.append(Outcome(i, statement, error=e))
        return outcomes


def run_batch(spark: SparkSession, folder: str, output: str, preserve_order: bool = False) -> list[Outcome]:
    """Run ``<folder>/queries.sql`` over the tables in ``<folder>/db``."""
    engine = Engine(spark, f"{folder}/db")
    with open(f"{folder}/queries.sql", encoding="utf-8") as f:
        return engine.run_script(f.read(), output, preserve_order)
