"""Rows that every operator has to bear, and small helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"

#: Columns besides doc_id and text that are named like operators' own.
SCHEMA = "score double, doc_id long, text string, lang string, size int, keys string, gone string, id long, hash string, length int, rank int"

LONG = "word " * 30_000


def edge_rows() -> list[tuple[int | None, str | None]]:
    return [(1, None), (2, ""), (3, "   \n\n "), (None, "a text without an id"), (None, None), (4, "repeated row"), (4, "repeated row"), (5, LONG), (6, "naïve 日本語 — \U0001f600"), (7, "x")]


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with clashing extra columns around them."""
    return spark.createDataFrame([(0.5, i, t, None, 1, "k", "g", 9, "h", 2, 3) for i, t in rows], SCHEMA)


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))
