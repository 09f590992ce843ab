"""The corpus pipeline: documents through filters and deduplication into packed sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, neardup, packing, quality, toxicity
from tidemark.llm.storage import passing, settled


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return quality.keep(docs, quality.train(docs, _labels(spark, sf_dir)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that earlier ones make redundant."""
    kept = lines.dedup(docs).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line dedup", drop_lines),
    ("near dedup", drop_near),
    ("packing", pack),
]

#: SQL can express the third stage alone: the others are trained models, an alignment and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again by the next.

    In the end only what the last stage reads, and what it writes, is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with passing(spark) as made:
        for name, stage in STAGES[:-1]:
            docs = settled(spark, f"pipeline-{name.replace(' ', '-')}", partial(stage, spark, docs, sf_dir))
        made.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
