"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, fingerprints, licenses, lines, lm, neardup, packing, quality, storage, toxicity
from tidemark.llm.arrow import fold
from tidemark.llm.labelled import FOLDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held_out(parts: int, remainder: int) -> Column:
    return F.coalesce(fold("doc_id", parts) == remainder, F.lit(False)).alias("held_out")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, and how many of its sentences offend."""
    documents = table(spark, folder, "documents")
    scored = toxicity.score(documents, toxicity.train(documents, table(spark, folder, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(FOLDS, 0), "score", predicted, F.size("sentences").alias("n_offending"))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality."""
    documents = table(spark, folder, "documents")
    scored = quality.score(documents, quality.train(documents, table(spark, folder, "labels")))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(FOLDS, 0), "score", predicted, "passages")


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids and the text they decode to, as digests."""
    encoded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's license phrases, labels and expressions."""
    found = licenses.find(table(spark, folder, "documents"))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined("places.label").alias("base_labels"), joined("labels").alias("labels"), "score", F.concat_ws(";", "expressions").alias("expressions"), "freedom",
    )


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and its successor's."""
    edited = fingerprints.edits(table(spark, folder, "documents"))
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def fingerprint_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class by its fingerprint: bands joined, Jaccard similarity verified. The other half of op8, whose own query has no classes."""
    documents = table(spark, folder, "documents")
    classes = storage.settled(spark, "fingerprint-classes", lambda: fingerprints.near_pairs(documents)[1])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


@query
def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probabilities by words and by byte contexts."""
    documents = table(spark, folder, "documents")
    return lm.score(documents, *lm.train(documents))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line makes redundant."""
    return lines.dedup(table(spark, folder, "documents").select("doc_id", "text"))


ORACLE_SQL["op2_line_dedup"] = lines.ORACLE_SQL


@query
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return neardup.classes(table(spark, folder, "documents"))


@query
def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth vector."""
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
