"""Bounded samples of labelled texts, for fitting classifiers on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import fold
from tidemark.llm.storage import passing, written

#: Labels are learned from rows of all folds but 0 of so many.
FOLDS = 5
#: Bytes of text in a sample, at most.
BYTES = 1 << 26


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, size: int = BYTES) -> tuple[pa.Array, list[int], list[int]]:
    """At most ``rows`` training texts of at most ``size`` bytes together, with their labels and ids, the same ones each time.

    Rows of fold 0 and null labels are left out. Of several labels of a
    document the largest counts, of several rows with its id one. The rows
    are those with the smallest hashes of their ids, so the sample does not
    depend on order or partitions. Texts are whole: in the order of the
    hashes, one that no longer fits into ``size`` is left out.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & (fold("id", FOLDS) != 0)).groupBy("id").agg(F.max("label").alias("label"))
    by_hash = F.xxhash64("id", F.lit(label))
    chosen = known.orderBy(by_hash, "id").limit(rows)
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    with passing(spark):
        # written, so that what fits is known before any text comes to the driver
        found = written(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
        sizes = found.select("id", F.octet_length("text").alias("bytes"), by_hash.alias("at")).orderBy("at", "id").collect()  # bounded by rows
        fitting, left = [], size
        for r in sizes:
            if r.bytes <= left:
                fitting.append(r.id)
                left -= r.bytes
        if len(fitting) < len(sizes):
            found = found.join(F.broadcast(spark.createDataFrame(pa.table({"id": pa.array(fitting, pa.int64())}))), "id")
        table = found.toArrow().sort_by("id")
    return table["text"].combine_chunks(), table["label"].to_pylist(), table["id"].to_pylist()
