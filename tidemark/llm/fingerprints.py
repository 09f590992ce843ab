"""Document fingerprints: MinHash over shingles of five words.

A fingerprint is, for each of many universal hash functions, the least value
over a text's shingles, cut to 16 bits; the share of equal places of two
fingerprints estimates the Jaccard similarity of their shingles. Near pairs
are found by joining bands of the fingerprint in Spark, and their Jaccard
similarity is then computed exactly.

Words stand between blanks, A-Z as a-z. Null and empty texts, and texts
without words, share one fingerprint; a text of fewer than five words has one
shingle. Equal texts have equal fingerprints. Rows that repeat count as
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.arrow import slices, text_slices
from tidemark.llm.groups import Measure, near_classes
from tidemark.llm.groups import signatures as counts

#: Words of a shingle, and the similarity from which documents are near.
SHINGLE, NEAR = 5, 0.8
#: Hash functions. Four in a row are a band, and near pairs share one: of pairs at the threshold all but 1 in 10 million do.
HASHES = 128

#: Bytes of a run of documents, as stored, at most about.
RUN_BYTES = 1 << 26

_COEFFICIENTS = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64)
_A, _B = _COEFFICIENTS[0] * np.uint64(2) + np.uint64(1), _COEFFICIENTS[1]


def signatures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 16-bit minima for each text.

    The functions are (a x + b) mod 2**64 shifted to 32 bits, with odd a:
    universal, and without a division.
    """
    words = W.find(data, at)
    x, to = W.shingles(W.Hasher(data)(words.start, words.end), words.at, SHINGLE)
    out = np.empty((len(at) - 1, HASHES), np.uint64)
    shift = np.uint64(32)
    work = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _A[k], out=work)
        work += _B[k]
        work >>= shift
        out[:, k] = np.minimum.reduceat(work, to[:-1]) if len(to) > 1 else 0
    # minima are small numbers: mixing makes their low bits even
    return (W.mix(out) & np.uint64(0xFFFF)).astype("<u2")


def _texts(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    encoded = [v.encode() for v in values]
    return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in encoded], dtype=np.int64)])


def _parts(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings as buffers of bounded size."""
    data, at = _texts(values)
    for i, j in slices(at, 1 << 18):
        yield data[at[i] : at[j]], at[i : j + 1] - at[i]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places, row by row."""
    return (a == b).mean(1) if len(a) else np.zeros(0)


def fingerprint(documents: DataFrame) -> DataFrame:
    """Each row's doc_id and fingerprint, in hexadecimal."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in text_slices(batch.column(1), 1 << 18):
                yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([s.tobytes().hex() for s in signatures(data, at)])], names=["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(batches, "doc_id long, fingerprint string")


def _buckets(documents: DataFrame, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows by runs of ascending doc_id, and after each run the row that follows it.

    The runs' bounds are approximate quantiles. The first row of every run is
    also sent to the run before, where it is the last row's successor; the
    first run's goes to the last, closing the circle. Only runs' bounds and
    first keys come to the driver: a few numbers for each partition.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("q")).first().q or []
    cuts = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].astype(np.int64), "right")
        return pd.Series(out)

    placed = rows.withColumn("run", run("doc_id")).withColumn("hash", F.xxhash64("text"))
    firsts = {r.run: (r.first.doc_id, r.first.hash) for r in placed.groupBy("run").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect()}
    runs = sorted(firsts)
    before = {r: runs[i - 1] for i, r in enumerate(runs)}
    spark = documents.sparkSession
    known = spark.createDataFrame([(r, *firsts[r], before[r]) for r in runs], "run int, first_id long, first_hash long, before int")
    joined = placed.join(F.broadcast(known), "run", "left")  # a row for each partition at most
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    own = F.struct(F.col("run").alias("to"), F.lit(False).alias("follows"))
    ahead = F.struct(F.col("before").alias("to"), F.lit(True).alias("follows"))
    sent = joined.select("doc_id", "text", "hash", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("s"))
    dealt = sent.select("doc_id", "text", "hash", "s.to", "s.follows").repartitionById(len(cuts) + 1, "to")
    return dealt.sortWithinPartitions("to", "follows", F.col("doc_id").asc_nulls_first(), "hash")


EDITED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row beside a text edited from it and the row that follows by doc_id.

    The last half of a row's characters is replaced by as many first ones of
    its successor. Null ids come first; rows with one id follow each other by
    a hash of their texts, all of them in one run.
    """
    if not parts:
        size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 50) // RUN_BYTES)

    def made(ids: list[int | None], texts: list[str], signs: np.ndarray) -> pa.RecordBatch:
        """All rows but the last, which is only the successor of the one before."""
        sizes = [len(t) for t in texts[:-1]]
        edited = [t[: n - n // 2] + after[: n // 2] for t, n, after in zip(texts, sizes, texts[1:], strict=False)]
        other = np.concatenate([signatures(*part) for part in _parts(edited)])
        return pa.record_batch([
            pa.array(ids[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(edited, pa.string()), pa.array([s.tobytes().hex() for s in signs[:-1]]), pa.array([s.tobytes().hex() for s in other]),
            pa.array(likeness(signs[:-1], other), pa.float64()), pa.array(likeness(signs[:-1], signs[1:]), pa.float64()),
        ], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition has one run in order, then the successor of its last row, once for each of that row's equals."""
        ids, texts, signs, closed = [], [], np.zeros((0, HASHES), "<u2"), False
        for batch in it:
            follows = batch.column(2).to_pylist()
            for i, j, data, at in text_slices(batch.column(1), 1 << 18):
                taken = []
                for k in range(i, j):
                    if not (closed and follows[k]):
                        taken.append(k)
                    closed = closed or follows[k]
                ids += [batch.column(0)[k].as_py() for k in taken]
                texts += [batch.column(1)[k].as_py() for k in taken]
                signs = np.concatenate([signs, signatures(data, at)[[k - i for k in taken]]])
                if len(ids) > 1:
                    yield made(ids, texts, signs)
                    ids, texts, signs = ids[-1:], texts[-1:], signs[-1:]

    return _buckets(documents, parts).select("doc_id", "text", "follows").mapInArrow(batches, EDITED)


def near_pairs(documents: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Links between near documents, and every document's group.

    Returns links ``(a, b, likeness)``, a < b, whose likeness is the exact
    Jaccard similarity of the texts' shingles, and ``(doc_id, class_id)`` of
    documents in a group, named by its least id. Equal texts are one document
    here, known by its least id. Candidates share a band of the fingerprint;
    links that would lie within a group that others have made aren't sought.
    Rows with a null id take no part, and rows of one id are one document:
    see ``near_classes``.
    """
    return near_classes(documents, measure(threshold))


def _shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, in order, and their offsets."""
    words = W.find(data, at)
    x, to = W.shingles(W.Hasher(data)(words.start, words.end), words.at, SHINGLE)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(to))
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[new], np.searchsorted(owner[new], np.arange(len(at)))


def _described(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, signatures and bands: four 16-bit places are one band."""
    x, to = _shingles(data, at)
    bands = signatures(data, at).view(np.uint64)
    bands = W.mix(bands ^ W.mix(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)))
    return np.diff(to), counts(x, to), bands.ravel(), np.arange(len(at)) * bands.shape[1]


def _shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    x, to = _shingles(data, at)
    return np.split(x, to[1:-1])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def measure(threshold: float = NEAR) -> Measure:
    """Jaccard similarity of shingles. Near texts share so many that what only one has is at most this part of both together."""
    apart = lambda larger, smaller: (1 - threshold) / (1 + threshold) * (larger + smaller) + 1e-9
    return Measure(_described, _shingle_sets, _jaccard, apart, threshold)
