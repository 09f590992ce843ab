"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a
linear model over its words and their beginnings; the document's is their
noisy-or, 1 - prod(1 - p). Training sees document labels only: the gradient
of the bag's likelihood decides which sentences carry them. Scoring then
names the sentences that are toxic by themselves.

Null and empty texts, and texts without words, have no sentence and score 0.
Ties and repeated rows don't matter: each row is scored by its text alone.
An empty table gives an empty result. Without a label of each kind nothing
can be learned: every sentence then has the base rate of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import words as W
from tidemark.llm.arrow import released, text_slices
from tidemark.llm.labelled import sample

#: Labelled documents that the model is fitted on, at most.
TRAINING_ROWS = 6000
#: A document or a sentence is toxic from this probability on.
THRESHOLD = 0.5
#: Hashed features; one more stands for none.
BUCKETS = 1 << 18
#: Besides whole words, their first so many bytes.
PREFIXES = (4, 5, 6)
#: Bytes that end a sentence.
STOPS = b".!?\n"

_STOP = ~W.byte_table(STOPS)


@dataclass
class Sentences:
    """Words of sentences: their features, and where each sentence begins and what text it is in."""

    words: W.Words
    features: np.ndarray  # a row for each kind of feature, a column for each word
    first: np.ndarray  # first word of each sentence
    text: np.ndarray  # text of each sentence

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray) -> Sentences:
        words = W.find(data, at, W.ALNUM)
        hasher = W.Hasher(data)
        length = words.end - words.start
        kinds = [hasher(words.start, words.end)]
        for n in PREFIXES:
            h = hasher(words.start, np.minimum(words.start + n, words.end)) + np.uint64(n)
            kinds.append(np.where(length > n, h, np.uint64(0)))
        features = np.empty((len(kinds), len(length)), np.int32)
        for row, h in zip(features, kinds, strict=True):
            row[:] = np.where(h == 0, BUCKETS, W.mix(h) & np.uint64(BUCKETS - 1))
        text = words.texts
        passed = np.cumsum(_STOP[data], dtype=np.int32)[words.start] if len(length) else np.zeros(0, np.int32)
        new = np.ones(len(length), bool)
        new[1:] = (passed[1:] != passed[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return cls(words, features, first, text[first])

    def span(self, k: int) -> tuple[int, int]:
        """Bytes of sentence k, from its first word to its last."""
        last = (self.first[k + 1] if k + 1 < len(self.first) else len(self.words.end)) - 1
        return int(self.words.start[self.first[k]]), int(self.words.end[last])


@dataclass(frozen=True)
class Model:
    """Weights by feature, the last being 0, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        each = np.zeros(s.features.shape[1], np.float64)
        for row in s.features:
            each += self.weights[row]
        return np.add.reduceat(each, s.first) + self.bias if len(s.first) else np.zeros(0)

    def score(self, s: Sentences, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the texts and of the sentences."""
        z = self.logits(s)
        clean = np.bincount(s.text, np.logaddexp(0, z), texts)
        return -np.expm1(-clean), np.exp(-np.logaddexp(0, -z))


def _screen(texts: pa.Array, labels: np.ndarray, least: int = 8, sigmas: float = 4.0) -> np.ndarray:
    """Features that occur in enough documents and lean to one label beyond chance."""
    positives, negatives = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for i, _, data, at in text_slices(texts):
        s = Sentences.of(data, at)
        text = s.words.texts
        for row in s.features:
            seen = np.unique(text * (BUCKETS + 1) + row)
            feature, label = seen % (BUCKETS + 1), labels[i + seen // (BUCKETS + 1)]
            positives += np.bincount(feature, label, BUCKETS + 1)
            negatives += np.bincount(feature, 1 - label, BUCKETS + 1)
    p, n = labels.sum(), len(labels) - labels.sum()
    odds = np.log((positives + 0.5) / (p - np.minimum(positives, p) + 0.5)) - np.log((negatives + 0.5) / (n - np.minimum(negatives, n) + 0.5))
    error = np.sqrt(1 / (positives + 0.5) + 1 / (negatives + 0.5))
    odds[BUCKETS] = 0
    return np.flatnonzero((positives + negatives >= least) & (np.abs(odds) > sigmas * error))


def fit(texts: pa.Array, labels: list[int], steps: int = 300, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximise the likelihood of document labels under the noisy-or, by Adam over whole batches."""
    weights = np.zeros(BUCKETS + 1, np.float32)
    y = np.array(labels, np.float64)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        return Model(weights, float(np.log(base / (1 - base))) if 0 < base < 1 else (-12.0 if base == 0 else 12.0))
    kept = _screen(texts, y)
    place = np.full(BUCKETS + 1, -1)
    place[kept] = np.arange(len(kept))
    sentences, hits, of_text = 0, [], []
    for i, _, data, at in text_slices(texts):  # a slice at a time: of its features only the kept ones stay
        s = Sentences.of(data, at)
        sentence = sentences + np.repeat(np.arange(len(s.first)), np.diff(np.append(s.first, s.features.shape[1])))
        hits += [(sentence[row >= 0], row[row >= 0]) for row in (place[f] for f in s.features)]
        of_text.append(s.text + i)
        sentences += len(s.first)
    at_sentence, feature = (np.concatenate(x) for x in zip(*hits, strict=True))
    text = np.concatenate(of_text)
    theta = np.zeros(len(kept) + 1)
    theta[-1] = -6.0  # a sentence without any kept feature is clean
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(at_sentence, theta[feature], sentences) + theta[-1]
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.bincount(text, np.logaddexp(0, z), len(y))
        # d loss / d clean: 1 for label 0, -exp(-clean) / (1 - exp(-clean)) for label 1
        pull = np.where(y > 0, -1 / np.expm1(np.clip(clean, 1e-9, 50)), 1.0)
        by_sentence = pull[text] * p / len(y)
        grad = np.append(np.bincount(feature, by_sentence[at_sentence], len(kept)), by_sentence.sum())
        grad[:-1] += decay * theta[:-1] / len(y)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents outside fold 0."""
    texts, y, _ = sample(documents, labels, "toxic", rows)
    return fit(texts, y)


SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]), False), False),
])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's doc_id and score, and its offending sentences.

    These are the sentences at or over the threshold; if the text is toxic
    only by many slight ones, the worst. ``start`` counts bytes of UTF-8.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            for i, j, data, at in text_slices(batch.column(1)):
                s = Sentences.of(data, at)
                whole, each = model.score(s, j - i)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                bounds = np.searchsorted(s.text, np.arange(j - i + 1))
                for d in np.flatnonzero(whole >= threshold):
                    mine = np.arange(bounds[d], bounds[d + 1])
                    bad = mine[each[mine] >= threshold]
                    for k in bad if len(bad) else mine[[np.argmax(each[mine])]]:
                        a, b = s.span(k)
                        found[d].append({"start": a - int(at[d]), "text": data[a:b].tobytes().decode("utf-8", "replace"), "score": float(each[k])})
                yield pa.record_batch([ids.slice(i, j - i).cast(pa.int64()), pa.array(whole, pa.float64()), pa.array(found, _SPANS)], names=SCORES.names)

    return documents.select("doc_id", "text").mapInArrow(released(batches), SCORES)


_SPANS = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64(), False), pa.field("text", pa.string(), False), pa.field("score", pa.float64(), False)]), False))


def keep(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    place = documents.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in text_slices(batch.column(place)):
                whole, _ = model.score(Sentences.of(data, at), j - i)
                yield batch.slice(i, j - i).filter(pa.array(whole < threshold))

    return documents.mapInArrow(released(batches), documents.schema)
