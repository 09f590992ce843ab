"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of up to 64 words. Each passage is encoded by
a layer over figures on its characters and words; gated attention weighs the
passages, and a logistic layer scores their weighted mean. All layers are
learned from document labels together.

Null and empty texts, and texts without words, are one empty passage. Ties
and repeated rows don't matter: each row is scored by its text alone. An
empty table gives an empty result. Without a label of each kind every text
scores the base rate of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import words as W
from tidemark.llm.arrow import released, text_slices
from tidemark.llm.labelled import sample

#: Labelled documents that the model is fitted on, at most.
TRAINING_ROWS = 6000
#: A text is good from this probability on.
THRESHOLD = 0.3
#: Words of a passage.
PASSAGE = 64
#: Units of the encoding and of the attention.
UNITS, GATES = 16, 8

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "high": bytes(range(128, 256)), "blank": b" \t",
    "line": b"\n", "stop": b".", "comma": b",;:", "loud": b"!?", "bar": b"|", "mark": b"#$%&*+=<>@^~_\\/{}[]", "quote": b"\"'()-",
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_KINDS = len(_CLASSES) + 1
FIGURES = _KINDS + 9


@dataclass
class Passages:
    figures: np.ndarray  # a row for each passage
    text: np.ndarray  # the text it is in, ascending

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray) -> Passages:
        """Shares of kinds of bytes, and how long, repeated and alike the words are."""
        words = W.find(data, at)
        n = np.diff(words.at)
        made = np.maximum(-(-n // PASSAGE), 1)
        text = np.repeat(np.arange(len(n)), made)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
        first = words.at[:-1][text] + offset * PASSAGE
        last = np.minimum(first + PASSAGE, words.at[1:][text])
        size = (last - first).astype(np.float64)
        figures = np.zeros((len(text), FIGURES))
        some = size > 0
        if some.any():
            owner = np.repeat(np.arange(len(text)), last - first)
            hashes = W.Hasher(data)(words.start, words.end)
            length = (words.end - words.start).astype(np.float64)
            start, end = words.start[first[some]], words.end[last[some] - 1]
            kind = _CLASS[data]
            # bytes between passages are blanks; each byte counts for the passage that began last
            byte_owner = np.zeros(len(data), np.int64)
            byte_owner[start] = np.diff(np.flatnonzero(some), prepend=0)
            byte_owner = np.cumsum(byte_owner)
            counts = np.bincount(byte_owner * _KINDS + kind, minlength=len(text) * _KINDS).reshape(len(text), _KINDS).astype(np.float64)
            extent = np.ones(len(text))
            extent[some] = end - start
            figures[:, :_KINDS] = np.minimum(counts / extent[:, None], 1.0)
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            distinct = np.bincount(o[new], minlength=len(text))
            runs = np.diff(np.append(np.flatnonzero(new), len(h)))
            most = np.zeros(len(text))
            np.maximum.at(most, o[new], runs)
            same = np.zeros(len(hashes))
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            mean = np.bincount(owner, length, len(text)) / np.maximum(size, 1)
            spread = np.sqrt(np.maximum(np.bincount(owner, length**2, len(text)) / np.maximum(size, 1) - mean**2, 0))
            lone = np.bincount(owner, length == 1, len(text))
            full = np.maximum(size, 1)
            rest = [distinct / full, most / full, np.bincount(owner, same, len(text)) / full, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, lone / full, np.log1p(size) / 4]
            figures[:, _KINDS : _KINDS + len(rest)] = np.stack(rest, 1)
        figures[:, -2] = ~some
        figures[:, -1] = np.log1p(n)[text] / 8
        return cls(figures, text)


@dataclass(frozen=True)
class Model:
    """Layers by name; ``mean`` and ``scale`` make figures comparable."""

    layers: dict[str, np.ndarray]

    def score(self, p: Passages, texts: int) -> np.ndarray:
        return _forward(self.layers, (p.figures - self.layers["mean"]) / self.layers["scale"], p.text, texts)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, text: np.ndarray, texts: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    view, gate = np.tanh(h @ w["view"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    energy = (view * gate) @ w["attend"]
    top = np.full(texts, -np.inf)
    np.maximum.at(top, text, energy)
    e = np.exp(energy - top[text])
    a = e / np.bincount(text, e, texts)[text]
    starts = np.searchsorted(text, np.arange(texts))
    z = np.add.reduceat(h * a[:, None], starts) if texts else np.zeros((0, h.shape[1]))
    logit = z @ w["out"] + w["out_bias"]
    return {"h": h, "view": view, "gate": gate, "a": a, "z": z, "p": 1 / (1 + np.exp(-logit))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, text, len(y))
    d_logit = (f["p"] - y) / len(y)
    d_z = d_logit[:, None] * w["out"]
    h, a = f["h"], f["a"]
    d_a = (d_z[text] * h).sum(1)
    d_energy = a * (d_a - np.bincount(text, a * d_a, len(y))[text])
    both = f["view"] * f["gate"]
    d_view = d_energy[:, None] * w["attend"] * f["gate"] * (1 - f["view"] ** 2)
    d_gate = d_energy[:, None] * w["attend"] * f["view"] * f["gate"] * (1 - f["gate"])
    d_h = d_z[text] * a[:, None] + d_view @ w["view"].T + d_gate @ w["gate"].T
    d_in = d_h * (1 - h**2)
    return {
        "encode": x.T @ d_in, "encode_bias": d_in.sum(0), "view": h.T @ d_view, "gate": h.T @ d_gate,
        "attend": both.T @ d_energy, "out": f["z"].T @ d_logit, "out_bias": np.array([d_logit.sum()]),
    }


def fit(texts: pa.Array, labels: list[int], epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the cross-entropy of document labels, by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    w = {
        "mean": np.zeros(FIGURES), "scale": np.ones(FIGURES), "encode": rng.normal(0, FIGURES**-0.5, (FIGURES, UNITS)), "encode_bias": np.zeros(UNITS),
        "view": rng.normal(0, UNITS**-0.5, (UNITS, GATES)), "gate": rng.normal(0, UNITS**-0.5, (UNITS, GATES)), "attend": rng.normal(0, GATES**-0.5, GATES),
        "out": rng.normal(0, UNITS**-0.5, UNITS), "out_bias": np.zeros(1),
    }
    base = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < base < 1:
        w["out"][:] = 0
        w["out_bias"][:] = 0.0 if not len(y) else 12.0 if base else -12.0
        return Model(w)
    parts = [(i, Passages.of(data, at)) for i, _, data, at in text_slices(texts)]
    figures = np.concatenate([p.figures for _, p in parts])
    text = np.concatenate([p.text + i for i, p in parts])
    w["mean"], w["scale"] = figures.mean(0), figures.std(0) + 1e-3
    x = (figures - w["mean"]) / w["scale"]
    bounds = np.searchsorted(text, np.arange(len(y) + 1))
    learned = [k for k in w if k not in ("mean", "scale")]
    m, v, t = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in chosen])
            of = np.repeat(np.arange(len(chosen)), bounds[chosen + 1] - bounds[chosen])
            t += 1
            for k, g in _gradients(w, x[rows], of, y[chosen]).items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(w)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents outside fold 0."""
    texts, y, _ = sample(documents, labels, "quality", rows)
    return fit(texts, y)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Each row's doc_id, score, and the number of its passages."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in text_slices(batch.column(1)):
                p = Passages.of(data, at)
                passages = np.bincount(p.text, minlength=j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(model.score(p, j - i)), pa.array(passages, pa.int64())], names=["doc_id", "score", "passages"])

    return documents.select("doc_id", "text").mapInArrow(released(batches), "doc_id long, score double, passages long")


def keep(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns."""
    place = documents.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in text_slices(batch.column(place)):
                yield batch.slice(i, j - i).filter(pa.array(model.score(Passages.of(data, at), j - i) >= threshold))

    return documents.mapInArrow(released(batches), documents.schema)
