"""Language-model scores by prediction by partial matching.

A trie of byte contexts of up to four bytes is counted over the training
texts. A byte's probability comes from the longest known context; a byte not
seen there escapes, with the number of different bytes seen as the escape's
count, to the context without its oldest byte, where those already ruled out
are excluded; at last all bytes left are alike. A text's score is the log10
probability of its bytes and its end, from pretrained counts.

Beside it stands a baseline: add-one probabilities of whole words. Counts of
words are exact sums over all training texts, keyed by 64-bit hashes.

Null and empty texts consist of their end only. Rows with a null id count as
training rows. Repeated rows count and are scored once each. An empty table
gives an empty result; without training texts every byte is equally likely.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.arrow import folds, text_slices
from tidemark.llm.storage import written

#: Texts of fold 2 of so many are held out.
FOLDS, HELD_OUT = 7, 2
#: Bytes of context.
ORDER = 4
#: What no text in UTF-8 has: the byte before a text's first and the one after its last.
START, END = 0xFF, 0xFE
#: Words whose counts go to every task; the counts of rarer ones are joined.
HEAD_WORDS = 1 << 17
#: Contexts with their next bytes that come to the driver and go to every task, at most. Beyond them, probabilities are joined.
HELD_PAIRS = 1 << 20
#: Counts that a task gathers before it passes them on.
GATHERED = 1 << 20

WORD, CONTEXT, TEXT = 0, 1, 2


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER starts before and an end behind each; the places of bytes and ends; how many each text has."""
    n = np.diff(at)
    out = np.full(len(data) + (ORDER + 1) * len(n), START, np.uint8)
    to = at[:-1] + (ORDER + 1) * np.arange(len(n)) + ORDER
    out[np.arange(len(data)) + np.repeat(to - at[:-1], n)] = data
    out[to + n] = END
    inside = np.ones(len(out), bool)
    for k in range(1, ORDER + 1):
        inside[to - k] = False
    return out, np.flatnonzero(inside), n + 1


def codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every byte behind its predecessors, the nearest next to it, as one number."""
    b, place, _ = padded(data, at)
    wide = b.astype(np.uint64)
    out = wide[place]
    for k in range(1, ORDER + 1):
        out |= wide[place - k] << np.uint64(8 * k)
    return out


class _Tally:
    """Counts by key, merged whenever they have doubled."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.waiting += len(found[0])
        if self.waiting > max(len(self.keys), 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k.astype(np.uint64) for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
        self.keys, which = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(which, counts, len(self.keys)).astype(np.int64)
        self.parts, self.waiting = [], 0

    def take(self, kind: int) -> Iterator[pa.RecordBatch]:
        """All counts so far, which are then forgotten."""
        self.merge()
        for i in range(0, len(self.keys), 1 << 16):
            keys = self.keys[i : i + (1 << 16)].view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(self.counts[i : i + (1 << 16)])], names=["kind", "key", "n"])
        self.__init__()


def count(documents: DataFrame) -> DataFrame:
    """Counts ``(kind, key, n)`` of the training texts' words and contexts, and of the texts themselves."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, texts = {WORD: _Tally(), CONTEXT: _Tally()}, 0
        for batch in it:
            training = pa.array(folds(batch.column(0).to_pylist(), FOLDS) != HELD_OUT)
            for i, j, data, at in text_slices(batch.column(1).filter(training), 1 << 19):
                words = W.find(data, at)
                tallies[WORD].add(W.Hasher(data)(words.start, words.end))
                tallies[CONTEXT].add(codes(data, at))
                texts += j - i
                for kind, t in tallies.items():
                    if len(t.keys) > GATHERED:
                        yield from t.take(kind)
        for kind, t in tallies.items():
            yield from t.take(kind)
        yield pa.record_batch([pa.array([TEXT], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    gathered = documents.select("doc_id", "text").mapInArrow(batches, "kind byte, key long, n long")
    return written(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Trie:
    """Contexts as nodes; the root is the empty one, a child has one older byte more."""

    symbol: np.ndarray  # the column of each byte
    child: np.ndarray  # node and column to node, or -1
    log10: np.ndarray  # node and column to log10 probability, in full: escapes and exclusions are worked in

    @classmethod
    def of(cls, pairs: np.ndarray, counts: np.ndarray, low: np.ndarray) -> Trie:
        """``pairs`` and ``counts`` are codes with their numbers; ``low`` has the numbers of (last byte, byte) over all blocks."""
        seen = np.zeros(256, bool)
        seen[low.any(1).nonzero()[0]] = seen[low.any(0).nonzero()[0]] = True
        seen[[START, END]] = True
        for k in range(ORDER + 1):
            seen[np.unique((pairs >> np.uint64(8 * k)).astype(np.uint8))] = True
        unseen = np.flatnonzero(~seen)
        symbol = np.zeros(256, np.int64)
        symbol[np.flatnonzero(seen)] = np.arange(seen.sum())
        symbol[unseen] = seen.sum()  # one column for all bytes never seen
        width = int(seen.sum()) + 1
        columns = np.flatnonzero(seen)
        low = low[:, columns]
        # level by level: how often each byte follows a context, and the probability after escaping past it
        numbers = np.zeros((1, width), np.float32)
        numbers[0, :-1] = low.sum(0)
        left = 256 - (numbers > 0).sum()  # at the root all bytes without a number are alike
        escaped = np.full((1, width), 1.0 / max(left, 1), np.float32)
        contexts = [np.zeros(1, np.uint64), np.flatnonzero(low.any(1)).astype(np.uint64)]  # as numbers, the nearest byte lowest
        contexts += [np.unique(pairs >> np.uint64(8) & np.uint64((1 << 8 * k) - 1)) for k in range(2, ORDER + 1)]
        base = np.cumsum([0, *(len(c) for c in contexts)])
        child = np.full((base[-2], width), -1, np.int32)
        rows = np.empty((base[-1], width), np.float32)
        rows[:1] = cls._probabilities(numbers, escaped)
        for k in range(1, ORDER + 1):
            found, above = contexts[k], contexts[k - 1]
            parent = np.searchsorted(above, found & np.uint64((1 << 8 * (k - 1)) - 1))
            child[base[k - 1] + parent, symbol[found >> np.uint64(8 * (k - 1))]] = base[k] + np.arange(len(found))
            if k > 1:
                at = np.searchsorted(found, pairs >> np.uint64(8) & np.uint64((1 << 8 * k) - 1)).astype(np.int32)
                order = np.argsort(at, kind="stable").astype(np.int32)
                bounds = np.searchsorted(at, np.arange(len(found) + 1), sorter=order)
            if k < ORDER:
                next_numbers, next_escaped = (np.empty((len(found), width), np.float32) for _ in range(2))
            for i in range(0, len(found), 1 << 12):  # a few thousand contexts at a time
                j = min(i + (1 << 12), len(found))
                if k == 1:
                    part = np.zeros((j - i, width), np.float32)
                    part[:, :-1] = low[found[i:j].astype(np.int64)]
                else:
                    mine = order[bounds[i] : bounds[j]]
                    part = np.bincount((at[mine] - i) * width + symbol[pairs[mine].astype(np.uint8)], counts[mine], (j - i) * width).astype(np.float32).reshape(j - i, width)
                rest = np.where(part > 0, 0, numbers[parent[i:j]])  # exclusion: what this context has is ruled out above
                total, kinds = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
                scale = np.where(kinds > 0, total + kinds, 1)
                beyond = np.where(rest > 0, rest / scale, np.where(kinds > 0, kinds / scale, 1.0) * escaped[parent[i:j]]).astype(np.float32)
                rows[base[k] + i : base[k] + j] = cls._probabilities(part, beyond)
                if k < ORDER:
                    next_numbers[i:j], next_escaped[i:j] = part, beyond
            if k < ORDER:
                numbers, escaped = next_numbers, next_escaped
        return cls(symbol, child, rows)

    @staticmethod
    def _probabilities(numbers: np.ndarray, escaped: np.ndarray) -> np.ndarray:
        """log10 of a byte's share, the number of kinds being the escape's count; unknown bytes get the escape's share."""
        kinds = (numbers > 0).sum(1, keepdims=True)
        scale = np.maximum(numbers.sum(1, keepdims=True) + kinds, 1)
        p = np.where(numbers > 0, numbers / scale, np.where(kinds > 0, kinds / scale, 1.0) * escaped)
        return np.log10(np.maximum(p, 1e-38)).astype(np.float32)

    def of_bytes(self, previous: Callable[[int], np.ndarray]) -> np.ndarray:
        """The log10 probabilities of bytes ``previous(0)`` behind bytes ``previous(1)``, ``previous(2)`` and so on."""
        last = self.symbol[previous(0)]
        node = np.zeros(len(last), np.int64)
        width, child = self.log10.shape[1], self.child.ravel()
        deeper = np.ones(len(last), bool)
        for k in range(1, ORDER + 1):
            step = child[node * width + self.symbol[previous(k)]]
            deeper &= step >= 0
            node = np.where(deeper, step, node)
        return self.log10.ravel()[node * width + last].astype(np.float64)

    def score(self, data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each text; with ``wanted`` that of the bytes behind such last two bytes only."""
        b, place, sizes = padded(data, at)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if wanted is not None:
            chosen = wanted[b[place - 2].astype(np.int64) << 8 | b[place - 1]]
            owner, place = owner[chosen], place[chosen]
        return np.bincount(owner, self.of_bytes(lambda k: b[place - k]), len(sizes)).astype(np.float64)  # of no bytes it is of int


@dataclass
class Model:
    """Counts of contexts and of the commonest words, for the tasks."""

    packed: bytes  # codes of the held contexts with their next bytes, then their numbers, compressed
    held: np.ndarray | None  # whether contexts with such last two bytes are held, or not in any training text; None if all are
    low: np.ndarray
    head: np.ndarray  # hashes of the commonest words, ascending
    head_counts: np.ndarray
    tokens: int  # of the training texts, ends included
    kinds: int
    texts: int
    name: str

    @property
    def denominator(self) -> float:
        return float(self.tokens + self.kinds + 1)


def _last_two(code: Column | str) -> Column:
    return F.shiftright(code, 8).bitwiseAND(0xFFFF)


def _held(contexts: DataFrame) -> tuple[np.ndarray | None, pa.Table]:
    """Which contexts the tasks hold, and those with their numbers.

    Contexts go by their last two bytes: 65,536 groups at most, whose trie
    needs no other group. Where all would be more than HELD_PAIRS, groups
    with the most bytes a pair are held.
    """
    sizes = contexts.groupBy(_last_two("key").alias("two")).agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).toArrow()
    two, pairs, n = (sizes[c].to_numpy() for c in ("two", "pairs", "n"))
    if pairs.sum() <= HELD_PAIRS:
        return None, contexts.select("key", "n").toArrow()
    order = np.argsort(-n / pairs, kind="stable")
    some = two[order[np.cumsum(pairs[order]) <= HELD_PAIRS]]
    held = np.ones(1 << 16, bool)
    held[two] = False
    held[some] = True
    chosen = contexts.sparkSession.createDataFrame(pa.table({"two": pa.array(some, pa.int64())}))
    return held, contexts.join(F.broadcast(chosen), _last_two("key") == F.col("two")).select("key", "n").toArrow()


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all counts.

    What comes to the driver is bounded: a histogram of word counts on 1,000
    steps, the commonest words (HEAD_WORDS at most), the numbers of pairs of
    bytes, the sizes of the groups of contexts by two bytes, and the numbers
    of HELD_PAIRS contexts at most with their next bytes.
    """
    counts = count(documents)
    of = {kind: counts.filter(F.col("kind") == kind).select("key", "n") for kind in (WORD, CONTEXT, TEXT)}
    texts = of[TEXT].agg(F.sum("n")).first()[0] or 0
    total = of[WORD].agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    step = F.floor(F.log2("n") * 16)
    room, least = HEAD_WORDS, 0
    for r in sorted(of[WORD].groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        room -= r.words
        if room < 0:
            break
        least = r.least
    head = of[WORD].filter(F.col("n") >= (least or 1 << 62)).toArrow()
    hashes, numbers = head["key"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.argsort(hashes)
    bytes_ = of[CONTEXT].groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    low = np.bincount(bytes_["pair"].to_numpy(), bytes_["n"].to_numpy(), 1 << 16).astype(np.int64).reshape(256, 256)
    held, pairs = _held(of[CONTEXT])
    pairs = pairs.sort_by("key")
    packed = zlib.compress(pairs["key"].to_numpy().tobytes() + pairs["n"].to_numpy().tobytes(), 1)
    model = Model(packed, held, low, hashes[order], numbers[order], (total.n or 0) + texts, total.kinds + (texts > 0), texts, name=uuid.uuid4().hex)
    return model, counts


_UNPACKED: dict[str, Trie] = {}


def _unpacked(model: Model) -> Trie:
    """The trie of the held contexts. A worker has one, and lets go of it before it builds another."""
    if model.name not in _UNPACKED:
        _UNPACKED.clear()
        raw = zlib.decompress(model.packed)
        n = len(raw) // 16
        _UNPACKED[model.name] = Trie.of(np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n), model.low)
    return _UNPACKED[model.name]


def _numbered(keys: np.ndarray, owner: np.ndarray, rows: int, name: str) -> pa.Array:
    """For each row its distinct keys, and how often it has them."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    bounds = np.searchsorted(owner[first], np.arange(rows + 1))
    of_rows = pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(times, pa.int64())], [name, "times"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), of_rows)


def _joined(rows: DataFrame, model: Model, contexts: DataFrame) -> DataFrame:
    """``(row, beyond)``: the log10 probability of the bytes behind contexts that the tasks don't hold.

    The contexts of two last bytes and all that is asked of them meet in one
    place, where their trie is built: 256 ** 3 codes at most, whatever the
    corpus. Each different code is looked up once.
    """
    asked = rows.select("row", F.inline("contexts"))
    not_held = contexts.sparkSession.createDataFrame(pa.table({"two": pa.array(np.flatnonzero(~model.held))}))
    pairs = contexts.withColumn("two", _last_two("key")).join(F.broadcast(not_held), "two").select("two", "key", "n")
    codes = asked.select("code").distinct().withColumn("two", _last_two("code"))
    low = model.low

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        trie = Trie.of(left["key"].to_numpy().view(np.uint64), left["n"].to_numpy(), low)
        code = right["code"].to_numpy().view(np.uint64)
        return pa.table({"code": right["code"], "log10": pa.array(trie.of_bytes(lambda k: (code >> np.uint64(8 * k)).astype(np.uint8)))})

    found = written(pairs.groupBy("two").cogroup(codes.groupBy("two")).applyInArrow(looked_up, "code long, log10 double"), "lm-probabilities")
    return asked.join(found, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("beyond"))


def _lookup(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, or 0."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words that are not among the commonest are joined to the table of all
    counts, with how often each text has them; so are contexts that the tasks
    don't hold, to their probabilities.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end = np.log10(m.texts + 1)
        trie = _unpacked(m)
        for batch in it:
            ids = batch.column(0)
            held = folds(ids.to_pylist(), FOLDS) == HELD_OUT
            for i, j, data, at in text_slices(batch.column(1), 1 << 18):
                scores = trie.score(data, at, m.held)
                code, of_code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if m.held is not None:
                    code, of_code = codes(data, at), np.repeat(np.arange(j - i), np.diff(at) + 1)
                    beyond = ~m.held[(code >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]
                    code, of_code = code[beyond], of_code[beyond]
                found = W.find(data, at)
                keys, text = W.Hasher(data)(found.start, found.end), found.texts
                numbers = _lookup(keys, m.head, m.head_counts)
                common = numbers > 0
                base = np.bincount(text, np.where(common, np.log10(numbers + 1), 0), j - i) + end
                known = np.bincount(text, common, j - i).astype(np.int64) + (m.texts > 0)
                yield pa.record_batch([
                    ids.slice(i, j - i).cast(pa.int64()), pa.array(held[i:j]), pa.array(np.diff(found.at) + 1, pa.int64()), pa.array(known), pa.array(base), pa.array(scores),
                    _numbered(keys[~common], text[~common], j - i, "word"), _numbered(code, of_code, j - i, "code"),
                ], names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "tail", "contexts"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word: long, times: long>>, contexts array<struct<code: long, times: long>>"
    scored = documents.select("doc_id", "text").mapInArrow(batches, schema).withColumn("row", F.monotonically_increasing_id())
    rows = written(scored, "lm-rows")
    words = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    more = rows.select("row", F.inline("tail")).join(words, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    none: Column = F.lit(0)
    base = F.col("base") + F.coalesce("more", none) - F.col("n_tokens") * float(np.log10(model.denominator))
    whole = rows.drop("tail", "contexts").join(more, "row", "left")
    score = F.col("score")
    if model.held is not None:
        whole = whole.join(_joined(rows, model, counts.filter(F.col("kind") == CONTEXT)), "row", "left")
        score = score + F.coalesce("beyond", none)
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", none)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
