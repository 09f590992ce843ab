"""Packing: token ids of documents into sequences with little padding.

Documents are cut into pieces of at most one sequence. Shortest-pack-first
then works on the histogram of piece lengths alone: lengths are placed
longest first, each into the packs that are shortest so far, and packs of
the same content are one pattern with a count. Pieces take their places by
their rank among the pieces of their length, so the patterns are joined back
without gathering pieces anywhere.

A document's tokens are those of its text and one closing id; a null or empty
text has the closing id only. Ties in length are ranked by a hash of the
piece; equal rows get a place each. An empty table gives an empty result.
Texts of any length are cut whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words as W
from tidemark.llm.arrow import released, text_slices
from tidemark.llm.storage import written

#: Tokens of a sequence, and the id that closes a document.
LENGTH, CLOSING = 2048, 1
#: Words and odd runs whose ids a worker remembers, by 64-bit hashes; when there are more, or their ids are over four times as many, it forgets the older half.
REMEMBERED = 1 << 20
#: Bytes of text that are tokenized at a time.
GATHERED = 1 << 20
#: Fixed: a character that stands between runs when many are tokenized at once.
_MARK = "\x02"
#: Fixed: letters of any script.
_LETTERS = re.compile(r"[^\W\d_]+")
#: Fixed: what the vocabulary's last token of a word ends with.
_END = "</w>"
#: Pieces of one length that one task ranks, about.
RANKED = 1 << 20


#: Kinds of bytes. Letters are A-Z, a-z and all beyond ASCII, marks are other printable ASCII; a run with any other byte is odd.
_BLANK, _LETTER, _SIGN, _ODD = range(4)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    kinds[33:127] = _SIGN
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    # an apostrophe may begin a word, a bar is part of special tokens, digits are words each
    kinds[[ord(c) for c in "'|0123456789"]] = _ODD
    kinds[[ord(" "), ord("\n")]] = _BLANK
    return kinds


_KINDS = _kinds()
_FOLDED = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


@dataclass
class Ids:
    """Ids by key: those of ``key[k]``, ascending, are ``size[k]`` numbers of ``flat`` from ``start[k]`` on."""

    key: np.ndarray
    start: np.ndarray
    size: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, raw: list[bytes]) -> Ids:
        size = np.array([len(x) // 2 for x in raw], np.int32)
        return cls(key, (np.cumsum(size, dtype=np.int64) - size).astype(np.int32), size, np.frombuffer(b"".join(raw), "<u2"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place, and whether it is there."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return at, self.key[at] == keys

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids of the keys at these places, one after another."""
        count = self.size[places]
        to = np.cumsum(count, dtype=np.int64)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.start[places] - to + count, count)]

    def taken(self, places: np.ndarray) -> Ids:
        """Only the keys at these places, ascending."""
        size = self.size[places]
        return Ids(self.key[places], (np.cumsum(size, dtype=np.int64) - size).astype(np.int32), size, self.at(places))

    def joined(self, more: Ids) -> Ids:
        """With other keys and their ids."""
        if not len(more.key):
            return self
        at = np.searchsorted(self.key, more.key)
        start = np.insert(self.start, at, more.start + np.int32(len(self.flat)))
        return Ids(np.insert(self.key, at, more.key), start, np.insert(self.size, at, more.size), np.concatenate([self.flat, more.flat]))


_NONE = Ids.of(np.zeros(0, np.uint64), [])


class Recent:
    """Ids by hashed key in flat arrays; when there are too many, those that weren't asked for lately are forgotten."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.now = self._before = _NONE

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, different and ascending, that have no ids; those of the others are in ``now``."""
        if len(self.now.key) + len(keys) > self.most // 2 or len(self.now.flat) > 4 * self.most:
            self.now, self._before = _NONE, self.now
        unknown = np.flatnonzero(~self.now.find(keys)[1])
        at, there = self._before.find(keys[unknown])
        self.now = self.now.joined(self._before.taken(at[there]))
        return unknown[~there]


class Tokens:
    """A vocabulary of fewer than 65,536 ids that never joins words across blanks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._known = Recent(REMEMBERED)
        (self._between,) = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(_END)]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_runs(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs: many in one call, told apart by the id of the mark between them."""
        known, mark = {}, _MARK.encode()
        marked = [r for r in runs if mark in r]
        for r, ids in zip(marked, self._encoded([r.decode() for r in marked]), strict=True):
            known[r] = ids.tobytes()
        plain = [r for r in runs if mark not in r]
        for i in range(0, len(plain), 512):
            group = plain[i : i + 512]
            (ids,) = self._encoded([f" {_MARK} ".encode().join(group).decode()])
            _cut(known, group, ids, np.flatnonzero(ids == self._between), 1)
        return known

    def _of_parts(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of parts that are one word to the tokenizer wherever they stand, and none of others.

        Beyond ASCII those are letters only; as each part is a word at least,
        a group is of single words exactly if it has as many ends of words as
        parts.
        """
        known = {}
        plain = []
        for p in parts:
            if p.isascii() or _LETTERS.fullmatch(p.decode()):
                plain.append(p)
            else:
                known[p] = b""
        for i in range(0, len(plain), 512):
            group = plain[i : i + 512]
            (ids,) = self._encoded([b" ".join(group).decode()])
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                _cut(known, group, ids, ends[:-1], 0)
            else:
                for part, own in zip(group, self._encoded([p.decode() for p in group]), strict=True):
                    single = self._ends[own].sum() == 1 and self._ends[own[-1]]
                    known[part] = own.tobytes() if single else b""
        return known

    def encode_buffer(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a buffer, as unsigned 16-bit numbers.

        Normalizing, splitting and merging all stay within runs between
        blanks. A run is letters and signs in turn, which are words each, or
        odd, and tokenized as a whole. Each different word or odd run is
        looked up once.
        """
        if not len(data):
            return [np.zeros(0, "<u2")] * (len(at) - 1)
        kind = _KINDS[data]
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        edge = at[:-1][np.diff(at) > 0]
        change[edge] = True
        start = np.flatnonzero(change)
        end = np.append(start[1:], len(data))
        begins = np.ones(len(start), bool)  # a run
        begins[1:] = kind[start[1:] - 1] == _BLANK
        begins[np.searchsorted(start, edge)] = True
        of = kind[start]
        start, end, begins, of = (x[of != _BLANK] for x in (start, end, begins, of))
        if not len(start):
            return [np.zeros(0, "<u2")] * (len(at) - 1)
        run = np.cumsum(begins) - 1
        run_end = end[np.append(np.flatnonzero(begins)[1:], len(start)) - 1]
        odd = np.zeros(run[-1] + 1, bool)
        odd[run[of == _ODD]] = True
        raw, folded = data.tobytes(), _FOLDED[data].tobytes()
        hashes = W.Hasher(data)(start, end)
        exact = None
        while True:
            used = np.flatnonzero(~odd[run] | begins)
            whole = odd[run[used]]
            first, last = start[used], np.where(whole, run_end[run[used]], end[used])
            h = hashes[used]
            if whole.any():
                exact = exact or W.Hasher(data, fold=False)
                h[whole] = W.mix(~exact(first[whole], last[whole]))
            keys, one, which = np.unique(h, return_index=True, return_inverse=True)
            new = self._known.missing(keys)
            of_runs, begin, until = (x[one[new]].tolist() for x in (whole, first, last))
            names = [(raw if o else folded)[i:j] for o, i, j in zip(of_runs, begin, until, strict=True)]
            runs, parts = ([n for n, o in zip(names, of_runs, strict=True) if o == kind_of] for kind_of in (True, False))
            runs, parts = self._of_runs(runs), self._of_parts(parts)
            learned = Ids.of(keys[new], [(runs if o else parts)[n] for n, o in zip(names, of_runs, strict=True)])
            known = self._known.now = self._known.now.joined(learned)
            at_key, _ = known.find(keys)
            several = (known.size[at_key] == 0) & ~whole[one]
            if not several.any():
                break
            odd[run[used[several[which]]]] = True
        out = known.at(at_key[which])
        to = np.cumsum(known.size[at_key][which], dtype=np.int64)
        return np.split(out, np.append(0, to)[np.searchsorted(first, at[1:-1])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [x for *_, data, at in text_slices(pa.array(texts, pa.string()), GATHERED) for x in self.encode_buffer(data, at)]


def _cut(known: dict[bytes, bytes], names: list[bytes], ids: np.ndarray, ends: np.ndarray, left_out: int) -> None:
    """Give each name the ids up to its end, and from there on without so many of them."""
    raw, start = ids.tobytes(), 0
    for name, end in zip(names, [*(2 * ends).tolist(), len(raw)], strict=True):
        known[name] = raw[start:end]
        start = end + 2 * left_out


@lru_cache(2)
def _tokens(path: str) -> Tokens:
    """A worker loads each vocabulary once."""
    return Tokens(path)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False), T.StructField("doc_tokens", T.LongType(), False),
])
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)


def pieces(documents: DataFrame, path: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Every document's pieces: full ones of ``length`` tokens, then the rest.

    Each has its place in its document, its length, the crc32 of its ids as
    little-endian 32-bit numbers, and with ``ids`` the ids. ``path`` is the
    vocabulary's file on every machine.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in it:
            names = batch.column(0).to_pylist()
            for i, j, data, at_text in text_slices(batch.column(1), GATHERED):
                rows: list[tuple] = []
                cut: list[np.ndarray] = []
                for name, found in zip(names[i:j], tokens.encode_buffer(data, at_text), strict=True):
                    all_ids = np.append(found.astype("<u4"), np.uint32(CLOSING))
                    for at in range(0, len(all_ids), length):
                        piece = all_ids[at : at + length]
                        rows.append((name, at, len(piece), zlib.crc32(piece), len(all_ids)))
                        if ids:
                            cut.append(piece.astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if ids:
                    columns.append(pa.array(cut, pa.list_(pa.field("element", pa.int32(), False))))
                yield pa.record_batch(columns, names=[*PIECES.names, *(["ids"] if ids else [])])

    return documents.select("doc_id", "text").mapInArrow(released(batches), T.StructType([*PIECES, _IDS]) if ids else PIECES)


@dataclass
class Slots:
    """Runs of places for pieces of one length, ordered by length and rank.

    The piece of rank ``first + k`` goes to sequence ``sequence + k`` at
    ``offset``, up to the next run.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first over a histogram: counts and contents of packs.

    Work and result depend on the number of lengths, not of pieces: placing a
    length splits one pattern at most.
    """
    if any(not 0 < size <= length for size in histogram):
        raise ValueError(f"lengths have to be from 1 to {length}")
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        placed: list[tuple[int, int, tuple[int, ...]]] = []
        while left:
            room = max(by_room, default=0)
            if room < size:
                placed.append((length - size, left, (size,)))
                break
            count, content = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(count, left)
            if count > used:
                by_room.setdefault(room, []).append((count - used, content))
            # the rest of this length may join the same pack again
            by_room.setdefault(room - size, []).append((used, (*content, size)))
            left -= used
        for room, count, content in placed:
            fits = length // size
            full, over = divmod(count, fits)
            if full:
                by_room.setdefault(length - fits * size, []).append((full, (size,) * fits))
            if over:
                by_room.setdefault(length - over * size, []).append((1, (size,) * over))
    return [x for room in sorted(by_room) for x in by_room[room]]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> Slots:
    """The places that patterns offer, as runs."""
    rank: dict[int, int] = {}
    runs, sequence = [], 0
    for count, content in found:
        offset = 0
        for size in content:
            runs.append((size, rank.get(size, 0), sequence, offset))
            rank[size] = rank.get(size, 0) + count
            offset += size
        sequence += count
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Slots(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of a table of pieces with ``sequence_id`` and ``offset``.

    Only the histogram, at most ``length`` numbers, comes to the driver. A
    length that many pieces share is ranked in parts: by a hash, then by the
    number of pieces in the parts before.
    """
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(patterns(counts, length))
    parts = 16 + max(counts.values(), default=0) // RANKED
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    keys = places.length << 48 | places.first
    names = cut.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, rank = batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy()
            run = np.searchsorted(keys, size << 48 | rank, "right") - 1
            sequence = pa.array(places.sequence[run] + rank - places.first[run])
            yield pa.record_batch([*batch.columns[: len(names)], sequence, pa.array(places.offset[run])], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    return ranked.select(*names, "rank").mapInArrow(released(batches), schema)


def packed(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Documents' pieces with their places. The pieces are written once, so no text is tokenized twice."""
    return pack(written(pieces(documents, path, length), "pieces"), length)
