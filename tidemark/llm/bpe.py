"""Byte-level BPE: text to token ids and back, with a public vocabulary.

Pieces of text are found by the vocabulary's pattern. Each piece's bytes are
symbols of a doubly linked list; a heap holds the merges that adjacent
symbols allow, lowest rank first and leftmost among equals. An entry whose
symbols have since merged is stale and skipped. Decoding concatenates the
ids' byte strings.

Null and empty texts have no tokens and decode to the empty text. A special
token's string in a text is that token, as in the library whose files these
are. Ties and repeated rows don't matter: each row is encoded by its text
alone. An empty table gives an empty result. Texts of any length are encoded
whole; the cache of pieces is bounded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces whose ids a worker remembers; when there are more it forgets them all.
CACHE_PIECES = 1 << 18

#: Fixed: how byte-level vocabularies split text. White space is Unicode's property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as themselves, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.strings: list[bytes] = [b""] * (max(chain(vocabulary.values(), (t["id"] for t in spec["added_tokens"]))) + 1)
        for token, i in vocabulary.items():
            self.strings[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.first = [vocabulary[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        self._pieces = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbols = [self.first[b] for b in piece]
        n, merges = len(symbols), self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of its symbols has merged
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((joined, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> bytes:
        known, merge, out = self._known, self.merge, []
        for piece in self._pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, as unsigned 32-bit numbers."""
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Bpe:
    """A worker loads each vocabulary once."""
    return Bpe(path)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])


def encode(documents: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """Each row's doc_id, token ids and the text that they decode to (empty if not asked for).

    ``path`` is the vocabulary's file on every machine.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in it:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            i = 0
            while i < len(texts):  # a few hundred texts at a time, fewer if they are long
                values, sizes, decoded, size = [], [0], [], 0
                start = i
                while i < len(texts) and size < 1 << 20:
                    found = bpe.encode(texts[i].as_py() or "")
                    values.append(found)
                    sizes.append(sizes[-1] + len(found))
                    decoded.append(bpe.decode(found.tolist()) if decode else "")
                    size += 4 * len(found)
                    i += 1
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(values).astype(np.int32)))
                yield pa.record_batch([ids.slice(start, i - start), lists.cast(_IDS), pa.array(decoded, pa.string())], names=ENCODED.names)

    return documents.select("doc_id", "text").mapInArrow(batches, ENCODED)


_IDS = pa.list_(pa.field("element", pa.int32(), False))
