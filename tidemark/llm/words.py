"""Words of many texts at once: their places and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STRIDE = 1 << 16


def byte_table(outside: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word; ``outside`` lists those that don't."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Words between blanks: space and the controls from tab to carriage return.
BLANK = byte_table(b" \t\n\v\f\r")
#: Words of digits, letters and all bytes from 0x80.
ALNUM = byte_table(bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _values(fold: bool) -> np.ndarray:
    v = np.arange(256, dtype=np.uint64)
    if fold:
        v[65:91] += np.uint64(32)
    return mix(v + np.uint64(1))


_BYTE_VALUES = {fold: _values(fold) for fold in (False, True)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_TABLES: list[np.ndarray] = [_powers(_ODD, _STRIDE), _powers(_INVERSE, _STRIDE)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        size = 1 << int(n - 1).bit_length()
        found = [_powers(_ODD, size), _powers(_INVERSE, size)]
        if size > 1 << 23:  # for one very long text only
            return found
        _TABLES[:] = found
    return _TABLES


@dataclass
class Words:
    """Words in text order: byte ``start`` and ``end``; ``at[d]:at[d + 1]`` are those of text d."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def find(data: np.ndarray, at: np.ndarray, table: np.ndarray = BLANK) -> Words:
    """Maximal runs of word bytes; a word ends where its text ends."""
    inside = table[data]
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    edge = at[:-1][np.diff(at) > 0]  # first bytes of texts
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, at))


class Hasher:
    """Hashes of any byte ranges of one buffer, in constant time each.

    Polynomial hashes modulo 2**64 with mixed byte values, mixed again; two
    different strings of natural text share one with a chance of 2**-64.
    """

    def __init__(self, data: np.ndarray, fold: bool = True) -> None:
        power, self._inverse = _tables(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[fold][data] * power[: len(data)], out=self._sum[1:], dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words and the offsets of each text's.

    A text of fewer words has one shingle of all its words; one without any
    has the shingle 0.
    """
    count = np.diff(at)
    made = np.maximum(count - size + 1, 1)
    to = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(to[-1], np.uint64)
    full = count >= size
    if len(hashes) >= size:
        rolled = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            rolled *= _ODD
            rolled += hashes[k : len(hashes) - size + 1 + k]
        inner = np.repeat(full, made)
        shift = np.repeat(at[:-1] - to[:-1], made)
        places = np.arange(to[-1])[inner]
        out[places] = mix(rolled[places + shift[inner]])
    for d in np.flatnonzero(~full & (count > 0)):
        h = np.uint64(0)
        for x in hashes[at[d] : at[d + 1]]:
            h = np.uint64((int(h) * int(_ODD) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[to[d]] = mix(np.array([h ^ np.uint64(count[d])]))[0]
    return out, to
