"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of three words, each labelled with how often it
came before. A sketch keeps, for one hash function, the two k-mers that
hash least, in the order of the text: two texts agree on it with a chance
that falls with their edit distance, and not only with the k-mers they
share. Texts that agree on a sketch are candidates, and so are short texts
that share a run of the length that no edits within the bound can break up:
none of their near pairs is missed. Their edit distance in
words is computed along a band of diagonals that widens with the edits
allowed; they are near if it is at most a fifth of the longer text.

Words stand between blanks, A-Z as a-z. Equal texts are one class before any
sketch is made; so are null, empty and blank texts if they are equal. Rows
of one doc_id are one document. Rows with a null id can't be named: they get
no class and take no part. Ties go to the smaller id. An empty table gives an
empty result. Texts of any length are compared whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.groups import Measure, near_classes, signatures
from tidemark.llm.storage import settled

#: Words of a k-mer, and the similarity from which texts are near: 1 - edits / words of the longer.
SHINGLE, NEAR = 3, 0.8
#: Sketches of a text and k-mers in each. With a fifth of the words replaced, 5 of 6,000 pairs had no sketch in common if that was here and there, 112 of 6,000 if it was every fifth word.
SKETCHES, KEPT = 64, 2
#: Pairs of texts of at most so many words are found by the runs that they must share.
SHORT = 40

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.default_rng(19).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """K-mers of texts, each mixed with how often it came before in its text."""
    text = np.repeat(np.arange(len(to) - 1, dtype=np.uint64), np.diff(to))
    key = W.mix(x + text * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    times = np.empty(len(x), np.uint64)
    times[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return np.where(times > 0, W.mix(x ^ W.mix(times)), x)


def sketches(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SKETCHES keys for each text, of its words' hashes.

    The hash functions multiply by odd numbers; a k-mer's place takes the low
    bits of its hash, so that a least hash tells where it is, and of equal
    ones the first counts.
    """
    x, to = W.shingles(hashes, at, SHINGLE)
    x = labelled(x, to)
    n = np.diff(to)
    out = np.empty((len(n), SKETCHES), np.uint64)
    full = n >= KEPT
    for d in np.flatnonzero(~full):  # too short to choose from: all k-mers are kept
        key = np.uint64(n[d])
        for v in x[to[d] : to[d + 1]]:
            key = W.mix(np.array([key ^ v]))[0]
        out[d] = key
    if not full.any():
        return out
    x = x[np.repeat(full, n)]
    n = n[full]
    start = np.cumsum(n) - n
    low = np.uint64((1 << int(n.max() - 1).bit_length()) - 1)
    place = (np.arange(len(x)) - np.repeat(start, n)).astype(np.uint64)
    h, places = np.empty_like(x), np.empty((KEPT, len(n)), np.int64)
    for k in range(SKETCHES):
        np.multiply(x, _SEEDS[k], out=h)
        h &= ~low
        h |= place
        for j in range(KEPT):
            places[j] = start + (np.minimum.reduceat(h, start) & low).astype(np.int64)
            h[places[j]] = _TOP
        places.sort(0)
        key = np.full(len(n), k + 1, np.uint64)
        for j in range(KEPT):
            key = W.mix(key ^ x[places[j]])
        out[full, k] = key
    return out


def _edits(words: int, least: float = NEAR) -> int:
    """Edits within the bound for a pair whose longer text has so many words."""
    return int((1 - least) * words + 1e-9)


def _run_lengths(words: int) -> set[int]:
    """Lengths of the runs a text shares with each near one, if both have at most SHORT words.

    Of n words in the longer text e edits leave n - e or more, in e + 1 runs
    at most: the longest has the mean length or more.
    """
    longer = (n for n in range(max(words, 1), SHORT + 1) if n - _edits(n) <= words)
    return {-(-(n - _edits(n)) // (_edits(n) + 1)) for n in longer}


_RUNS = [_run_lengths(n) for n in range(SHORT + 1)]
#: Texts of fewer words are near to none of more than SHORT words, and need no sketches.
_SKETCHED = SHORT + 1 - _edits(SHORT + 1)


def keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of texts, two of which are candidates if they have one in common, and the offsets of each text's."""
    size = np.diff(at)
    long = (size >= _SKETCHED) | (size == 0)
    of_long = sketches(hashes[np.repeat(long, size)], np.concatenate([[0], np.cumsum(size[long])]))
    owner, found = [np.repeat(np.flatnonzero(long), SKETCHES)], [of_long.ravel()]
    for run in sorted(set().union(*_RUNS)):
        of = np.isin(size, [n for n in range(1, SHORT + 1) if run in _RUNS[n]])
        if of.any():
            x, to = W.shingles(hashes[np.repeat(of, size)], np.concatenate([[0], np.cumsum(size[of])]), run)
            owner.append(np.repeat(np.flatnonzero(of), np.diff(to)))
            found.append(W.mix(x ^ np.uint64(SKETCHES + run)))
    texts, values = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    new = np.ones(len(order), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(texts[new], np.arange(len(at)))


def _band(a: list[int], b: list[int], k: int) -> int:
    """Edit distance within k diagonals of the main one, exact if it is at most k.

    Bits of whole numbers hold the differences between the rows of a column
    of the alignment, for the 2 k + 1 rows of the band; a column costs a few
    operations on them. The distance is followed down the band's lowest
    diagonal to the last row, and along it to the last column.
    """
    m, full = len(a), (1 << 2 * k + 1) - 1
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i + k
    up, down = full >> k << k, 0  # before the first column each row is one more than the row above
    top, distance = 1 << 2 * k, min(m, k)
    for j, w in enumerate(b, 1):
        equal = places.get(w, 0) >> j - 1 & full
        flat = (((equal & up) + up ^ up) | equal | down) & full  # where a diagonal step costs nothing
        right, left = down | (flat | up) ^ full, up & flat
        if j <= m - k:
            distance += not flat & top
        else:
            row = m - j + k
            distance += (right >> row & 1) - (left >> row & 1)
        up, down = left | (flat >> 1 | right) ^ full, right & flat >> 1
    return distance


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to add, drop or replace to turn a into b; most + 1 if there are more than ``most``.

    Equal words at both ends are left out, and texts whose words differ too
    much in number are refused. The rest is aligned along a band, which is
    widened until the distance fits into it.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(unlike[0]) if len(unlike) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(max(len(a), len(b)), most + 1)
    # each edit mends at most one word that only one side has
    both, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(which[: len(a)], minlength=len(both)) - np.bincount(which[len(a) :], minlength=len(both))
    least = max(int(surplus[surplus > 0].sum()), int(-surplus[surplus < 0].sum()))
    if least > most:
        return most + 1
    x, y = which[: len(a)].tolist(), which[len(a) :].tolist()
    k = min(most, max(14, abs(len(x) - len(y)), least + least // 2))
    while True:
        found = _band(x, y, k)
        if found <= k:
            return found
        if k >= most:
            return most + 1
        k = min(most, 3 * k)


def similarity(a: np.ndarray, b: np.ndarray, least: float = NEAR) -> float:
    """1 - edits / words of the longer, or 0 if that is below ``least``."""
    longer = max(len(a), len(b))
    most = _edits(longer, least)
    e = edit_distance(a, b, most)
    return 1 - e / longer if longer and e <= most else float(not longer)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = W.find(data, at)
    return W.Hasher(data)(words.start, words.end), words.at


def _described(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, words = _words(data, at)
    return np.diff(words), signatures(hashes, words), *keys(hashes, words)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    hashes, words = _words(data, at)
    return np.split(hashes, words[1:-1])


def measure(least: float = NEAR) -> Measure:
    """Edit similarity in words. An edit takes a word from one text, or gives one, or both: of the words' counts two change at most."""
    edits = lambda larger, _: 2 * np.floor((1 - least) * larger + 1e-9)
    return Measure(_described, _word_hashes, lambda x, y: similarity(x, y, least), edits, least)


def near_duplicates(documents: DataFrame, least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, likeness)`` that joined groups, and ``(doc_id, class_id)`` of documents in a group: see ``near_classes``."""
    return near_classes(documents, measure(least))


def classes(documents: DataFrame, least: float = NEAR) -> DataFrame:
    """Every row's doc_id with the class_id of its group, which is its own id if it is alone."""
    known = settled(documents.sparkSession, "classes", lambda: near_duplicates(documents, least)[1])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(documents: DataFrame, least: float = NEAR) -> DataFrame:
    """The documents whose id is their class's, so one of each group. Rows that share that id all stay, as do rows with a null id."""
    others = lambda: near_duplicates(documents, least)[1].filter("doc_id != class_id").select(F.col("doc_id").alias("gone_id"))
    gone = settled(documents.sparkSession, "gone", others)
    return documents.join(gone, documents["doc_id"].cast("long") == F.col("gone_id"), "left_anti")
