"""License scans: identifier tags and notice phrases, with licence expressions.

An Aho-Corasick automaton over the words of a text finds known phrases and
the tag that announces a licence expression. A shunting-yard parser turns an
announced expression into postfix, from which its identifiers and how free
its choices leave the reader are evaluated: ``OR`` takes its freest side,
``AND`` its strictest, ``WITH`` loosens a licence by an exception. Words of
letters alone are identifiers only if they are known ones.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in
lower case; a phrase is found where its words stand consecutively, whatever
stands between them. Null and empty texts have no words and no labels, and
score 0. An expression goes on over a line end, but not over a blank line,
while a parenthesis is open or an operator waits for its operand; an operator
left without one is dropped. An expression that can't be parsed gives the
label ``unparsed``.
Ties and repeated rows don't matter: each row is scanned by its text alone.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed: phrases that the scan is asked for, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notice phrases of this scan's own, and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "without warranty of any kind": "no-warranty",
    "licensed under": "licensed-under",
}

#: Words that announce an expression.
TAG = "spdx license identifier"

#: How free families of identifiers leave the reader, from 0 to 1, by prefix.
FREEDOM = {
    "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.85, "zlib": 0.9, "cc-by-sa": 0.5, "cc-by-nc": 0.2, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "agpl": 0.3, "gpl": 0.4,
}

#: Fixed: identifiers of letters alone. All others have a digit, a hyphen, a dot or a plus sign.
SHORT = {"aladdin", "beerware", "curl", "ftl", "ijg", "isc", "json", "libpng", "mit", "ncsa", "ntp", "openssl", "php", "python", "ruby", "tcl", "unlicense", "wtfpl", "xnet", "zed", "zlib"}

#: Evidence that one base phrase, one notice and one expression give; together they combine by noisy-or.
EVIDENCE = {"base": 0.7, "notice": 0.4, "expression": 0.9}

_NOT_WORD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def normal(text: str) -> tuple[str, int]:
    """The words between single blanks, with one at each end, and their number."""
    words = text.encode("utf-8", "replace").translate(_NOT_WORD).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} ", len(words)


class Unparsed(ValueError):
    """Not an expression of identifiers, AND, OR, WITH and parentheses."""


_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[^\S\n]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
#: A line end, and the mark of a comment that may go on behind it.
_LINE_END = re.compile(r"[^\S\n]*\n[^\S\n]*(?:\*(?!/)|#+|;+|%+|//+|--+)?")


def _identifies(word: str) -> bool:
    return word.lower() in SHORT or not word.isalpha()


def tokens(text: str, at: int = 0) -> list[str]:
    """The longest run of tokens that alternate as an expression's do, from ``at``; the line's end ends it if it could be whole there."""
    found: list[str] = []
    operand, depth = True, 0
    while True:
        m = _TOKEN.match(text, at)
        if not m and found and (operand or depth) and (end := _LINE_END.match(text, at)):
            m = _TOKEN.match(text, end.end())
        if not m:
            break
        x = m[1]
        is_operator = x.lower() in _BINDS
        if x == ")" and depth == 0 or operand != (x == "(" or not is_operator and x != ")"):
            break
        if operand and x != "(" and not _identifies(x):
            break  # prose goes on behind the expression
        depth += (x == "(") - (x == ")")
        operand = x == "(" or is_operator
        found.append(x)
        at = m.end()
    while found and found[-1].lower() in _BINDS:
        found.pop()
    return found


def postfix(parts: list[str]) -> list[str]:
    """Shunting-yard: operands in order, each operator behind its two sides. WITH binds closest, then AND, then OR."""
    out: list[str] = []
    held: list[str] = []
    for x in parts:
        low = x.lower()
        if x == "(":
            held.append(x)
        elif x == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise Unparsed(" ".join(parts))
            held.pop()
        elif low in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
        else:
            out.append(low)
    if "(" in held:
        raise Unparsed(" ".join(parts))
    return out + held[::-1]


def freedom(identifier: str) -> float:
    found = [k for k in FREEDOM if identifier.startswith(k)]
    return FREEDOM[max(found, key=len)] if found else 0.5


def evaluate(parts: list[str]) -> tuple[frozenset[str], float]:
    """The identifiers of an expression in postfix, and how free it leaves the reader."""
    stack: list[tuple[frozenset[str], float]] = []
    for x in parts:
        if x not in _BINDS:
            stack.append((frozenset([x]), freedom(x)))
            continue
        if len(stack) < 2:
            raise Unparsed(" ".join(parts))
        (b, b_free), (a, a_free) = stack.pop(), stack.pop()
        if x == "with":
            if len(a) != 1 or len(b) != 1:
                raise Unparsed(" ".join(parts))
            stack.append((frozenset([f"{min(a)} with {min(b)}"]), min(1.0, a_free + 0.1)))
        else:
            stack.append((a | b, max(a_free, b_free) if x == "or" else min(a_free, b_free)))
    if len(stack) != 1:
        raise Unparsed(" ".join(parts))
    return stack[0]


@dataclass
class Scan:
    words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)  # start word and label of each place
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    free: float | None = None
    score: float = 0.0


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: TAG})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    a.make_automaton()
    return a


_GAP = r"[^0-9A-Za-z\x80-\U0010ffff]+"
_TAG = re.compile(rf"spdx{_GAP}license{_GAP}identifier[^0-9A-Za-z\x80-\U0010ffff(]+", re.IGNORECASE | re.ASCII)


def scan(text: str) -> Scan:
    """All that one text says on licences."""
    plain, n = normal(text)
    out = Scan(words=n)
    hits = sorted((end - size + 1, kind, label) for end, (kind, label, size) in _automaton().iter(plain))
    if not hits:
        return out
    doubt = 1.0
    notices = set()
    word = counted = 0
    for at, kind, label in hits:
        word += plain.count(" ", counted, at)
        counted = at
        if kind == "base":
            out.base.append((word, label))
        elif kind == "notice":
            notices.add(label)
    out.base.sort()
    out.labels = {label for _, label in out.base} | notices
    doubt *= (1 - EVIDENCE["base"]) ** len({label for _, label in out.base}) * (1 - EVIDENCE["notice"]) ** len(notices)
    if any(kind == "tag" for _, kind, _ in hits):
        for m in _TAG.finditer(text):
            parts = tokens(text, m.end())
            try:
                names, free = evaluate(postfix(parts))
            except Unparsed:
                out.labels.add("unparsed")
                continue
            out.expressions.append(" ".join(parts))
            out.labels |= {"spdx:" + x for x in names}
            out.free = free if out.free is None else min(out.free, free)
            doubt *= 1 - EVIDENCE["expression"]
    out.score = 1 - doubt
    return out


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType(), False),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType(), False), T.StructField("label", T.StringType(), False)]), False), False),
    T.StructField("labels", T.ArrayType(T.StringType(), False), False),
    T.StructField("expressions", T.ArrayType(T.StringType(), False), False),
    T.StructField("freedom", T.DoubleType()),
    T.StructField("score", T.DoubleType(), False),
])

_PLACES = pa.list_(pa.field("element", pa.struct([pa.field("word", pa.int64(), False), pa.field("label", pa.string(), False)]), False))
_NAMES = pa.list_(pa.field("element", pa.string(), False))


def find(documents: DataFrame) -> DataFrame:
    """Each row's doc_id, number of words, places of base phrases, sorted labels, expressions, how free they are and the score."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [scan(x.as_py() or "") for x in batch.column(1)]
            yield pa.record_batch([
                batch.column(0).cast(pa.int64()), pa.array([s.words for s in found], pa.int64()), pa.array([[{"word": w, "label": label} for w, label in s.base] for s in found], _PLACES),
                pa.array([sorted(s.labels) for s in found], _NAMES), pa.array([s.expressions for s in found], _NAMES), pa.array([s.free for s in found], pa.float64()), pa.array([s.score for s in found], pa.float64()),
            ], names=FOUND.names)

    return documents.select("doc_id", "text").mapInArrow(batches, FOUND)
