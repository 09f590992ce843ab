import random
import re

import pytest
from common import DATA, edge_rows, frame

from tidemark.llm import licenses, registry

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text: str):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = []
    for phrase, label in licenses.BASE.items():
        n = len(phrase.split())
        places += [(i, label) for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
    return len(words), sorted(places)


def test_base_places_equal_brute_force():
    rnd = random.Random(5)
    parts = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "é", "x1", " ", "-", "\n", " ", "License ", "mit license mit license", "İ", "\x00"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "-", "", ", "]) for _ in range(rnd.randint(0, 14)))
        found = licenses.scan(text)
        assert (found.words, found.base) == brute(text), text


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in registry.QUERIES["op5_licenses"](spark, DATA).collect():
        words, places = brute(docs.pop(r.doc_id))
        assert (r.n_words, r.n_base) == (words, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert not docs


@pytest.mark.parametrize(
    ("text", "names", "free"),
    [
        ("MIT", {"mit"}, 0.9),
        ("(MIT OR GPL-2.0-only) AND Apache-2.0", {"mit", "gpl-2.0-only", "apache-2.0"}, 0.85),
        ("MIT OR GPL-2.0-only AND LGPL-2.1", {"mit", "gpl-2.0-only", "lgpl-2.1"}, 0.9),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR agpl-3.0+", {"gpl-2.0 with classpath-exception-2.0", "agpl-3.0+"}, 0.5),
        ("MIT and (isc or (epl-2.0)) */ int x;", {"mit", "isc", "epl-2.0"}, 0.9),
    ],
)
def test_expressions(text, names, free):
    found = licenses.scan(f"// SPDX-License-Identifier: {text}\ncode")
    assert found.labels == {"spdx:" + n for n in names}
    assert found.free == pytest.approx(free)


def test_postfix_order_and_failures():
    assert licenses.postfix(["a", "OR", "b", "AND", "c", "WITH", "d"]) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for text in ("", "(MIT", "(MIT OR", "OR MIT", "(a or b) with c", "***"):
        assert "unparsed" in licenses.scan(f"SPDX-License-Identifier: {text}\n").labels, text


@pytest.mark.parametrize(("text", "labels"), [("MIT and more text", {"spdx:mit"}), ("MIT or (see below)", {"unparsed"}), ("LicenseRef-own OR Zlib with care", {"spdx:licenseref-own", "spdx:zlib"}), ("the usual", {"unparsed"})])
def test_prose_behind_an_expression_gives_no_identifiers(text, labels):
    assert licenses.scan(f"SPDX-License-Identifier: {text}\n").labels == labels


def test_choices_differ_from_obligations_in_the_query(spark, tmp_path):
    rows = [(1, "SPDX-License-Identifier: MIT OR GPL-2.0"), (2, "SPDX-License-Identifier: MIT AND GPL-2.0"), (3, "nothing")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.freedom, r.expressions) for r in registry.QUERIES["op5_licenses"](spark, str(tmp_path)).collect()}
    assert got == {1: (0.9, "MIT OR GPL-2.0"), 2: (0.4, "MIT AND GPL-2.0"), 3: (None, "")}


def test_places_of_many_hits_take_time_in_proportion():
    import time

    def seconds(n: int) -> float:
        began = time.process_time()
        assert licenses.scan("mit license " * n).base[-1] == (2 * n - 2, "mit")
        return time.process_time() - began

    seconds(1000)
    assert seconds(160_000) < 40 * seconds(20_000)  # 8 times as many, 64 times the time if each counted from the start


def test_edges(spark):
    rows = edge_rows() + [(8, "All rights reserved. Licensed under the Apache License.")]
    got = licenses.find(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all((r.n_words, r.score, r.labels) == (0, 0, []) for r in got if r.doc_id in (1, 2, 3))
    (last,) = (r for r in got if r.doc_id == 8)
    assert last.labels == ["all-rights-reserved", "apache", "licensed-under"] and [(p.word, p.label) for p in last.places] == [(6, "apache")]
    assert licenses.find(frame(spark, [])).collect() == []


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: (MIT OR\nApache-2.0)\nnext line", {"spdx:mit", "spdx:apache-2.0"}),
    ("# SPDX-License-Identifier: (MIT\r\n#   OR Apache-2.0) AND\r\n# ISC\r\n# more", {"spdx:mit", "spdx:apache-2.0", "spdx:isc"}),
    ("/* SPDX-License-Identifier: MIT OR\n * ISC\n */", {"spdx:mit", "spdx:isc"}),
    ("/* SPDX-License-Identifier: MIT OR\n */ int x;", {"spdx:mit"}),
    ("SPDX-License-Identifier: MIT AND", {"spdx:mit"}),
    ("SPDX-License-Identifier: MIT OR\n\nA new paragraph", {"spdx:mit"}),
    ("SPDX-License-Identifier: MIT\nOR Apache-2.0", {"spdx:mit"}),
    ("SPDX-License-Identifier: (MIT OR\nISC", {"unparsed"}),
])
def test_expressions_over_line_ends(text, labels):
    assert licenses.scan(text).labels == labels
