import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import words as W
from tidemark.llm.arrow import folds, slices, strings, text_slices


def test_words_equal_a_pattern_over_many_texts():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB9é日 \t\n.-\x0b") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    for table, pattern in ((W.BLANK, rb"[^ \t\n\v\f\r]+"), (W.ALNUM, rb"[0-9A-Za-z\x80-\xff]+")):
        for i, j, data, at in text_slices(pa.array(texts), 200):
            found = W.find(data, at, table)
            raw = data.tobytes()
            for d in range(j - i):
                mine = slice(found.at[d], found.at[d + 1])
                assert [raw[a:b] for a, b in zip(found.start[mine], found.end[mine], strict=True)] == re.findall(pattern, texts[i + d].encode())


def test_equal_words_hash_alike_wherever_they_stand():
    data, at = strings(pa.array(["The cat the", "CAT x the", None, "y" * 70_000 + " cat"]))
    found = W.find(data, at)
    h = W.Hasher(data)(found.start, found.end)
    the1, cat1, the2, cat2, x, the3, long, cat3 = h.tolist()
    assert the1 == the2 == the3 and cat1 == cat2 == cat3 and len({the1, cat1, x, long}) == 4
    strict = W.Hasher(data, fold=False)(found.start, found.end).tolist()
    assert strict[0] != strict[2] == strict[5]


def test_shingles_of_long_short_and_empty_texts():
    data, at = strings(pa.array(["a b c d e f", "a b c d e", "a b", "", "b c d e f", "a b"]))
    found = W.find(data, at)
    x, to = W.shingles(W.Hasher(data)(found.start, found.end), found.at, 5)
    assert np.diff(to).tolist() == [2, 1, 1, 1, 1, 1]
    assert x[0] == x[2] and x[1] == x[5] and x[3] == x[6] and x[4] == 0 and len(set(x.tolist())) == 4


def test_slices_and_folds():
    assert list(slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices(np.zeros(1, np.int64))) == []
    assert folds([None, 1], 5).tolist()[0] == -1
    data, at = strings(pa.array(["ab", None, "c"]).slice(1))
    assert at[-1] - at[0] == 1
