import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common import DATA, edge_rows, frame
from pyspark.sql import functions as F

from tidemark.llm import ann, lm, registry
from tidemark.llm.arrow import text_slices


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)), np.uint64)
    place = ann.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)].astype(int), axis=0)).sum(1)
    assert (steps == 1).all()


def exact(rows, queries, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)
        if len(at):
            s = unit @ unit[at[0]]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df) -> dict:
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_small_tables_edges_and_ties_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(2000 + i, (2 * np.array(rows[7][1])).tolist()) for i in range(3)]
    rows += [(None, rows[0][1]), (300, None), (350, [0.0] * 8), (400, [1.0, None] + [0.0] * 6), (450, [math.nan] * 8), (500, [math.inf] + [0.0] * 7), (550, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int").repartition(5)
    want = exact(rows, range(0, 2100, 50))
    same(answers(ann.search(df, F.col("vec_id") % 50 == 0)), want)
    few = df.filter("vec_id in (1, 2, 3, 50)")
    same(answers(ann.search(few, F.col("vec_id") % 50 == 0)), exact([r for r in rows if r[0] in (1, 2, 3, 50)], [50]))
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert answers(ann.search(df.filter("vec_id = 50"), F.col("vec_id") % 50 == 0)) == {}


def test_recall_over_many_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE", 150)
    monkeypatch.setattr(ann, "BLOCK", 15)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(ann.search(df, F.col("vec_id") % 50 == 0)), exact(rows, range(0, 2500, 50))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize(("clusters", "most"), [(0, 0.97), (60, 0.4)])
def test_windows_find_nine_of_ten_with_less_work_than_all_pairs(clusters, most):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30_000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.3 * x
    index = ann.fit(x[: ann.SAMPLE], len(x) // ann.RANGE)
    at, unit, asked = index.at(x), x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(0, 30_000, 150)
    assert index.ranges >= 10 and index.curves >= 2
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    inside = np.abs(at[:, asked, None] - at[:, None, :]) <= index.reach
    assert np.take_along_axis(inside.any(0), np.argsort(-near, axis=1)[:, :5], 1).mean() >= 0.9
    assert inside[0].mean() + sum((i & ~inside[0]).mean() for i in inside[1:]) < most


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_squares_that_overflow_or_vanish(spark, size):
    rows = [(50, [size, size, 0.0]), (1, [2 * size, 2 * size, 0.0]), (2, [size, 0.0, 0.0]), (3, [0.0, 0.0, 1.0])]
    got = answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50))
    assert [i for i, _ in got[50]] == [1, 2, 3]
    assert np.allclose([s for _, s in got[50]], [1, math.sqrt(0.5), 0], atol=1e-12)


def test_query_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = answers(registry.QUERIES["op9_nearest"](spark, DATA))
    hits = 0
    for q in got:
        s = x @ x[ids == q][0]
        hits += len(set(ids[np.argsort(-s)][1:6].tolist()) & {i for i, _ in got[q]})
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0} and hits >= 0.9 * 5 * len(got)


def brute_ppm(training: list[str]):
    """Escapes and exclusions, byte by byte."""
    order, seen = lm.ORDER, defaultdict(Counter)
    padded = lambda t: [lm.START] * order + list(t.encode()) + [lm.END]
    for t in training:
        b = padded(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[tuple(b[i - k : i])][b[i]] += 1

    def score(t: str) -> float:
        b, total = padded(t), 0.0
        for i in range(order, len(b)):
            k = max((k for k in range(order + 1) if tuple(b[i - k : i]) in seen), default=0)
            ruled_out, p = set(), 1.0
            while k >= 0:
                counts = {x: n for x, n in seen.get(tuple(b[i - k : i]), {}).items() if x not in ruled_out}
                whole = sum(counts.values()) + len(counts)
                if b[i] in counts:
                    p *= counts[b[i]] / whole
                    break
                p *= len(counts) / whole if counts else 1
                ruled_out |= set(counts)
                k -= 1
            else:
                p /= 256 - len(ruled_out)
            total += math.log10(p)
        return total

    return score


def corpus() -> list[str]:
    rnd = random.Random(5)
    return ["".join(rnd.choice("aabbc d.é\n") for _ in range(rnd.randint(0, 60))) for _ in range(70)]


def baseline(rows):
    """Add-one probabilities of words, from the definition."""
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


@pytest.mark.parametrize(("head", "pairs"), [(0, 1 << 20), (3, 0), (1 << 17, 300)])
def test_scores_equal_brute_force(spark, monkeypatch, head, pairs):
    """Commonest words and contexts are held by the tasks, the others joined: none, some or all."""
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "HELD_PAIRS", pairs)
    rnd = random.Random(1)
    rows = list(enumerate(corpus())) + [(100 + i, "".join(rnd.choice("abXy zé日") for _ in range(30))) for i in range(30)] + [(200, None), (201, "")]
    df = frame(spark, rows).repartition(4)
    model, words = lm.train(df)
    assert len(zlib.decompress(model.packed)) // 16 <= pairs and (model.held is None) == (pairs == 1 << 20)
    got = {r.doc_id: r for r in lm.score(df, model, words).collect()}
    want = baseline(rows)
    score = brute_ppm([t or "" for i, t in rows if not want[i][0]])
    assert got.keys() == want.keys()
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[i][:4]
        assert r.base_score == pytest.approx(want[i][4], rel=1e-9)
        assert r.score == pytest.approx(score(t or ""), abs=1e-4)


def test_blocks_give_the_same_scores():
    tally = lm._Tally()
    for *_, data, at in text_slices(pa.array(corpus())):
        tally.add(lm.codes(data, at))
    tally.merge()
    keys, counts = tally.keys, tally.counts
    low = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), counts, 1 << 16).astype(np.int64).reshape(256, 256)
    last = (keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)
    block_of = np.maximum(np.cumsum(np.bincount(last, minlength=1 << 16)) - 1, 0) // 40
    assert block_of.max() >= 3
    (part,) = [(data, at) for *_, data, at in text_slices(pa.array([*corpus(), "new Zz", ""]))]
    total = sum(lm.Trie.of(keys[block_of[last] == k], counts[block_of[last] == k], low).score(*part, block_of == k) for k in range(block_of.max() + 1))
    assert np.allclose(total, lm.Trie.of(keys, counts, low).score(*part), atol=1e-5)


def test_probabilities_of_the_next_byte_sum_to_one():
    tally = lm._Tally()
    for *_, data, at in text_slices(pa.array(["abab", "abc", "b"])):
        tally.add(lm.codes(data, at))
    tally.merge()
    low = np.bincount((tally.keys & np.uint64(0xFFFF)).astype(np.int64), tally.counts, 1 << 16).astype(np.int64).reshape(256, 256)
    trie = lm.Trie.of(tally.keys, tally.counts, low)
    seen = int(trie.symbol.max())
    p = 10.0 ** trie.log10.astype(float)
    whole = p[:, :seen].sum(1) + p[:, seen] * (256 - seen)
    assert (whole <= 1 + 1e-5).all() and whole[0] == pytest.approx(1, abs=1e-5)


def test_lm_edges(spark):
    rows = edge_rows()
    df = frame(spark, rows)
    got = lm.score(df, *lm.train(df)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2)) and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    empty = frame(spark, [])
    assert lm.score(empty, *lm.train(empty)).collect() == []
    only_held = frame(spark, [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])
    for r in lm.score(only_held, *lm.train(only_held)).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(-4 * math.log10(256))
