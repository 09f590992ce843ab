"""Near-duplicates, groups and fingerprints against all pairs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from common import DATA, edge_rows, frame, sentence
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, groups, neardup, registry
from tidemark.llm.arrow import text_slices


def plain_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def edited(rnd: random.Random, words: list[str], edits: int) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words) + 1)
        words[at : at + rnd.choice([0, 1, 1])] = rnd.choice([[], [f"n{rnd.randint(0, 10**6)}"]])
    return words


def test_banded_distance_equals_the_plain_one():
    rnd = random.Random(0)
    for _ in range(3000):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 20))]
        b = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 20))] if rnd.random() < 0.3 else [int(x) if x.isdigit() else 9 for x in edited(rnd, list(map(str, a)), rnd.randint(0, 5))]
        most, d = rnd.randint(0, 10), plain_distance(a, b)
        assert neardup.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(d, most + 1)


def test_sketches_know_order_and_repetition():
    a = "a b c d e f g h i j k l m n o p q r s t".split()
    texts = [" ".join(x) for x in (a, a, a[10:] + a[:10], [w.upper() for w in a], ["z"] * 30, ["z"] * 40, ["q"], [])]
    (keys,) = (neardup.sketches(*neardup._words(data, at)) for *_, data, at in text_slices(pa.array(texts)))
    same = lambda i, j: int((keys[i] == keys[j]).sum())
    assert same(0, 1) == same(0, 3) == neardup.SKETCHES and same(0, 2) < neardup.SKETCHES
    assert same(4, 5) < neardup.SKETCHES and same(6, 7) == 0


@pytest.fixture(scope="module")
def family():
    """Bases with copies and edits of few to many words."""
    rnd = random.Random(6)
    rows = []
    for base in range(12):
        words = sentence(rnd, rnd.randint(40, 150)).split()
        rows += [" ".join(words)] * rnd.choice([1, 1, 3])
        rows += [" ".join(edited(rnd, words, rnd.choice([1, 2, 4]) if base % 2 else len(words))) for _ in range(4)]
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_classes_equal_all_pairs(spark, family):
    links = [(i, j) for i, a in family for j, b in family if i < j and plain_distance(a.split(), b.split()) <= int(0.2 * max(len(a.split()), len(b.split())) + 1e-9)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, family).repartition(4)).collect()}
    assert got == least([i for i, _ in family], links)


def replaced(rnd: random.Random, words: list[str], places) -> list[str]:
    words = list(words)
    for at in places:
        words[at] = f"n{rnd.randint(0, 10**6)}"
    return words


def share_a_key(pairs) -> np.ndarray:
    texts = [" ".join(t) for p in pairs for t in p]
    sets = []
    for *_, data, at in text_slices(pa.array(texts)):
        found, to = neardup.keys(*neardup._words(data, at))
        sets += [set(x.tolist()) for x in np.split(found, to[1:-1])]
    return np.array([bool(x & y) for x, y in zip(sets[::2], sets[1::2], strict=True)])


def test_texts_at_the_threshold_are_candidates():
    """A fifth of the words replaced, here and there or every fifth: all pairs are near, nearly all have a key in common."""
    rnd = random.Random(11)
    bases = [sentence(rnd, rnd.randint(50, 400)).split() for _ in range(300)]
    spread = [(w, replaced(rnd, w, rnd.sample(range(len(w)), len(w) // 5))) for w in bases]
    even = [(w, replaced(rnd, w, range(2, len(w) // 5 * 5, 5))) for w in bases]
    assert all(neardup.similarity(*(np.unique(a + b, return_inverse=True)[1][s] for s in (slice(len(a)), slice(len(a), None)))) >= 0.8 for a, b in spread + even)
    assert share_a_key(spread).mean() >= 0.99
    assert share_a_key(even).mean() >= 0.95


def test_all_near_pairs_of_short_texts_are_candidates():
    rnd = random.Random(12)
    pairs = []
    while len(pairs) < 3000:
        a = sentence(rnd, rnd.randint(1, neardup.SHORT)).split()
        b = edited(rnd, a, rnd.randint(0, len(a) // 5 + 1))
        if 0 < len(b) <= neardup.SHORT and plain_distance(a, b) <= max(len(a), len(b)) // 5:
            pairs.append((a, b))
    assert share_a_key(pairs).all()


def test_classes_of_short_and_heavily_edited_texts_equal_all_pairs(spark):
    rnd = random.Random(13)
    rows = []
    for _ in range(60):
        words = sentence(rnd, rnd.randint(5, 90)).split()
        rows += [" ".join(words), " ".join(replaced(rnd, words, rnd.sample(range(len(words)), len(words) // 5)))]
    rows = list(enumerate(rows))
    links = [(i, j) for i, a in rows for j, b in rows if i < j and plain_distance(a.split(), b.split()) <= max(len(a.split()), len(b.split())) // 5]
    assert len(links) >= 60
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows)).collect()}
    assert got == least([i for i, _ in rows], links)


def test_one_of_each_group_stays(spark, family):
    docs = frame(spark, family)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_edges(spark):
    rows = edge_rows() + [(8, ""), (9, None)]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(frame(spark, rows)).collect())
    want = {1: 1, 2: 1, 8: 1, 9: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, None: None}
    assert [(i, c) for i, c in got if i not in ("3",)] == sorted((str(i), str(want[i])) for i, _ in rows if i != 3)
    assert neardup.classes(frame(spark, [])).count() == 0
    stay = sorted(str(r.doc_id) for r in neardup.keep_one(frame(spark, rows)).collect())
    assert stay.count("None") == 2 and stay.count("4") == 2 and "8" not in stay and "9" not in stay


def test_a_hot_group_of_near_copies_is_one_class(spark):
    rnd = random.Random(9)
    words = sentence(rnd, 60).split()
    rows = [(i, " ".join(edited(rnd, words, 1))) for i in range(400)] + [(1000 + i, sentence(rnd, 60)) for i in range(100)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows)).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(100))


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(400, 401), (401, 402), (402, 400), (500, 500)] + [(rnd.randint(600, 700), rnd.randint(600, 700)) for _ in range(70)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in groups.components(df).collect()}
    want = least({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert groups.components(df.limit(0)).count() == 0


def numbered(near) -> groups.Measure:
    """Texts that are numbers, alike if ``near`` has the pair."""
    prepare = lambda data, at: [np.array([int(data[i:j].tobytes())]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return groups.Measure(None, prepare, lambda x, y: float(frozenset((int(x[0]), int(y[0]))) in near), lambda larger, _: 0 * larger, 0.8)


def linked(spark, buckets: dict, near) -> tuple[list, dict]:
    keyed = spark.createDataFrame([(b, d) for b, docs in buckets.items() for d in docs], "bucket long, doc long").withColumn("text", F.col("doc"))
    ids = sorted({d for docs in buckets.values() for d in docs})
    docs = spark.createDataFrame([(d, 1, bytearray(groups.BINS)) for d in ids], "doc long, size long, sign binary")
    texts = spark.createDataFrame([(d, str(d)) for d in ids], "doc long, text string")
    links, labels = groups.link(groups.crowded(keyed, keyed.limit(0)), docs, texts, numbered({frozenset(p) for p in near}))
    return sorted(map(tuple, links.collect())), {r.node: r.label for r in labels.collect()}


@pytest.mark.parametrize(("block", "task"), [(7, 100), (20, 1), (256, 10**6)])
def test_buckets_of_unlike_documents_are_compared_in_full(spark, monkeypatch, block, task):
    """Of 60 documents in a bucket only 37 and 38 are near, and neither leads."""
    monkeypatch.setattr(groups, "BLOCK", block)
    monkeypatch.setattr(groups, "TASK", (task, task))
    assert linked(spark, {1: range(60)}, [(37, 38)]) == ([(37, 38, 1.0)], {38: 37})


def test_blocks_are_bounded_by_features_too(spark, monkeypatch):
    monkeypatch.setattr(groups, "FEATURES", 5)
    assert linked(spark, {1: range(30), 2: [3, 99]}, [(7, 20), (3, 99), (20, 21)])[1] == {20: 7, 21: 7, 99: 3}


def test_groups_of_several_meet_by_any_of_their_documents(spark):
    """Two groups whose leaders are unlike are joined by a link between other documents."""
    buckets = {1: [0, 1, 2, 3], 2: [10, 11, 12], 3: [0, 1, 2, 3, 10, 11, 12], 4: [3, 12, 20], 5: [20, 21], 6: [12, 3, 20]}
    links, labels = linked(spark, buckets, [(0, 1), (0, 2), (0, 3), (10, 11), (10, 12), (3, 12)])
    assert labels == {1: 0, 2: 0, 3: 0, 10: 0, 11: 0, 12: 0} and len(links) == 6


def test_signatures_never_rule_out_a_near_pair():
    rnd = random.Random(14)
    for measure, alike in ((neardup.measure(), lambda a, b: 1 - plain_distance(a, b) / max(len(a), len(b))), (fingerprints.measure(), lambda a, b: jaccard(" ".join(a), " ".join(b)))):
        ruled_out = 0
        for _ in range(300):
            a = sentence(rnd, rnd.randint(5, 120)).split()
            b = edited(rnd, a, rnd.randint(0, len(a))) or ["x"]
            data, at = fingerprints._texts([" ".join(a), " ".join(b)])
            size, sign, *_ = measure.describe(data, at)
            possible = groups._possible(size[:1], size[1:], groups._distance(sign[:1], sign[1:]), measure)[0]
            assert possible or alike(a, b) < 0.8
            ruled_out += not possible
        assert ruled_out > 30


def shingled(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a: str, b: str) -> float:
    x, y = shingled(a), shingled(b)
    return len(x & y) / len(x | y)


def test_near_pairs_equal_all_pairs(spark, family):
    links = [(i, j) for i, a in family for j, b in family if i < j and jaccard(a, b) >= 0.8]
    found, classes = fingerprints.near_pairs(frame(spark, family))
    texts = dict(family)
    for r in found.collect():
        assert r.likeness == pytest.approx(jaccard(texts[r.a], texts[r.b]))
    want = least([i for i, _ in family], links)
    got = {r.doc_id: r.class_id for r in classes.collect()}
    assert {i: got.get(i, i) for i in texts} == want


def test_fingerprint_classes_over_the_whole_table(spark):
    """All pairs that share a shingle, found by an inverted index."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sets, holders = {i: shingled(t) for i, t in docs.items()}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    want = least(docs, [(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    assert {r.doc_id: r.class_id for r in registry.QUERIES["fingerprint_classes"](spark, DATA).collect()} == want


def test_near_pairs_edges(spark):
    rows = edge_rows() + [(8, ""), (9, None), (4, "another text of the same id")]
    _, classes = fingerprints.near_pairs(frame(spark, rows))
    assert {r.doc_id: r.class_id for r in classes.collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1}
    links, classes = fingerprints.near_pairs(frame(spark, []))
    assert links.count() == 0 and classes.count() == 0


def test_fingerprint_query_over_the_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    rows = sorted(registry.QUERIES["op8_fingerprints"](spark, DATA).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [i for i, _ in docs]
    prints = {}
    for k, (r, (_, text)) in enumerate(zip(rows, docs, strict=True)):
        after = docs[(k + 1) % len(docs)][1]
        other = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(text, other)) < 0.2 and abs(r.near_next - jaccard(text, after)) < 0.2
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_next == 1) == (rows[(k + 1) % len(rows)].fingerprint == r.fingerprint)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edits_of_edge_rows(spark, parts):
    rows = edge_rows()
    got = fingerprints.edits(frame(spark, rows).repartition(3), parts).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].edited == "" and by[1].near_next == 1
    assert by[6].edited == edge_rows()[8][1][:7] + "x"
    assert fingerprints.edits(frame(spark, []), parts).collect() == []
    (alone,) = fingerprints.edits(frame(spark, [(3, "abc def")]), parts).collect()
    assert alone.edited == "abc abc" and alone.near_next == 1
    assert {r.fingerprint for r in fingerprints.fingerprint(frame(spark, rows)).collect()} == {r.fingerprint for r in got}
