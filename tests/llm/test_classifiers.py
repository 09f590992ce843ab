import random

import numpy as np
import pyarrow as pa
import pytest
from common import DATA, edge_rows, frame

from tidemark.llm import quality, registry, toxicity
from tidemark.llm.arrow import folds, text_slices
from tidemark.llm.labelled import sample


@pytest.fixture(scope="module")
def bags():
    """Texts of plain sentences, some with one that has a bad word or a word of a bad stem."""
    rnd = random.Random(4)
    plain = ["river", "stone", "walks", "under", "green", "seven", "light", "paper"]
    texts, labels, bad = [], [], []
    for _ in range(600):
        sentences = [" ".join(rnd.choices(plain, k=6)) for _ in range(rnd.randint(1, 8))]
        toxic = rnd.random() < 0.3
        if toxic:
            k = rnd.randrange(len(sentences))
            word = rnd.choice(["vile", f"grubbish{rnd.choice('abcdefg')}{rnd.randint(0, 99)}"])
            sentences[k] += f" {word} stone"
            bad.append(sentences[k])
        else:
            bad.append(None)
        texts.append(". ".join(sentences) + ".")
        labels.append(int(toxic))
    return texts, labels, bad


def test_noisy_or_finds_the_documents_and_their_sentences(spark, bags):
    texts, labels, bad = bags
    model = toxicity.fit(pa.array(texts[:400]), labels[:400])
    found = {r.doc_id: r for r in toxicity.score(frame(spark, list(enumerate(texts[400:], 400))), model).collect()}
    wrong = [i for i in found if (found[i].score >= 0.5) != labels[i]]
    assert len(wrong) <= 4
    for i, r in found.items():
        if labels[i] and i not in wrong:
            assert [s.text for s in r.sentences] == [bad[i]]
            assert texts[i].encode()[r.sentences[0].start :].decode().startswith(bad[i])


def test_a_document_is_the_noisy_or_of_its_sentences(bags):
    model = toxicity.fit(pa.array(bags[0]), bags[1])
    for i, j, data, at in text_slices(pa.array(bags[0][:50])):
        s = toxicity.Sentences.of(data, at)
        whole, each = model.score(s, j - i)
        for d in range(j - i):
            assert whole[d] == pytest.approx(1 - np.prod(1 - each[s.text == d]), abs=1e-9)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, bags, module):
    model = module.fit(pa.array(bags[0]), bags[1])
    rows = edge_rows()
    got = module.score(frame(spark, rows), model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    if module is toxicity:
        assert all(r.score == 0 and r.sentences == [] for r in got if r.doc_id in (1, 2, 3))
    assert module.score(frame(spark, []), model).collect() == []
    kept = module.keep(frame(spark, rows), model)
    assert kept.columns == frame(spark, []).columns
    assert kept.count() <= len(rows)
    for texts, labels in (([], []), (["a"], [0]), (["a", "b"], [1, 1])):
        single = module.fit(pa.array(texts, pa.string()), labels)
        assert all(0 <= r.score <= 1 for r in module.score(frame(spark, rows), single).collect())


def test_quality_gradients_equal_differences():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "BB!", "c|", "dd", "12"], 150)) for _ in range(6)]
    parts = [(i, quality.Passages.of(d, a)) for i, _, d, a in text_slices(pa.array(texts))]
    x, text = parts[0][1].figures, parts[0][1].text
    y = np.array([1.0, 0, 1, 0, 0, 1])
    w = {"encode": rng.normal(size=(quality.FIGURES, 5)), "encode_bias": rng.normal(size=5), "view": rng.normal(size=(5, 3)), "gate": rng.normal(size=(5, 3)), "attend": rng.normal(size=3), "out": rng.normal(size=5), "out_bias": rng.normal(size=1)}

    def loss():
        p = quality._forward(w, x, text, 6)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in quality._gradients(w, x, text, y).items():
        flat, eps = w[name].ravel(), 1e-6
        for k in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[k]
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert g.ravel()[k] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_attention_weighs_passages(spark):
    good, bad = "the river runs under the green bridge and on. " * 40, "THE!! RIVER!! RUNS!! " * 60
    rnd = random.Random(2)
    texts = [" ".join(good[rnd.randint(0, 40) :].split()[: rnd.randint(20, 300)]) if k % 2 else " ".join((good + bad if k % 4 else bad).split()[: rnd.randint(380, 500)]) for k in range(300)]
    model = quality.fit(pa.array(texts), [k % 2 for k in range(300)])
    scores = quality.score(frame(spark, list(enumerate(texts))), model).collect()
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in scores) >= 290


def test_the_sample_is_bounded_and_never_held_out(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(60)] + [(7, "another"), (None, "t")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(8, 1, 1), (9, 1, None), (None, 1, 1), (1000, 1, 1)], "doc_id long, quality int, toxic int")
    texts, y, ids = sample(docs, labels, "toxic", 20)
    assert len(texts) == len(y) == len(set(ids)) <= 20
    assert (folds(ids, 5) != 0).all()
    again = sample(docs.repartition(7), labels.repartition(3), "toxic", 20)
    assert again[1:] == (y, ids) and again[0].equals(texts)
    _, y, ids = sample(docs, labels, "toxic", 1000)
    assert dict(zip(ids, y, strict=True)).get(8, 1) == 1


def test_the_sample_is_bounded_in_bytes_by_whole_texts(spark):
    texts = {i: "x" * (1 if i % 3 else 1000) + str(i) for i in range(60)} | {61: None, 62: ""}
    docs, labels = frame(spark, list(texts.items())), spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    whole, _, known = sample(docs, labels, "toxic", 1000)
    assert dict(zip(known, whole.to_pylist(), strict=True)) == {i: t or "" for i, t in texts.items() if i in known}
    for size in (0, 50, 2500, 1 << 20):
        got, y, ids = sample(docs, labels, "toxic", 1000, size)
        sizes = [len(t) for t in got.to_pylist()]
        assert sum(sizes) <= size and got.to_pylist() == [texts[i] or "" for i in ids] and y == [i % 2 for i in ids]
        left_out = [len(texts[i] or "") for i in known if i not in ids]
        assert all(n > size - sum(sizes) for n in left_out)
    assert sample(docs, labels, "toxic", 1000, 0)[2] == [i for i in known if not texts[i]]


def test_a_passage_alone_has_the_figures_it_has_in_its_text():
    """All but the text's own number of words; passages are of PASSAGE words."""
    rnd = random.Random(3)
    texts = ["  ".join(rnd.choice(["a", "BB!", "c|", "dd,", "12", "\u00e9\u00e9"]) for _ in range(n)) for n in (1, 63, 64, 65, 200, 700)]
    for text in texts:
        words = text.split()
        parts = ["  ".join(words[i : i + quality.PASSAGE]) + ("  " if i + quality.PASSAGE < len(words) else "") for i in range(0, len(words), quality.PASSAGE)]
        (whole,) = (quality.Passages.of(data, at) for *_, data, at in text_slices(pa.array([text])))
        (alone,) = (quality.Passages.of(data, at) for *_, data, at in text_slices(pa.array(parts)))
        assert len(whole.text) == len(parts) and np.allclose(whole.figures[:, :-1], alone.figures[:, :-1])


def test_a_score_is_that_of_the_passages_weighed_by_gated_attention(spark):
    folder = DATA
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    w = model.layers
    for r in registry.QUERIES["op4_quality"](spark, folder).collect():
        (p,) = (quality.Passages.of(data, at) for *_, data, at in text_slices(pa.array([texts[r.doc_id]]), 1 << 30))
        hidden, weights = [], []
        for figures in p.figures:
            h = np.tanh(((figures - w["mean"]) / w["scale"]) @ w["encode"] + w["encode_bias"])
            hidden.append(h)
            weights.append(np.exp((np.tanh(h @ w["view"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"]))
        z = sum(a * h for a, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"][0]))), abs=1e-6)
        assert r.passages == len(hidden) and r.predicted == (r.score >= 0.3)


@pytest.mark.parametrize(("name", "label", "area", "caught", "left_alone"), [("op1_toxicity", "toxic", 0.95, 0.85, 0.98), ("op4_quality", "quality", 0.98, 0.97, 0.95)])
def test_held_out_rows(spark, name, label, area, caught, left_alone):
    """By the order of the scores and by class: a model that always says the same fails."""
    folder = DATA.replace("sf0.001", "sf0.1")
    got = registry.QUERIES[name](spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, score, predicted = (np.array([r[c] for r in rows]) for c in (label, "score", "predicted"))
    assert (y == 1).sum() > 50 and (y == 0).sum() > 50
    above = (score[y == 1][:, None] > score[y == 0][None]) + 0.5 * (score[y == 1][:, None] == score[y == 0][None])
    assert above.mean() >= area
    assert predicted[y == 1].mean() >= caught and 1 - predicted[y == 0].mean() >= left_alone
