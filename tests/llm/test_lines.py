import random

import duckdb
import pytest
from common import DATA, LONG, edge_rows, frame, sentence

from tidemark.llm import lines, registry
from pyspark.sql import functions as F


def near(a: list[str], b: list[str]) -> bool:
    """At most one word apart, by trying each."""
    if a == b:
        return True
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    if len(long) == len(short):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows: list[tuple[int, str]]) -> dict[int, str]:
    seen: list[list[str]] = []
    out = {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = line.split()
            gone = any(x == words or len(x) >= lines.MIN_WORDS <= len(words) and near(x, words) for x in seen) if words else False
            if words:
                seen.append(words)
            if not gone:
                kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def test_against_all_pairs(spark):
    rnd = random.Random(8)
    pool = [sentence(rnd, rnd.choice([1, 3, 4, 5, 6, 9, 12, 17])) for _ in range(12)]
    rows = []
    for doc_id in range(60):
        found = []
        for _ in range(rnd.randint(1, 5)):
            words = rnd.choice(pool).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(words) + 1)
                words = rnd.choice([words[:at] + ["zz"] + words[at:], words[:at] + words[at + 1 :], words[:at] + ["yy"] + words[at + 1 :]]) or ["q"]
            found.append(("  " if rnd.random() < 0.1 else " ").join(words))
        rows.append((doc_id, "\n".join(found)))
    got = lines.dedup(frame(spark, rows).repartition(5))
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_one_edit(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(400):
        a = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))] if rnd.random() < 0.4 else a[: rnd.randint(0, 7)] + [rnd.choice("abc")] + a[rnd.randint(0, 7) :]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", lines.one_edit(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == near(r.a, r.b), r


def test_edges(spark):
    rows = edge_rows()
    got = lines.dedup(frame(spark, rows))
    assert got.columns == [*frame(spark, []).columns, "n_lines", "n_dropped"]
    texts = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert texts == sorted((str(i), str(t)) for i, t in rows)
    assert lines.dedup(frame(spark, [])).count() == 0


def test_order_ties_and_long_lines(spark):
    long = LONG.strip()
    rows = [(None, "same line"), (1, "same line\nother\nsame line"), (1, "other\nsame line"), (2, "\n\nother\n"), (3, long + "\nx"), (4, long + " more\nx")]
    got = {}
    for r in lines.dedup(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[None] == ["same line"] and got[2] == ["\n\n"] and got[3] == [long + "\nx"] and got[4] == [""]
    assert sorted(t for t in got[1]) in (["", "other"], ["", "other\n"])


def test_a_hot_line_and_many_near_ones(spark):
    base = sentence(random.Random(1), 14).split()
    rows = [(i, f"{' '.join([*base[:5], f'w{i}', *base[5:]])}\nthe hot line") for i in range(500)]
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 500))


def test_lines_about_the_bounds_of_the_key_schemes(spark):
    """Lines of 4 to 6 words, and of LONG_WORDS and one less or more, whose keys are made in two ways, in each order."""
    rnd = random.Random(4)
    rows = []
    for n in (lines.MIN_WORDS, lines.LONG_WORDS):
        for first in (n - 1, n, n + 1):
            for then in (n - 1, n, n + 1):
                words = sentence(rnd, first).split()
                at = rnd.randrange(first)
                other = {0: [*words[:at], "zz", *words[at + 1 :]], 1: [*words[:at], "zz", *words[at:]], -1: words[:at] + words[at + 1 :]}.get(then - first) or words[: then - first]
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert got == brute(rows) and 9 < list(got.values()).count("") < 18


def test_whole_table_equals_the_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(lines.ORACLE_SQL)
    got = registry.QUERIES["op2_line_dedup"](spark, DATA)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_no_python_in_the_plan(spark):
    plan = lines.dedup(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("text", ["", "\n", "a\n\nb", "a\r\nb\r\n"])
def test_a_lone_text_keeps_its_form(spark, text):
    assert [r.text for r in lines.dedup(frame(spark, [(1, text)])).collect()] == [text]
