"""The sample database: all 31 statements, ingest, scripts, order and errors."""

import datetime as dt
import re
from pathlib import Path

import pytest

from tidemark import Engine
from tidemark.engine import run_batch
from tidemark.plans import parse_select, split_statements
from tidemark.sources import POSITION, read_schema, read_table, write_directory
from tidemark.streaming import stream_table

ROOT = Path(__file__).resolve().parents[1]

TABLES = {
    "Sailors": ("A B C", [(1, 200, 50), (2, 200, 200), (3, 100, 105), (4, 100, 50), (5, 100, 500), (6, 300, 400)]),
    "Boats": ("D E F", [(101, 2, 3), (102, 3, 4), (104, 104, 2), (103, 1, 1), (107, 2, 8)]),
    "Reserves": ("G H", [(1, 101), (1, 102), (1, 103), (2, 101), (3, 102), (4, 104)]),
    "Test": ("I J", [(1, 2), (1, 2), (2, 3), (3, 2)]),
}


def statements() -> list[tuple[int, str, list[tuple[int, ...]]]]:
    """Number, SQL and expected rows in order, from the table in FIXTURES.md."""
    found = []
    for line in (ROOT / "FIXTURES.md").read_text().splitlines():
        if m := re.match(r"\| (\d+) \| `(SELECT.*?)` \| \d+ \| (.*?) \| ", line):
            rows = m[3].partition("Correct: ")[2] or m[3]
            found.append((int(m[1]), m[2], [tuple(map(int, x.split(","))) for x in re.findall(r"\(([-\d,]+)\)", rows)]))
    assert [n for n, *_ in found] == list(range(1, 32))
    return found


def build(folder: Path, tables: dict = TABLES) -> str:
    (folder / "db/data").mkdir(parents=True)
    (folder / "db/schema.txt").write_text("\n".join(f"{name} {columns}" for name, (columns, _) in tables.items()))
    for name, (_, rows) in tables.items():
        text = rows if isinstance(rows, str) else "\n".join(",".join(map(str, r)) for r in rows)
        (folder / "db/data" / name).write_text(text)
    return str(folder / "db")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, build(tmp_path_factory.mktemp("sample")))


@pytest.mark.parametrize(("number", "sql", "expected"), statements(), ids=lambda x: x if isinstance(x, int) else "")
def test_statement_in_order_and_as_plain_sql(engine, number, sql, expected):
    if number == 28:
        expected = [(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5)]
    assert [tuple(r) for r in engine.sql(sql, preserve_order=True).collect()] == expected
    assert sorted(tuple(r) for r in engine.sql(sql).collect()) == sorted(expected)


def test_batch_writes_numbered_files_and_goes_on_after_errors(spark, tmp_path):
    build(tmp_path)
    (tmp_path / "queries.sql").write_text("""-- a comment; with a semicolon
SELECT * FROM Sailors; SELECT * FROM Nowhere;
SELECT ';' AS x, S.A FROM Sailors S WHERE S.A < 3; /* ; */ SELEC broken;
SELECT Sailors.Z FROM Sailors;
DROP VIEW Sailors;
SELECT DISTINCT R.G FROM Reserves R;
""")
    out = tmp_path / "out"
    out.mkdir()
    (out / "mine.txt").write_text("stays")
    done = run_batch(spark, str(tmp_path), str(out), preserve_order=False)
    assert [o.error is None for o in done] == [True, False, True, False, False, False, True]
    assert sorted(p.name for p in out.iterdir()) == ["mine.txt", "query1", "query3", "query7"]
    assert sorted((out / "query1").read_text().splitlines())[0] == "1,200,50"
    assert sorted((out / "query3").read_text().splitlines()) == [";,1", ";,2"]


def test_statements_are_split_outside_quotes_and_comments():
    assert split_statements("a 'x;''y' b; -- c;\n d \"e;\" ;; /* f; */ (g;h)") == ["a 'x;''y' b", "d \"e;\"", "(g;h)"]


@pytest.mark.parametrize(("text", "rows"), [("3 4\n5\t\t6\n7,8 \n+3,-4\n9 , \n".replace("9 , \n", ""), [(3, 4), (5, 6), (7, 8), (3, -4)]), ("", []), ("2147483647,-2147483648", [(2147483647, -2147483648)])])
def test_lines_that_are_read(spark, tmp_path, text, rows):
    (tmp_path / "T").write_text(text)
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "T"), ["a", "b"]).collect()] == rows


@pytest.mark.parametrize("line", ["1, 2", " 1,2", "", "   ", "x,1", "1", "1,2,3", "1,2147483648", "1.5,2"])
def test_lines_that_fail_the_query_and_leave_no_file(spark, tmp_path, line):
    (tmp_path / "db/data").mkdir(parents=True)
    (tmp_path / "db/schema.txt").write_text("T a b\n\n")
    (tmp_path / "db/data/T").write_text(f"1,2\n{line}\n3,4\n")
    done = Engine(spark, str(tmp_path / "db")).run_script("SELECT T.a FROM T; SELECT T.b FROM T WHERE T.a = 1", str(tmp_path / "out"))
    assert all(o.error for o in done)
    assert not list((tmp_path / "out").iterdir())


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path|exist"):
        Engine(spark, str(tmp_path))
    (tmp_path / "schema.txt").write_text("T a\nT b")
    with pytest.raises(ValueError, match="repeated"):
        read_schema(spark, str(tmp_path / "schema.txt"))


@pytest.mark.parametrize("preserve_order", [False, True])
def test_a_missing_data_file_fails_only_the_statements_that_name_it(spark, tmp_path, preserve_order):
    build(tmp_path, {"Here": ("a", [(1,)]), "Gone": ("a", [(2,)])})
    (tmp_path / "db/data/Gone").unlink()
    (tmp_path / "queries.sql").write_text("SELECT Here.a FROM Here; SELECT Gone.a FROM Gone; SELECT Here.a FROM Here, Gone; SELECT Here.a FROM Here WHERE Here.a = 1")
    done = run_batch(spark, str(tmp_path), str(tmp_path / "out"), preserve_order)
    assert [o.rows for o in done] == [1, None, None, 1]
    assert all("Gone" in str(o.error) and "PATH_NOT_FOUND" in str(o.error) for o in done[1:3])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["query1", "query4"]


def test_a_select_may_stand_behind_comments(engine):
    assert engine.sql("-- first\n/* then */ SELECT S.A FROM Sailors S WHERE S.A = 1 -- last").count() == 1
    with pytest.raises(ValueError, match="only SELECT"):
        engine.sql("/* SELECT */ DROP VIEW Sailors")


@pytest.mark.parametrize("line", ["1", "1,2,3", "x,1", ""])
def test_a_bad_line_fails_a_stream(spark, tmp_path, line):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part1").write_text(f"5,6\n{line}\n")
    q = stream_table(spark, str(tmp_path / "in"), ["a", "b"]).writeStream.format("memory").queryName("bad_arrivals").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="expected 2 integers"):
        q.awaitTermination(60)


def test_opening_another_folder_replaces_the_tables(spark, tmp_path):
    e = Engine(spark, build(tmp_path / "one", {"OneOnly": ("a", [(1,)])}))
    e.open(build(tmp_path / "two", {"TwoOnly": ("a", "")}))
    assert e.sql("SELECT * FROM TwoOnly").count() == 0
    with pytest.raises(Exception, match="OneOnly"):
        e.sql("SELECT * FROM OneOnly")


@pytest.fixture(scope="module")
def more(spark, tmp_path_factory):
    tables = {"U": ("I J", [(1, 2), (3, 2), (1, 2)]), "V": ("K L", [(1, 5), (2, 9), (3, 7), (-4, 9)]), "W": ("M", "")}
    return Engine(spark, build(tmp_path_factory.mktemp("more"), tables))


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT DISTINCT * FROM U ORDER BY J", [(1, 2), (3, 2)]),
        ("SELECT DISTINCT * FROM U u1, U u2 WHERE u1.I = u2.I", [(1, 2, 1, 2), (3, 2, 3, 2)]),
        ("SELECT V.K FROM V ORDER BY V.L DESC", [(2,), (-4,), (3,), (1,)]),
        ("SELECT * FROM V, W WHERE V.K = W.M", []),
        ("SELECT * FROM W, V", []),
        ("SELECT V.K AS k, u.* FROM V, U AS u WHERE V.K = u.I AND (V.L > 100 OR V.L < 6)", [(1, 1, 2), (1, 1, 2)]),
    ],
)
def test_order_option(more, sql, rows):
    assert [tuple(r) for r in more.sql(sql, preserve_order=True).collect()] == rows
    assert sorted(tuple(r) for r in more.sql(sql).collect()) == sorted(rows)


@pytest.mark.parametrize("sql", ["SELECT V.K FROM V JOIN U ON V.K = U.I", "SELECT count(*) FROM V GROUP BY V.K", "SELECT DISTINCT V.K FROM V ORDER BY V.L", "SELECT V.K FROM V LIMIT 1", "UPDATE V"])
def test_order_option_refuses_what_it_cannot_order(more, sql):
    with pytest.raises(ValueError):  # noqa: PT011
        more.sql(sql, preserve_order=True)


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT V.K FROM V JOIN U ON V.K = U.I", [(1,), (1,), (3,)]),
        ("SELECT K FROM V WHERE NOT K IN (1, 2)", [(-4,), (3,)]),
        ("SELECT K FROM V WHERE K BETWEEN 2 AND 3 OR K < 0", [(-4,), (2,), (3,)]),
        ("SELECT K FROM V WHERE K < 1.5 AND K > -5", [(-4,), (1,)]),
        ("SELECT L, count(*) AS n FROM V GROUP BY L HAVING count(*) > 1", [(9, 2)]),
        ("SELECT K FROM V ORDER BY K LIMIT 1", [(-4,)]),
    ],
)
def test_sql_beyond_the_basic_form_runs_as_sql(more, sql, rows):
    assert sorted(tuple(r) for r in more.sql(sql).collect()) == rows


def test_positions_follow_the_file_when_it_is_split(spark, tmp_path):
    (tmp_path / "T").write_text("\n".join(str(i) for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_table(spark, str(tmp_path / "T"), ["a"], position=True)
        assert df.rdd.getNumPartitions() > 4
        assert [r.a for r in df.orderBy(POSITION).collect()] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_directory_sink_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part1").write_text("1,2\n3 4\n")
    write_directory(read_table(spark, str(tmp_path / "in/part1"), ["a", "b"]), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1,2", "3,4"]
    stream = stream_table(spark, str(tmp_path / "in"), ["a", "b"]).filter("a > 1")
    q = stream.writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("arrivals").collect()] == [(3, 4)]


def test_select_is_taken_apart():
    s = parse_select("select distinct S.A, R.* from Sailors S, Reserves AS R where S.A = ',from' order by S.A desc, R.G;")
    assert (s.items, s.tables, s.where, s.order, s.distinct) == (["S.A", "R.*"], [("Sailors", "S"), ("Reserves", "R")], "S.A = ',from'", ["S.A desc", "R.G"], True)


def test_nulls_and_repeated_names_in_the_sink(spark, tmp_path):
    from tidemark.sources import write_single_file

    df = spark.createDataFrame([(1, None, dt.date(2020, 1, 1))], "a int, b int, c date")
    assert write_single_file(df.select("a", "b", "c", "a"), str(tmp_path / "f")) == 1
    assert (tmp_path / "f").read_text() == "1,,2020-01-01,1\n"
