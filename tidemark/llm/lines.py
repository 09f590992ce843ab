"""Line dedup by a join of deletion neighbourhoods, in DataFrame operations only.

A line goes if an earlier one, by doc_id and then by place, has the same
words or, for lines of at least MIN_WORDS words, differs from it by one word
added, dropped or replaced: the earliest stays. Words stand between blanks.

Two lines are that near exactly if, cut at one place, both leave the same
words before and behind when at most one word at the cut is left out of each.
So every line emits a hashed key for each cut and each word left out; equal
keys are joined to their earliest line, and the edit distance is verified.
Only lines that share a half with another line emit keys: of two lines one
edit apart, the first or the last half is the same.

Blank lines always stay. A null text is an empty one. Rows with one doc_id
are ordered by a hash of their texts, null ids come first. Rows that repeat
an id and its text are one document and get the same result. A text whose
lines all go becomes empty. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import settled, written

#: Lines of fewer words only go if an earlier one is the same: with one word changed they are less than 0.8 alike.
MIN_WORDS = 5

#: Lines of so many words or more get their keys from running hashes, whose cost grows more slowly with the length; shorter ones from parts of the line.
LONG_WORDS = 1024

#: Fixed: characters between words.
BLANKS = " \t\r\f\x0b"

_LEAST = -(1 << 63)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal(line: Column) -> Column:
    """The line's words between single spaces. Most lines are so already."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in BLANKS[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(line, f"[{BLANKS}]+", " "))).otherwise(line)


def _count(line: Column) -> Column:
    """Words of a normal line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _lines(text: Column) -> Column:
    """Places, normal lines and numbers of words, made before they are exploded: columns of expressions would be computed wherever they are used."""
    return F.transform(F.split(text, "\n", -1), lambda raw, i: _bound(_normal(raw), lambda line: F.struct(i.alias("pos"), line.alias("line"), _count(line).alias("n"))))


def _part(line: Column, words: Column) -> Column:
    """The first words of a normal line, or for a negative number the last."""
    return F.call_function("substring_index", line, F.lit(" "), words)


def _rows(documents: DataFrame) -> DataFrame:
    """What a row is known by: ``id`` and ``hash`` stand for the doc_id and the text."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text, F.length(text)).alias("hash"), text.alias("text"))


def _halves(line: Column, n: Column) -> dict[str, Column]:
    """Keys of the first and the last words, at both lengths that a line one edit apart can have as its half."""
    keys = {}
    for name, half, wanted in (("a", F.floor(n / 2), n >= MIN_WORDS), ("b", F.floor((n - 1) / 2), (n >= MIN_WORDS) & (n % 2 == 0))):
        half = half.cast("int")
        keys[f"first_{name}"] = F.when(wanted, F.xxhash64(F.lit("first"), half, _part(line, half)))
        keys[f"last_{name}"] = F.when(wanted, F.xxhash64(F.lit("last"), half, _part(line, -half)))
    return keys


def _chain(words: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... words, in runs of about the root of their number, so that only short arrays are extended."""
    follow = lambda h, w: F.xxhash64(w, h)
    extend = lambda hashes, w: F.concat(hashes, F.array(F.xxhash64(w, F.element_at(hashes, -1))))
    start = F.array(F.lit(7).cast("bigint"))

    def cut(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), lambda k: F.slice(words, k * size + 1, size))

    def hashes(runs: Column) -> Column:
        starts = F.aggregate(runs, start, lambda done, run: F.concat(done, F.array(F.aggregate(run, F.element_at(done, -1), follow))))
        within = lambda at: F.zip_with(F.slice(at, F.lit(1), F.size(runs)), runs, lambda h, run: F.slice(F.aggregate(run, F.array(h), extend), F.lit(1), F.size(run)))
        return _bound(starts, lambda at: F.concat(F.flatten(within(at)), F.array(F.element_at(at, -1))))

    return _bound(_bound(F.ceil(F.sqrt(F.size(words))).cast("int"), cut), hashes)


def _long_keys(line: Column) -> Column:
    def paired(words: Column) -> Column:
        n = F.size(words)

        def keys(both: Column) -> Column:
            before, behind = both["before"], F.reverse(both["behind"])
            whole = F.zip_with(F.sequence(F.lit(0), n), F.arrays_zip(before.alias("a"), behind.alias("b")), lambda i, h: F.xxhash64(i, h["a"], h["b"]))
            shifted = F.arrays_zip(F.slice(before, F.lit(1), n).alias("a"), F.slice(behind, F.lit(2), n).alias("b"))
            return F.concat(whole, F.zip_with(F.sequence(F.lit(0), n - 1), shifted, lambda i, h: F.xxhash64(i, h["a"], h["b"])))

        return _bound(F.struct(_chain(words).alias("before"), _chain(F.reverse(words)).alias("behind")), keys)

    return _bound(F.split(line, " "), paired)


def _keys(line: Column, n: Column, first: Column, last: Column) -> Column:
    """A key for each cut, of the words before it and behind it: with no word left out, and with one.

    A line whose first half is shared is cut in the last one, and the other
    way round: there the edit is.
    """
    low = F.when(last, 0).otherwise(F.floor((n - 1) / 2)).cast("int")
    high = F.when(first, n).otherwise(F.floor((n + 1) / 2)).cast("int")
    whole = F.transform(F.sequence(low, high), lambda i: F.xxhash64(i, _part(line, i), _part(line, i - n)))
    without = F.transform(F.sequence(low, F.least(high, n - 1)), lambda i: F.xxhash64(i, _part(line, i), _part(line, i - n + 1)))
    none = F.array().cast("array<bigint>")
    # lines of exactly that length have keys of both kinds, to meet lines of one word less or more
    short = F.when(n <= LONG_WORDS, F.concat(whole, without)).otherwise(none)
    return F.concat(short, F.when(n >= LONG_WORDS, _long_keys(line)).otherwise(none))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word apart: alike up to a place, and behind it with one word of the longer left out."""

    def compared(x: Column) -> Column:
        long, short = x["long"], x["short"]
        same = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda p, q: p == q)
        unlike = F.array_position(same, F.lit(False)).cast("int")

        def rest(at: Column) -> Column:
            beyond = F.when(F.size(long) == F.size(short), 1).otherwise(0)
            return F.slice(long, at + 1, F.size(long)) == F.slice(short, at + beyond, F.size(long))

        return (F.size(long) - F.size(short) <= 1) & _bound(F.when(unlike == 0, F.size(short) + 1).otherwise(unlike), rest)

    ordered = F.when(F.size(a) >= F.size(b), F.struct(a.alias("long"), b.alias("short"))).otherwise(F.struct(b.alias("long"), a.alias("short")))
    return _bound(ordered, compared)


def duplicates(documents: DataFrame) -> DataFrame:
    """Lines that go: ``id``, ``hash`` and the places ``gone`` in the text, from 0."""
    rows = _rows(documents)
    counted = rows.select("id", "hash", F.inline(_lines(F.col("text")))).filter("n > 0")
    halves = _halves(F.col("line"), F.col("n"))
    # one pass over the texts: from here on a line is a few numbers
    lines = written(counted.select("id", "hash", "pos", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), *(c.alias(name) for name, c in halves.items())), "lines")
    earliest = F.min(F.struct("id", "hash", "pos")).alias("line")
    distinct = written(lines.groupBy("k1", "k2").agg(earliest, F.count("*").alias("times"), *(F.min(h).alias(h) for h in halves)), "distinct-lines")

    repeated = distinct.filter("times > 1").select("k1", "k2", F.col("line").alias("kept"))
    copies = lines.select("id", "hash", "pos", "k1", "k2").join(repeated, ["k1", "k2"]).filter(F.struct("id", "hash", "pos") > F.col("kept")).select("id", "hash", "pos")

    sides = F.array(*(F.struct(F.col(h).alias("half"), F.lit(h.startswith("first")).alias("first")) for h in halves))
    half = distinct.select("line", F.inline(sides)).filter("half is not null")
    shared = written(half.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1").select("half"), "shared-halves")
    likely = half.join(shared, "half").groupBy("line").agg(F.max("first").alias("first"), F.max(~F.col("first")).alias("last"))
    wanted = likely.groupBy("line.id", "line.hash").agg(F.collect_list(F.struct("line.pos", "first", "last")).alias("places"))  # of one text
    found = rows.join(wanted, ["id", "hash"]).dropDuplicates(["id", "hash"])
    each = found.select("id", "hash", F.map_from_entries(F.transform("places", lambda p: F.struct(p["pos"], F.struct(p["first"], p["last"])))).alias("sides"), F.inline(_lines(F.col("text"))))
    picked = each.withColumn("side", F.try_element_at("sides", "pos")).filter("side is not null")
    candidates = written(picked.select(F.struct("id", "hash", "pos").alias("line"), F.col("line").alias("words"), "n", F.col("side.first"), F.col("side.last")), "near-lines")

    # written, as it takes longer to make the keys than to read them twice
    keyed = written(candidates.select("line", F.explode(_keys(F.col("words"), F.col("n"), F.col("first"), F.col("last"))).alias("key")), "variants")
    several = written(keyed.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key"), "equal-variants")
    met = written(keyed.join(several, "key"), "met-lines")
    kept = written(met.groupBy("key").agg(F.min("line").alias("kept")), "kept-lines")
    pairs = met.join(kept, "key").filter(F.col("line") > F.col("kept")).groupBy("line").agg(F.min("kept").alias("kept"))
    texts = candidates.select("line", "words")
    both = pairs.join(texts, "line").join(texts.toDF("kept", "kept_words"), "kept")
    near = both.filter(one_edit(F.split("words", " "), F.split("kept_words", " "))).select("line.*")

    return copies.union(near).groupBy("id", "hash").agg(F.collect_set("pos").alias("gone"))


def dedup(documents: DataFrame) -> DataFrame:
    """The documents with only the lines that stay, and ``n_lines`` and ``n_dropped`` behind their columns.

    Input columns of those names, or named ``gone``, ``id`` or ``hash``, don't
    clash: they are renamed on the way, or replaced by the result's.
    """
    names = documents.columns
    inner = documents.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    full = F.coalesce(text, F.lit(""))
    keyed = inner.withColumns({"id": F.coalesce(doc_id.cast("long"), F.lit(_LEAST)), "hash": F.xxhash64(full, F.length(full))})
    gone = settled(documents.sparkSession, "gone-lines", lambda: duplicates(documents))
    joined = keyed.join(gone, ["id", "hash"], "left")
    lines = F.split(full, "\n", -1)
    stay = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    new = {"text": F.when(F.col("gone").isNull(), text).otherwise(stay)}
    kept = [(new.get(c, F.col(f"c{i}"))).alias(c) for i, c in enumerate(names) if c not in ("n_lines", "n_dropped")]
    dropped = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select(*kept, F.size(lines).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(dropped).alias("n_dropped"))


#: DuckDB SQL of the same lines' fates, by strings instead of hashes.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), split AS (
  SELECT doc_id, pos, line, [x for x in string_split_regex(line, '[ \t\r\f\x0B]+') if x <> ''] AS words FROM lines
), first_lines AS (
  SELECT words, min({'d': doc_id, 'p': pos}) AS place FROM split WHERE len(words) > 0 GROUP BY words
), cuts AS (
  SELECT words, place, unnest(generate_series(0, len(words))) AS i FROM first_lines WHERE len(words) >= 5
), keys AS (
  SELECT place, i || '|' || array_to_string(words[1:i], ' ') || '|' || array_to_string(words[i + 1:], ' ') AS key FROM cuts
  UNION ALL
  SELECT place, i || '|' || array_to_string(words[1:i], ' ') || '|' || array_to_string(words[i + 2:], ' ') AS key FROM cuts WHERE i < len(words)
), met AS (
  SELECT key, min(place) AS kept FROM keys GROUP BY key HAVING count(*) > 1
), near AS (
  SELECT DISTINCT place FROM keys JOIN met USING (key) WHERE place > kept
), fate AS (
  SELECT s.doc_id, s.pos, s.line, len(s.words) > 0 AND (f.place <> {'d': s.doc_id, 'p': s.pos} OR n.place IS NOT NULL) AS gone
  FROM split s LEFT JOIN first_lines f ON s.words = f.words LEFT JOIN near n ON n.place = {'d': s.doc_id, 'p': s.pos}
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone))::INTEGER AS n_dropped
FROM fate GROUP BY doc_id
"""
