"""Groups of near documents, from keys that near texts are likely to share.

A bucket of n documents is never expanded into its pairs. Buckets of the same
documents count once. First a bucket's documents are compared with one leader;
the links make groups. Then buckets that still hold several groups are laid
out in cells of two blocks of documents each: within a cell, pairs of
different groups are compared, if sizes and signatures leave them a chance
and no earlier bucket has both, until their groups are joined. So copies cost
one comparison each, a row goes to as many cells as its bucket has blocks,
and no link that would join two groups is lost.

Sizes and signatures only rule out pairs that can't be near. A signature
counts a text's features by a part of their hash: the difference of two is at
most that of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import released, slices, strings, text_slices
from tidemark.llm.storage import written

#: Documents of a block, about, and features of them: a cell has two blocks, however large its bucket is.
BLOCK, FEATURES = 1024, 1 << 20
#: Documents and features that a task works on at a time, about.
TASK = 8 * BLOCK, 4 * FEATURES
#: Counters of a signature.
BINS = 128

LINK = "a long, b long, low long, high long, likeness double"


@dataclass(frozen=True)
class Measure:
    """How alike texts are.

    ``describe`` makes of the texts of a buffer their sizes in features, their
    signatures, and their keys with offsets: each text's keys are distinct.
    ``prepare`` makes what ``like`` compares; ``like`` may give any smaller
    number if texts are less alike than ``least``. Near texts' sizes have at
    least that ratio, and their signatures differ by at most ``most`` of the
    larger and the smaller size.
    """

    describe: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    prepare: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
    like: Callable[[np.ndarray, np.ndarray], float]
    most: Callable[[np.ndarray, np.ndarray], np.ndarray]
    least: float


def signatures(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BINS counts, at most 255, for each text's hashed features."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * BINS + (features >> np.uint64(57)).astype(np.int64), minlength=n * BINS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, BINS)


def _blobs(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * BINS
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unblob(column: pa.Array) -> np.ndarray:
    data, at = strings(column)
    return data[at[0] : at[-1]].reshape(-1, BINS)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of edges ``(a, b)``: the label is the least node that is connected.

    Large and small stars in turn: each node's larger neighbours, then its
    smaller ones and itself, are linked to the least neighbour. A node of
    many edges only passes on partial minima; the join that follows has both
    sides read from tables, so that its large partitions can be split.
    """
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def star(both: DataFrame, condition: str) -> DataFrame:
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        return both.join(least, "u").filter(condition)

    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = star(written(large.distinct(), "edges"), "true").select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
        edges = written(small.filter("a != b").distinct(), "edges")
        # done when every node has one label, and no label has one itself
        marks = edges.select(F.col("a").alias("node"), F.lit(1).alias("low")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("low")))
        state = marks.groupBy("node").agg(F.min("low").alias("low"), F.sum("low").alias("labels"))
        if not state.filter("labels > 1 or (labels = 1 and low = 0)").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def crowded(keyed: DataFrame, copies: DataFrame) -> DataFrame:
    """``(bucket, doc, leader)`` of the documents ``(bucket, doc, text)`` but copies, in buckets with several texts; of buckets with the same documents, one.

    The leader is the least document, so that a group of copies has one
    leader wherever it meets. Documents of a bucket are known by their number
    and two hashes. Copies are left out of crowded buckets only, where few
    rows are left, and not of all documents with their keys.
    """
    several = written(keyed.groupBy("bucket").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least != most").select("bucket"), "buckets")
    members = written(keyed.join(several, "bucket").select("bucket", "doc").distinct().join(copies.select("doc"), "doc", "left_anti"), "members")
    seen = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc").alias("leader"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "doc")).alias("y"))
    kept = written(seen.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("leader").alias("leader")).select("bucket", "leader"), "distinct-buckets")
    return written(members.join(kept, "bucket").select("bucket", "doc", "leader"), "distinct-members")


def _prepared(column: pa.Array, measure: Measure) -> list[np.ndarray]:
    data, at = strings(column)
    return [x for i, j in slices(at) for x in measure.prepare(data[at[i] : at[j]], at[i : j + 1] - at[i])]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.maximum(x, y) - np.minimum(x, y)).sum(-1, dtype=np.int64)


def _possible(size_x: np.ndarray, size_y: np.ndarray, distance: np.ndarray, measure: Measure) -> np.ndarray:
    larger, smaller = np.maximum(size_x, size_y), np.minimum(size_x, size_y)
    return (smaller >= measure.least * larger - 1e-9) & (distance <= measure.most(larger, smaller))


def _with_leaders(members: DataFrame, docs: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Links ``(a, b, likeness)`` between each bucket's leader and its other documents."""

    def likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, signs = ([batch.column(c) for c in cs] for cs in ((2, 4), (3, 5)))
            near = pa.array(_possible(*(c.to_numpy() for c in sizes), _distance(*(_unblob(c) for c in signs)), measure))
            yield pa.record_batch([batch.column(c).filter(near) for c in (0, 1)], names=["doc", "leader"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = strings(batch.column(2))[1] + strings(batch.column(3))[1]
            for i, j in slices(at):
                part = batch.slice(i, j - i)
                sides = (_prepared(part.column(c), measure) for c in (2, 3))
                found = np.array([measure.like(x, y) for x, y in zip(*sides, strict=True)])
                near = pa.array(found >= measure.least)
                # the leader is the lesser one
                yield pa.record_batch([part.column(1).filter(near), part.column(0).filter(near), pa.array(found[found >= measure.least], pa.float64())], names=["a", "b", "likeness"])

    pairs = members.filter("doc != leader").select("doc", "leader").distinct()
    sides = pairs.join(docs.toDF("doc", "size", "sign"), "doc").join(docs.toDF("leader", "leader_size", "leader_sign"), "leader")
    found = written(sides.select("doc", "leader", "size", "sign", "leader_size", "leader_sign").mapInArrow(released(likely), "doc long, leader long"), "likely")
    both = found.join(texts.toDF("doc", "text"), "doc").join(texts.toDF("leader", "leader_text"), "leader")
    return both.select("doc", "leader", "text", "leader_text").mapInArrow(released(verify), "a long, b long, likeness double")


@dataclass
class _Cell:
    """The documents of a cell, and its pairs that have to be compared."""

    doc: np.ndarray
    label: np.ndarray
    block: np.ndarray
    size: np.ndarray
    sign: np.ndarray
    buckets: list[list[int]]

    def pairs(self, bucket: int, two: bool, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different labels, and of different blocks if the cell has two, that may be near and have met in no lesser bucket; the most alike come first."""
        order = np.argsort(self.size, kind="stable")
        size, sign, label, block = self.size[order], self.sign[order], self.label[order], self.block[order]
        end = np.searchsorted(size, size / measure.least + 1e-9, "right")
        left, right, far = [], [], []
        step = 64
        for i in range(0, len(order), step):
            j, most = min(i + step, len(order)), int(end[min(i + step, len(order)) - 1])
            rows, partners = np.arange(i, j)[:, None], np.arange(i, most)[None]
            open_ = (partners > rows) & (partners < end[i:j, None]) & (label[i:j, None] != label[None, i:most])
            if two:
                open_ &= block[i:j, None] != block[None, i:most]
            if open_.any():
                distance = _distance(sign[i:j, None], sign[None, i:most])
                x, y = np.nonzero(open_ & _possible(size[i:j, None], size[None, i:most], distance, measure))
                left.append(order[x + i])
                right.append(order[y + i])
                far.append(distance[x, y] / np.maximum(size[y + i], 1))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = np.concatenate(left), np.concatenate(right)
        known = {int(k): {b for b in self.buckets[k] if b < bucket} for k in np.unique(np.concatenate([x, y]))}
        own = np.array([known[p].isdisjoint(known[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
        order = np.argsort(np.concatenate(far)[own], kind="stable")
        return x[own][order], y[own][order]


def _cells(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray, _Cell]]:
    """Each cell of a task's rows: its bucket, its blocks, its rows and what they hold."""
    bucket, i, j = (table.column(c).to_numpy() for c in ("bucket", "i", "j"))
    order = np.lexsort((j, i, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    doc, label, block, size = (table.column(c).to_numpy() for c in ("doc", "label", "block", "size"))
    sign, lists = _unblob(table.column("sign")), table.column("buckets").combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for rows in np.split(order, np.flatnonzero(new)[1:]):
        r = rows[0]
        yield bucket[r], i[r], j[r], rows, _Cell(doc[rows], label[rows], block[rows], size[rows], sign[rows], [values[at[k] : at[k + 1]].tolist() for k in rows])


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _between(members: DataFrame, labels: DataFrame, docs: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Links ``(a, b, low, high, likeness)`` between documents a and b of the groups low and high, enough to join all groups that a link joins."""
    label = F.coalesce("label", "doc").alias("label")
    labelled = written(members.select("bucket", "doc").join(labels.toDF("doc", "label"), "doc", "left").join(docs.select("doc", "size"), "doc").select("bucket", "doc", label, "size"), "labelled")
    seen = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("features"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("features") / FEATURES, F.lit(1))).cast("int").alias("blocks")
    mixed = written(seen.select("bucket", blocks), "mixed-buckets")
    rest = written(labelled.join(mixed, "bucket"), "mixed-members")
    # a document has at most as many buckets as keys
    own = rest.groupBy("doc", "label", "size").agg(F.collect_list("bucket").alias("buckets"))
    known = written(own.join(docs.select("doc", "sign"), "doc"), "mixed-documents")

    total = rest.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("blocks") * F.col("size")), F.lit(0)).alias("features")).first()
    tasks = 1 + max(total.rows // TASK[0], total.features // TASK[1])
    dealt: Column = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(tasks))
    block = F.pmod(F.xxhash64("doc", "bucket"), F.col("blocks")).cast("int")
    placed = rest.select("bucket", "doc", "blocks", block.alias("block"))
    cells = placed.select("doc", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("doc", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def wanted(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for bucket, i, j, rows, cell in _cells(table):
            found.append(rows[np.unique(np.concatenate(cell.pairs(bucket, i != j, measure)))])
        return table.take(np.concatenate(found)).select(["doc", "bucket", "block", "i", "j"])

    def compare(table: pa.Table) -> pa.Table:
        links: list[tuple[int, int, int, int, float]] = []
        prepared = _prepared(table.column("text").combine_chunks(), measure)
        for bucket, i, j, rows, cell in _cells(table):
            parent: dict[int, int] = {}
            for x, y in zip(*(p.tolist() for p in cell.pairs(bucket, i != j, measure)), strict=True):
                p, q = _top(parent, int(cell.label[x])), _top(parent, int(cell.label[y]))
                if p != q and (like := measure.like(prepared[rows[x]], prepared[rows[y]])) >= measure.least:
                    parent[max(p, q)] = min(p, q)
                    ends, groups = sorted((int(cell.doc[x]), int(cell.doc[y]))), sorted((int(cell.label[x]), int(cell.label[y])))
                    links.append((*ends, *groups, like))
        columns = list(zip(*links, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.float64() if n == "likeness" else pa.int64()) for n, c in zip(("a", "b", "low", "high", "likeness"), columns, strict=True)})

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("task", dealt).groupBy("task")

    met = written(gathered(cells.join(known, "doc")).applyInArrow(wanted, "doc long, bucket long, block int, i int, j int"), "met")
    return gathered(met.join(known, "doc").join(texts.toDF("doc", "text"), "doc")).applyInArrow(compare, LINK)


def link(members: DataFrame, docs: DataFrame, texts: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, likeness)``, a < b, that join documents into groups, and ``(node, label)`` of the groups' documents but the least, which is the label.

    ``members`` has ``(bucket, doc, leader)`` of crowded buckets; ``docs``
    each of their documents' ``doc, size, sign`` and ``texts`` its id and text.
    """
    first = written(_with_leaders(members, docs, texts, measure), "leader-links")
    labels = written(components(first), "labels")
    second = written(_between(members, labels, docs, texts, measure), "cell-links")
    merged = written(components(second.select(F.col("low").alias("a"), F.col("high").alias("b"))).toDF("label", "merged"), "merged-labels")
    nodes = labels.union(merged.select(F.col("label").alias("node"), "label"))
    return first.union(second.select("a", "b", "likeness")), nodes.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))


def near_classes(documents: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, likeness)`` between representatives of equal texts, and ``(doc_id, class_id)`` of documents in a group.

    ``class_id`` is the least id of the group. Links are those that joined two
    groups: pairs already in one aren't compared. Documents without a copy or
    a near one are in neither table, nor are rows with a null id. Rows of one
    id are one document, whose text is the one that hashes least.
    """

    def described(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in text_slices(batch.column(1), 1 << 18):
                size, sign, keys, to = measure.describe(data, at)
                lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in (0, 2, 3)), pa.array(size, pa.int64()), _blobs(sign), lists], names=["doc", "k1", "k2", "size", "sign", "keys"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.length(text), text).alias("k2")).filter("doc is not null")
    every = written(rows.mapInArrow(released(described), "doc long, k1 long, k2 long, size long, sign binary, keys array<long>"), "described")
    unlike = written(every.groupBy("doc").agg(F.min("k1").alias("own"), F.max("k1").alias("k")).filter("own != k").select("doc", "own"), "several-texts")

    def one(of: DataFrame) -> DataFrame:
        """Without the other texts of documents that have several."""
        return of.join(unlike, "doc", "left").filter("own is null or own = k1").drop("own")

    equal = one(every.select("doc", "k1", "k2")).groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    copied = written(equal.filter("first != last").select("k1", "k2", "first"), "copied-texts")
    same = written(one(every.select("doc", "k1", "k2")).join(copied, ["k1", "k2"]).filter("doc != first").select("doc", "first").distinct(), "copies")
    members = crowded(written(one(every).select("doc", F.col("k1").alias("text"), F.explode("keys").alias("bucket")), "keys"), same)

    # what meets grows with the documents: never broadcast, whatever the size
    involved = written(members.select("doc").distinct(), "involved").hint("merge")
    docs = written(one(every.select("doc", "k1", "size", "sign")).join(involved, "doc").select("doc", "size", "sign").dropDuplicates(["doc"]), "compared-documents")
    texts = written(one(rows.select("doc", "text", "k1")).join(involved, "doc").select("doc", "text").dropDuplicates(["doc"]), "compared-texts")
    links, labels = link(members, docs, texts, measure)
    labels = written(labels, "classes")
    copies = same.join(labels.toDF("first", "label"), "first", "left").select("doc", F.coalesce("label", "first").alias("label"))
    whole = labels.union(copies).toDF("doc_id", "class_id")
    return links, whole.union(whole.select(F.col("class_id").alias("doc_id"), "class_id").distinct())
