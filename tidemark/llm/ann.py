"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways, shifted,
and put in the order of a Hilbert curve. Each order is cut into ranges at
quantiles of a bounded sample; a query looks in its own range and in those
beside it, a window to each side. What the orders' windows find is scored by
cosine on the original vectors and merged. A pair that the first order's
window has is not scored again in the others.

The window is a share of the order and not a number of rows, so that recall
doesn't fall as tables grow. Its width, and how many orders are used, come
from the sample: the least work that finds RECALL of the sample's own nearest
neighbours, which lie closer together in the whole table. Vectors without
structure have neighbours all over each order, and nearly all pairs are
scored; clustered ones need a small part of them.

Equal vectors are one class, searched once: it keeps its least ids, as many
as a result can name, so no group of copies meets in one place. Ties go to
the smaller id. Vectors that are null, zero, of another length than most, or
have null or non-finite components take no part, nor do rows with a null id.
Rows that repeat an id are candidates each, but never of that id. Without
enough candidates a query gets all that its windows have. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import written

#: Orders at most, dimensions that each projects to, and bits of each dimension.
CURVES, DIMENSIONS, BITS = 4, 4, 12
#: Share of the sample's nearest neighbours that windows have to find, and how many of how many vectors they are.
RECALL, NEAREST, ASKED = 0.95, 5, 256
#: Vectors that the projections' scales, the windows and the ranges' bounds are taken from, at most.
SAMPLE = 20_000
#: Classes of a range, about, while there are fewer ranges than MOST_RANGES of an order.
RANGE, MOST_RANGES = 2048, 1024
#: Queries that one task holds, about. Where there are more, they come in blocks.
BLOCK = 50_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells, a row each of ``bits``-bit coordinates.

    From the top bit down, coordinates are reflected and exchanged as the
    curve turns within each cube; what remains is a Gray code.
    """
    axes = [column.astype(np.uint64) for column in cells.T]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        top, below = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for k, axis in enumerate(axes):
            turned = (axis & top) != 0
            swap = np.where(turned, np.uint64(0), (axes[0] ^ axis) & below)
            axes[0] = np.where(turned, axes[0] ^ below, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    parity = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        parity ^= np.where((axes[-1] >> np.uint64(bit)) & one, (one << np.uint64(bit)) - one, np.uint64(0))
    place = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << one | ((axis ^ parity) >> np.uint64(bit) & one)
    return place


@dataclass
class Index:
    """Projections with shifts, and the bounds of each order's ranges."""

    dimension: int
    axes: np.ndarray  # curve, input dimension, projected dimension
    center: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    bounds: list[np.ndarray]
    curves: int  # orders that are used
    reach: int  # ranges that a query looks at to each side

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each order: where each vector lies in it."""
        out = []
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for k in range(self.curves):
            # three deviations to each side fill half of the grid; the shift says which half
            y = (unit @ self.axes[k] - self.center[k]) / self.scale[k]
            inside = np.clip(y / 12 + 0.25, 0, 0.5 - 1e-9) + self.shift[k]
            out.append(hilbert((inside * (1 << BITS)).astype(np.uint64), BITS))
        return np.array(out)

    @property
    def ranges(self) -> int:
        return len(self.bounds[0]) + 1

    def at(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each order: the range that each vector is in."""
        return np.array([np.searchsorted(b, p, "right") for b, p in zip(self.bounds, self.places(vectors), strict=False)])


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows, each times a power of two that makes its largest component about 1: cosines stay as they are, and no square overflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])


def fit(vectors: np.ndarray, ranges: int, seed: int = 11) -> Index:
    """An index from a sample of vectors."""
    rng = np.random.default_rng(seed)
    n, dimension = vectors.shape
    used = min(DIMENSIONS, dimension)
    axes = np.array([np.linalg.qr(rng.normal(size=(dimension, dimension)))[0][:, :used] for _ in range(CURVES)])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    y = np.einsum("nd,cdk->cnk", unit, axes)
    index = Index(dimension, axes, y.mean(1), y.std(1) + 1e-12, rng.uniform(0, 0.5, (CURVES, used)), [], CURVES, 0)
    places = index.places(vectors)
    index.bounds = [np.sort(p)[np.linspace(0, n, ranges + 1)[1:-1].astype(int)] for p in places]
    index.curves, index.reach = _window(unit, index.at(vectors), ranges)
    return index


def _window(unit: np.ndarray, at: np.ndarray, ranges: int) -> tuple[int, int]:
    """How many orders and how wide a window, in ranges, find RECALL of the nearest neighbours among the sample with the fewest pairs scored."""
    asked = min(ASKED, len(unit))
    near = unit[:asked] @ unit.T
    near[np.arange(asked), np.arange(asked)] = -2
    nearest = np.argsort(-near, axis=1)[:, : min(NEAREST, len(unit) - 1)]
    steps = np.abs(at[:, :asked, None] - at[:, None, :])
    best = (CURVES, ranges, np.inf)
    for curves in range(2, CURVES + 1):
        found = np.sort(np.take_along_axis(steps[:curves].min(0), nearest, 1).ravel())
        reach = int(found[int(np.ceil(RECALL * len(found))) - 1]) if len(found) else 0
        inside = steps[:curves] <= reach
        scored = inside[0].mean() + sum((i & ~inside[0]).mean() for i in inside[1:])
        if scored < best[2]:
            best = curves, reach, scored
    return best[:2]


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows ``(vec_id, v)`` with finite vectors of doubles that aren't zero."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _best(pool: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    """The first ``most`` entries of each query, by score, then by id."""
    query, score, least, _ = pool
    order = np.lexsort((least, -score, query))
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return tuple(x[order[rank < most]] for x in pool)


def search(vectors: DataFrame, is_query: Column, neighbours: int = 5, vector: str = "embedding") -> DataFrame:
    """The nearest rows of every row for which ``is_query`` (an expression on ``vec_id``) is true.

    Returns ``query_id, rank, vec_id, score``, rank from 1.
    """
    most = neighbours + 1  # a query may find itself
    rows = _usable(vectors, vector).withColumn("class", F.xxhash64("v"))
    lengths = {r.n: r.rows for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).collect()}
    dimension = min((n for n, r in lengths.items() if r == max(lengths.values())), default=1)
    rows = rows.filter(F.size("v") == dimension)
    by_id = Window.partitionBy("class").orderBy("vec_id")
    named = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= most)
    groups = named.groupBy("class").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min(F.when(F.col("place") == 1, F.col("v"))).alias("v"))  # ``most`` rows each at most
    queries = written(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "class"), "ann-queries")
    asked = queries.select("class").distinct().withColumn("asked", F.lit(True))
    classes = written(groups.join(asked, "class", "left").select("class", "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "ann-classes")
    total = classes.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    if not total.asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = classes.select("class", "v").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toArrow()
    index = fit(matrix(sample["v"].combine_chunks(), dimension), int(np.clip(total.n // RANGE, 1, MOST_RANGES)))
    ranges, reach = index.ranges, index.reach
    blocks = 1 + int(total.asked * min(1, (2 * reach + 1) / ranges)) // BLOCK  # of the queries that look into a range

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every class to its range in each order, and once more to each range that it asks."""
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                name, asks = part.column(0).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
                block = (name.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                places = index.at(matrix(part.column(2), dimension))
                for k, at in enumerate(places):
                    for b in range(blocks):  # every block of queries meets all rows
                        yield _sent(part, np.arange(len(at)), (k * ranges + at) * blocks + b, places[0], False)
                    for step in range(-min(reach, ranges - 1), min(reach, ranges - 1) + 1):
                        to = at + step
                        row = np.flatnonzero(asks & (to >= 0) & (to < ranges))
                        yield _sent(part, row, (k * ranges + to[row]) * blocks + block[row], places[0], True)

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a range: queries come first and stay, by their range in the first order; the rows stream past them."""
        held, names, firsts, unit = [], [], [], None
        pool = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        ids_of: dict[int, list[int]] = {}
        for batch in it:
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            n = int(asks.sum())
            if n:
                held.append(matrix(batch.column(3).slice(0, n), dimension))
                names.append(batch.column(1).slice(0, n).to_numpy())
                firsts.append(batch.column(5).slice(0, n).to_numpy())
            if n == batch.num_rows or not held:
                continue
            if unit is None:
                order = np.argsort(np.concatenate(firsts), kind="stable")
                q, name_of, first_of = (np.concatenate(x)[order] for x in (held, names, firsts))
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
            later = batch.column(0)[n].as_py() >= ranges * blocks  # not the first order
            for i in range(n, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = matrix(part.column(3), dimension)
                norm = np.linalg.norm(x, axis=1)
                first = part.column(5).to_numpy()
                for value in np.unique(first) if later else [0]:
                    mine = np.flatnonzero(first == value) if later else np.arange(len(x))
                    # what the first order's window has is left out
                    low, high = np.searchsorted(first_of, [value - reach, value + reach + 1]) if later else (len(q), len(q))
                    for start, end in ((0, low), (high, len(q))):
                        for a in range(start, end, 1024):
                            rough = unit[a : min(a + 1024, end)] @ (x[mine] / norm[mine, None]).T
                            kept = min(most, rough.shape[1])
                            floor = np.partition(rough, rough.shape[1] - kept, axis=1)[:, rough.shape[1] - kept]
                            qi, xi = np.nonzero(rough >= floor[:, None] - 1e-9)
                            qi, xi = a + qi, mine[xi]
                            ids = part.column(2).take(pa.array(xi)).to_pylist()
                            name = part.column(1).to_numpy()[xi]
                            exact = np.einsum("nd,nd->n", q[qi], x[xi]) / (np.linalg.norm(q[qi], axis=1) * norm[xi])
                            least = np.array([v[0] for v in ids], np.int64)
                            ids_of.update(zip(name.tolist(), ids, strict=True))
                            pool = tuple(np.concatenate(z) for z in zip(pool, (qi, exact, least, name), strict=True))
                pool = _best(pool, most)
                ids_of = {c: ids_of[c] for c in np.unique(pool[3]).tolist()}
        if len(pool[0]):
            who = name_of[pool[0]]
            yield pa.record_batch([pa.array(who), pa.array([ids_of[c] for c in pool[3].tolist()], pa.list_(pa.int64())), pa.array(np.clip(pool[1], -1, 1))], names=["class", "ids", "score"])

    sent = classes.select("class", "ids", "v", "asked").mapInArrow(spread, "part int, class long, ids array<long>, v array<double>, asks boolean, first int")
    dealt = sent.repartitionById(index.curves * ranges * blocks, "part").sortWithinPartitions("part", F.col("asks").desc())
    found = dealt.mapInArrow(nearest, "class long, ids array<long>, score double")
    each = found.select("class", F.explode("ids").alias("vec_id"), "score").groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("class").orderBy(F.col("score").desc(), "vec_id")
    top = each.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    answers = written(top.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "ann-answers")
    named_found = queries.join(answers, "class").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours).alias("found"))
    out = named_found.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _sent(part: pa.RecordBatch, row: np.ndarray, to: np.ndarray, first: np.ndarray, asks: bool) -> pa.RecordBatch:
    chosen = part.take(pa.array(row))
    return pa.record_batch([pa.array(to.astype(np.int32)), chosen.column(0), chosen.column(1), chosen.column(2), pa.array(np.full(len(row), asks)), pa.array(first[row].astype(np.int32))], names=["part", "class", "ids", "v", "asks", "first"])
