"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each half of the unit vector quantised by its
own codebook, so K centroids a side make K*K cells; vectors of very different
lengths lie in up to seven bands of length with cells of their own, as a long
vector has a large inner product with many queries.

A query first estimates, from the number of vectors in each cell and the spread
of each centroid's residuals, the score that only ``top`` vectors reach.  A heap
then yields the pairs of centroids in the order of their summed nearness (in a
band less what the band needs to reach that score) without forming all sums, and
the query takes cells until they should hold the share ``target`` of those
vectors.  So it visits little where vectors have clusters or lengths differ, and
more where they have neither.  The vectors in its cells are reranked by their
exact inner product in double precision.

Codebooks, residual spreads and bands are fitted on a sample of about ``sample``
vectors; every vector is indexed.  What the driver and the tasks hold besides is
one count per cell, at most seven times ``MOST_CENTROIDS`` squared.  Equal
vectors are one entry with the smallest top + 1 of their ids, which is all a
query can need of them; equal queries are answered once.  Entries lie in blocks
of bounded size, a full cell in several, and meet the queries in chunks of
bounded size.

Rows with a null id, and vectors that are null, zero, of another length than
most, or hold null or non-finite components take no part.  Rows that repeat an
id and a vector count once; an id with different vectors is found by each, and as
a query answered for each.  Ties go to the smaller id.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import written

LEAST_CENTROIDS, MOST_CENTROIDS, PER_CELL = 96, 256, 16
BAND_CUTS = (0.5, 0.75, 0.9, 0.96, 0.985, 0.995)
BLOCK_BYTES, CHUNK, AT_ONCE, KEPT_QUERIES = 1 << 21, 1024, 64, 20_000
#: Vectors that a query visits at least, as a multiple of those it asks for.
FLOOR = 16
#: Halvings that find the score which only the asked number of vectors reach.
ROUNDS = 12
PLACED = "first long, own long, vector binary, cell int"
_GRID = np.linspace(-9, 9, 4001)
_LOG_TAIL = np.log([0.5 * math.erfc(x / math.sqrt(2)) for x in _GRID])


class Index(NamedTuple):
    """Codebooks and residual variances (per component) of both halves, lengths of the bands, and their upper ends."""

    books: tuple[np.ndarray, np.ndarray]
    spreads: tuple[np.ndarray, np.ndarray]
    lengths: np.ndarray
    ends: np.ndarray


class Layout(NamedTuple):
    """Vectors in each cell, blocks of each cell and the first of them, and the cells that each block begins and ends with."""

    counts: np.ndarray
    parts: np.ndarray
    first_block: np.ndarray
    ranges: np.ndarray


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns vec_id and vector (doubles) of the rows that take part."""
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").head()
    return rows.where(F.size(v) == (size["size"] if size else 0))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    return np.argmin((centroids * centroids).sum(axis=1) - 2 * points @ centroids.T, axis=1)


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's method, from evenly spread different points."""
    points = np.unique(points, axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; components of any size are scaled first."""
    most = np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)
    scaled = vectors / np.where(most > 0, most, 1)
    size = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(size > 0, size, 1)[:, None], size * most[:, 0]


def fitted(vectors: np.ndarray, k: int) -> Index:
    """Codebooks, residual spreads and bands of length of a sample."""
    unit, length = units(vectors)
    half = max(1, vectors.shape[1] // 2)
    books, spreads = [], []
    for part in (unit[:, :half], unit[:, half:]):
        book = codebook(part, k)
        own = nearest(part, book)
        rest = ((part - book[own]) ** 2).sum(axis=1)
        counts = np.bincount(own, minlength=len(book))
        mean = rest.mean() if len(rest) else 0.0
        spreads.append((np.bincount(own, rest, len(book)) + mean) / (counts + 1) / max(1, part.shape[1]))
        books.append(book)
    ends = np.unique(np.quantile(length, BAND_CUTS)) if length.max() > 1.01 * length.min() else np.zeros(0)
    band = np.searchsorted(ends, length, "right")
    lengths = np.array([length[band == i].mean() if (band == i).any() else (ends[i] if i < len(ends) else ends[-1]) for i in range(len(ends) + 1)])
    return Index(tuple(books), tuple(spreads), lengths, ends)


def cells_of(index: Index, vectors: np.ndarray) -> np.ndarray:
    """The cell of each vector: its band, then the centroids of its halves."""
    unit, length = units(vectors)
    one, two = index.books
    half = one.shape[1]
    band = np.searchsorted(index.ends, length, "right")
    return (band * len(one) + nearest(unit[:, :half], one)) * len(two) + nearest(unit[:, half:], two)


def laid_out(counts: np.ndarray, block: int) -> Layout:
    """Neighbouring cells share blocks of at most about ``block`` vectors; a cell with more has several of its own."""
    parts = np.maximum(1, -(-counts // block))
    alone = parts > 1
    begun = np.concatenate(([0], np.cumsum(np.where(alone, 0, counts))))[:-1] // block
    shared = int(begun.max()) + 1 if len(begun) else 0
    first = np.where(alone, 0, begun)
    first[alone] = shared + np.concatenate(([0], np.cumsum(parts[alone])))[:-1]
    ranges = np.zeros((shared + int(parts[alone].sum()), 2), np.int64)
    places = np.arange(shared)
    ranges[:shared, 0], ranges[:shared, 1] = np.searchsorted(begun, places), np.searchsorted(begun, places, "right")
    for cell in np.flatnonzero(alone):
        ranges[first[cell] : first[cell] + parts[cell]] = cell, cell + 1
    return Layout(counts, parts, first, ranges)


def pairs_in_order(one: np.ndarray, two: np.ndarray, needs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(band, a, b) by descending sum of the nearness of a and b less the need of the band."""
    first, second = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    one, two = one[first].tolist(), two[second].tolist()
    first, second = first.tolist(), second.tolist()
    heap = [(need - one[0] - two[0], band, 0, 0) for band, need in enumerate(needs.tolist())]
    heapq.heapify(heap)
    last_one, last_two = len(one) - 1, len(two) - 1
    while heap:
        _, band, i, j = heap[0]
        yield band, first[i], second[j]
        need = float(needs[band])
        if j < last_two:
            heapq.heapreplace(heap, (need - one[i] - two[j + 1], band, i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i < last_one:
            heapq.heappush(heap, (need - one[i + 1] - two[0], band, i + 1, 0))


class Router:
    """The cells that a query visits."""

    def __init__(self, index: Index, layout: Layout, top: int, target: float) -> None:
        self.index, self.layout, self.top, self.target = index, layout, top, target
        one, two = index.books
        self.live = np.flatnonzero(layout.counts)
        self.n, self.sizes = layout.counts[self.live].astype(float), layout.counts.tolist()
        self.a, self.b = self.live // len(two) % len(one), self.live % len(two)
        self.one_spread, self.two_spread = index.spreads[0][self.a], index.spreads[1][self.b]
        self.per_length = 1 / index.lengths[self.live // (len(one) * len(two))]

    def visited(self, query: np.ndarray) -> np.ndarray:
        """Cells, in ascending order, that should hold ``target`` of the query's ``top`` nearest."""
        index = self.index
        one, two = index.books
        half = one.shape[1]
        unit = units(query[None, :])[0][0]
        near_one, near_two = one @ unit[:half], two @ unit[half:]
        spread = np.sqrt((unit[:half] @ unit[:half]) * self.one_spread + (unit[half:] @ unit[half:]) * self.two_spread) + 1e-12
        begin, slope = -(near_one[self.a] + near_two[self.b]) / spread, self.per_length / spread

        def expected(score: float, n: np.ndarray, begin: np.ndarray, slope: np.ndarray) -> np.ndarray:
            return n * np.exp(np.interp(score * slope + begin, _GRID, _LOG_TAIL))

        high = 1.5 * float(index.lengths.max())
        low, own = -high, (self.n, begin, slope)
        for _ in range(ROUNDS):
            middle = (low + high) / 2
            hits = expected(middle, *own)
            if hits.sum() > self.top + 1:
                low, keep = middle, hits > 1e-6
                own = tuple(x[keep] for x in own)
            else:
                high = middle
        table = np.zeros(len(self.sizes))
        table[self.live] = expected(low, self.n, begin, slope)
        wanted, floor = self.target * float(table.sum()), FLOOR * (self.top + 1)
        table, sizes, taken, met, seen = table.tolist(), self.sizes, [], 0.0, 0
        width, depth = len(two), len(one)
        for band, a, b in pairs_in_order(near_one, near_two, low / index.lengths):
            cell = (band * depth + a) * width + b
            if sizes[cell]:
                taken.append(cell)
                met += table[cell]
                seen += sizes[cell]
                if met >= wanted and seen >= floor:
                    break
        return np.sort(np.array(taken, np.int64))

    def blocks(self, cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Blocks that hold some of the cells, with a bit for each cell of the block's range."""
        layout = self.layout
        wanted = np.zeros(len(layout.counts), bool)
        wanted[cells] = True
        for block in np.unique(layout.first_block[cells[layout.parts[cells] == 1]]).tolist():
            yield block, np.packbits(wanted[slice(*layout.ranges[block])]).tobytes()
        for cell in cells[layout.parts[cells] > 1].tolist():
            for block in range(layout.first_block[cell], layout.first_block[cell] + layout.parts[cell]):
                yield int(block), b"\x80"


def packed(vectors: np.ndarray) -> pa.Array:
    """Each vector as the bytes of its doubles."""
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors, "<f8")], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    """Those bytes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(scores: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest scores with their names (smallest id, hash), descending, ties to the smaller id."""
    if len(scores) > n:
        bound = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = scores >= bound
        scores, names = scores[keep], names[keep]
    order = np.lexsort((names[:, 0], -scores))[:n]
    return scores[order], names[order]


class Reranked:
    """The best entries of each query over a task's blocks."""

    def __init__(self, n: int) -> None:
        self.n, self.best = n, {}

    def add(self, keys: list, queries: np.ndarray, bits: list[bytes], vectors: np.ndarray, names: np.ndarray, places: np.ndarray) -> None:
        """Score a chunk of queries against a block, whose entries lie at ``places`` in its range of cells."""
        for a in range(0, len(keys), AT_ONCE):
            some = range(a, min(a + AT_ONCE, len(keys)))
            scores = queries[a : a + AT_ONCE] @ vectors.T
            for i in some:
                open_ = np.unpackbits(np.frombuffer(bits[i], np.uint8))[places].view(bool)
                own, own_names = best_of(scores[i - a][open_], names[open_], self.n)
                old = self.best.get(keys[i])
                if old is not None:
                    own, own_names = best_of(np.concatenate((old[0], own)), np.concatenate((old[1], own_names)), self.n)
                self.best[keys[i]] = own, own_names

    def flush(self) -> pa.RecordBatch:
        """All of it as rows, and begin anew."""
        sizes = [len(s) for s, _ in self.best.values()]
        keys = np.repeat(np.array(list(self.best), np.int64), sizes)
        scores, names = (np.concatenate([v[k] for v in self.best.values()] or [empty]) for k, empty in enumerate((np.zeros(0), np.zeros((0, 2), np.int64))))
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(-scores), pa.array(names[:, 0], pa.int64()), pa.array(names[:, 1], pa.int64())], ["key", "far", "first", "own"])
        self.best = {}
        return out


def searched(vectors: DataFrame, is_query: Column, top: int = 20, sample: int = 16384, target: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", visits: bool = False) -> DataFrame:
    """The ``top`` nearest of each query among all other ids: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id.  With ``visits`` the result is instead
    the number of vectors that each different query visits: key, visited, indexed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= top + 1)
    entries = written(kept.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("vector", "ids", F.col("ids")[0].alias("first"), F.xxhash64("vector").alias("own")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "key long, visited long, indexed long" if visits else "query_id long, rank int, vec_id long, score double")
    chance = F.pmod(F.xxhash64("first", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
    points = matrix(entries.where(chance | (F.col("first") == entries.agg(F.min("first")).head()[0])).select("vector").toArrow().column(0).combine_chunks())
    index = fitted(points, min(MOST_CENTROIDS, max(LEAST_CENTROIDS, math.ceil(math.sqrt(n / PER_CELL)))))
    fit = spark.sparkContext.broadcast(index)
    block_size = max(64, BLOCK_BYTES // (8 * points.shape[1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(2))
            cell = cells_of(fit.value, own) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(own), pa.array(cell.astype(np.int32))], ["first", "own", "vector", "cell"])

    placed = written(entries.select("first", "own", "vector").mapInArrow(place, PLACED), "placed")
    counts = np.zeros(len(index.lengths) * len(index.books[0]) * len(index.books[1]), np.int64)
    for cell, count in placed.groupBy("cell").count().collect():
        counts[cell] = count
    layout = spark.sparkContext.broadcast(laid_out(counts, block_size))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(fit.value, layout.value, top, target)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                own, out, of = matrix(some.column(1)), [], []
                for i in range(len(own)):
                    found = list(router.blocks(router.visited(own[i])))
                    out += found
                    of += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), some.column(0).take(pa.array(of, pa.int64())), packed(own).take(pa.array(of, pa.int64())), pa.array([x[1] for x in out], pa.binary())], ["block", "key", "vector", "cells"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(fit.value, layout.value, top, target)
        for batch in batches:
            seen = [int(router.layout.counts[router.visited(v)].sum()) for v in matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen, pa.int64()), pa.array([n] * len(seen), pa.int64())], ["key", "visited", "indexed"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = layout.value
        for batch in batches:
            salt, cell = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(1), batch.column(3).to_numpy()
            block = own.first_block[cell] + (salt % own.parts[cell].astype(np.uint64)).astype(np.int64)
            place = cell - own.ranges[block, 0] if len(block) else block
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *batch.columns[:3], pa.array(place.astype(np.int32))], ["block", "first", "own", "vector", "place"])

    queries = rows.where(is_query).select("vec_id", F.xxhash64("vector").alias("key"), "vector")
    different = written(queries.groupBy("key").agg(F.first("vector").alias("vector")), "queries")
    asked_n = different.count()
    spread_out = different.select("key", "vector").repartition(max(1, min(math.ceil(asked_n / 64), 8 * spark.sparkContext.defaultParallelism)))
    if visits:
        return spread_out.mapInArrow(counted, "key long, visited long, indexed long")
    chunks = max(1, math.ceil(asked_n / CHUNK))
    routed = spread_out.mapInArrow(route, "block int, key long, vector binary, cells binary")
    asked = routed.withColumn("chunk", F.pmod("key", F.lit(chunks))).groupBy("block", "chunk").agg(F.collect_list(F.struct("key", "vector", "cells")).alias("queries"))
    stored = placed.mapInArrow(blocked, "block int, first long, own long, vector binary, place int").groupBy("block").agg(F.collect_list(F.struct("first", "own", "vector", "place")).alias("entries"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Reranked(top + 1)
        for batch in batches:
            for r in range(batch.num_rows):
                q, e = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                best.add(q.field("key").to_pylist(), unpacked(q.field("vector")), q.field("cells").to_pylist(), unpacked(e.field("vector")), np.column_stack([e.field(c).to_numpy() for c in ("first", "own")]), e.field("place").to_numpy())
                if len(best.best) >= KEPT_QUERIES:
                    yield best.flush()
        yield best.flush()

    met = asked.join(stored, "block").select("queries", "entries").mapInArrow(rerank, "key long, far double, first long, own long")
    nearest_first = lambda name: F.row_number().over(Window.partitionBy("key").orderBy("far", name)) <= top + 1
    firsts = met.withColumn("in", nearest_first("first")).where("in").select("key", "far", "first", "own")
    pairs = firsts.join(entries.select("first", "own", "ids"), ["first", "own"]).select("key", "far", F.explode("ids").alias("vec_id"))
    best = pairs.withColumn("in", nearest_first("vec_id")).where("in")
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("far", "vec_id"))).alias("best"))
    answered = queries.select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    others = F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, top)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
