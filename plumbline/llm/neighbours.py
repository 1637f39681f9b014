"""Nearest neighbours by collision counting, for the largest inner product.

Largest inner product is made nearest distance by one more component: sqrt(M^2 - |x|^2) for a vector x, 0 for
a query, where M is the largest norm of all. The index of a block of vectors holds, for each of some
directions (random orthogonal frames, PROJECTIONS in all), the projections of its vectors in sorted order. A query opens in
each array a window centred at its own projection, found by binary search, and every vector in the window
collides once. Virtual rehashing widens all windows by powers of WIDEN until enough vectors have collided in
at least THRESHOLD of the projections, or all windows hold all; those are verified with exact inner products in
double precision, added component by component, so equal vectors have equal scores. Enough is the number asked
for, FEWEST and the share CANDIDATES of the block; no vector above the threshold is left out.

Candidate blocks and query blocks are packed rows of bounded size. Each query block meets every candidate
block (a stated query set against all rows, in blocks); what is shuffled behind that is k rows for each query
and candidate block.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components, and rows without a
vec_id, take no part. Norms are taken of scaled vectors, so components of any size neither overflow nor vanish;
a product that overflows is infinite, and one that is no number (infinities that cancel) is left out. Vectors of
each length are searched among their own. Rows that repeat a vec_id are all searched and all found, but a query
id lists each vec_id once, with its best score, and never its own. Ties go to the smaller vec_id. With fewer
candidates than asked for, all are returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOP = 20
#: Directions, out of orthogonal frames that have as many as a lifted vector has components. Counts are bytes.
PROJECTIONS = 192
#: Of the projections, how many a vector must collide in.
THRESHOLD = 0.6
#: Half width of the narrowest windows, in units of M, the growth from level to level, and the level of the first query.
FIRST, WIDEN, START = 0.3, 1.06, 20
#: Vectors of a block to verify, at least: a share and a number.
CANDIDATES, FEWEST = 0.06, 256
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 512
#: Candidates of one length are dealt over blocks of some LEAST_BLOCK, over BLOCKS at most while none is too large; while there are
#: fewer than TASKS blocks, the query blocks are shared out over several tasks a block. All follows from the row count alone.
LEAST_BLOCK, BLOCKS, TASKS = 8192, 12, 24


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)


def packed(rows: DataFrame, by: str, size: int, parts: int) -> DataFrame:
    """rows(by, vec_id, v) as packed blocks of at most size vectors: by, part, ids and vectors as bytes."""

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(k):
            ids, x = (np.concatenate(c) for c in zip(*held.pop(k), strict=True))
            for a in range(0, len(ids), size):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([ids[a : a + size].tobytes()], pa.binary()), pa.array([x[a : a + size].tobytes()], pa.binary())], [by, "ids", "vectors"])

        for batch in batches:
            key, ids = np.asarray(batch.column(by)), np.asarray(batch.column("vec_id"))
            x = np.asarray(batch.column("v").flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            for k in np.unique(key):
                held.setdefault(int(k), []).append((ids[key == k], x[key == k]))
                if sum(len(i) for i, _ in held[k]) >= size:
                    yield from block(int(k))
        for k in list(held):
            yield from block(k)

    return rows.repartition(parts, by).select(by, "vec_id", "v").mapInArrow(run, f"{by} int, ids binary, vectors binary")


def directions(dims: int, seed: int) -> np.ndarray:
    """(dims, PROJECTIONS): random orthogonal frames, scaled so that a unit vector's projections have a mean square of 1."""
    made = np.random.default_rng(seed).standard_normal((-(-PROJECTIONS // dims), dims, dims))
    return np.concatenate([np.linalg.qr(x)[0] * np.sqrt(dims) for x in made], 1)[:, :PROJECTIONS]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows, none zero, as unit vectors, whatever their size."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


class Index:
    """Sorted projections of a block of vectors, lifted to a common norm.

    x holds the vectors, log2_norm the binary logarithm of the largest norm of all blocks. Each sorted array is cut into
    256 steps of equally many vectors: a window is the steps that it meets, found by binary search among their edges,
    and each vector keeps its step, so that collisions are counted by comparing bytes.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, log2_norm: float, along: np.ndarray):
        self.ids, self.x, self.n, self.along = ids, x, len(x), along
        self.unique = len(np.unique(ids)) == len(ids)
        whole = int(np.floor(log2_norm))
        scaled, self.biggest = np.ldexp(x, -whole), 2.0 ** (log2_norm - whole)
        at = np.ascontiguousarray((np.c_[scaled, np.sqrt(np.maximum(self.biggest**2 - (scaled**2).sum(1), 0))] @ along).T)
        order, steps = np.argsort(at, axis=1, kind="stable"), min(256, self.n)
        self.edges = np.take_along_axis(at, order[:, np.arange(1, steps) * self.n // steps], 1)
        self.step = np.empty(at.shape, np.uint8)
        np.put_along_axis(self.step, order, (np.arange(self.n) * steps // self.n).astype(np.uint8)[None, :], 1)

    def windows(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and direction the first step that the window meets, and how many more it meets."""
        first, last = (np.array([np.searchsorted(row, c + by, "right") for row, c in zip(self.edges, centres.T, strict=True)], np.uint8).T for by in (-half, half))
        return np.ascontiguousarray(first)[:, :, None], np.ascontiguousarray(last - first)[:, :, None]

    def collide(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the vectors to verify: at least `wanted`, where there are so many.

        Windows start as wide as the query before needed them, are widened until enough vectors collide, and narrowed while far more do.
        """
        centres = unit(queries) @ self.along[:-1] * self.biggest
        least = int(np.ceil(THRESHOLD * self.along.shape[1]))
        wanted = min(self.n, max(wanted, FEWEST, int(CANDIDATES * self.n)))
        levels: dict[int, tuple] = {}
        level = START

        def colliding(q):
            if level not in levels:
                levels[level] = self.windows(centres, FIRST * self.biggest * WIDEN**level)
            first, more = levels[level]
            count = np.add.reduce(((self.step - first[q]) <= more[q]).view(np.uint8), axis=0, dtype=np.uint8)
            return np.flatnonzero(count >= least)

        for q in range(len(queries)):
            found = colliding(q)
            while len(found) < wanted:  # ends at last with windows that meet every step
                level += 1
                found = colliding(q)
            while level > 0 and len(found) > 1.5 * wanted:
                level -= 1
                fewer = colliding(q)
                if len(fewer) < wanted:
                    level += 1
                    break
                found = fewer
            yield found

    def nearest(self, me: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of its k best verified vectors, of other ids than its own."""
        for own, v, found in zip(me, queries, self.collide(queries, k + 1), strict=True):
            found = found[self.ids[found] != own]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.cumsum(self.x[found] * v, axis=1)[:, -1]  # unlike a product of matrices, adds in one order
                if self.unique and len(score) > 4 * k:
                    some = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = (found[some], score[some]) if some.sum() >= k else (found, score)  # else some are no numbers
            yield best(self.ids[found], score, k)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k largest scores, each id once, ties to smaller ids; what is no number is left out."""
    if np.isnan(score).any():
        ids, score = ids[~np.isnan(score)], score[~np.isnan(score)]
    order = np.lexsort((ids, -score))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order[first]], score[order[first]]


def _shapes(rows: DataFrame) -> list[tuple[int, int, float]]:
    """(components, vectors, binary logarithm of the largest norm) of each length."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            size, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten())
            first = np.cumsum(size) - size
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[first[own][:, None] + np.arange(d)]
                largest = np.abs(x).max(1)
                norm = np.log2(largest) + np.log2(((x / largest[:, None]) ** 2).sum(1)) / 2
                yield pa.record_batch([pa.array([d], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([norm.max()])], ["d", "n", "norm"])

    found = rows.select("v").mapInArrow(run, "d int, n long, norm double").groupBy("d").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"))
    return [(r["d"], r["n"], r["norm"]) for r in found.orderBy("d").collect()]


def search(queries: DataFrame, candidates: DataFrame, k: int = TOP, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest candidates of each query, of its own length; both are usable() frames."""
    shapes = _shapes(candidates)
    asked = {d: n for d, n, _ in _shapes(queries)}
    found = [_found(queries, candidates, d, n, asked[d], norm + 1e-9, k, seed) for d, n, norm in shapes if d in asked]
    if not found:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks(n: int) -> int:
    """How many blocks n candidates are dealt over, from n alone; none over CANDIDATE_BLOCK vectors but by chance of the hash (packed() cuts those)."""
    return max(1, -(-n // CANDIDATE_BLOCK), min(n // LEAST_BLOCK, BLOCKS))


def _found(queries: DataFrame, candidates: DataFrame, dims: int, n: int, n_queries: int, log2_norm: float, k: int, seed: int) -> DataFrame:
    """query_id, vec_id and score of the best that each candidate block holds for queries of one length among n candidates of that length."""
    cells = blocks(n)
    groups = max(1, -(-n_queries // QUERY_BLOCK))
    shares = min(groups, -(-TASKS // cells))
    # Equal rows are one, so none is a hot group.
    of = lambda rows, by, many: rows.where(F.size("v") == dims).dropDuplicates(["vec_id", "v"]).select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(many)).cast("int").alias(by), "vec_id", "v")
    left = packed(of(candidates, "cell", cells), "cell", CANDIDATE_BLOCK, min(cells, 4096)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    right = packed(of(queries, "group", groups), "group", QUERY_BLOCK, min(groups, 4096)).withColumn("share", F.col("group") % shares).withColumn("kind", F.lit(1))
    # A query block is sent to every candidate block; both are of bounded size.
    sent = right.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    columns = ["cell", "share", "kind", "ids", "vectors"]
    place = F.col("cell") * shares + F.col("share")
    met = left.select(*columns).unionByName(sent.select(*columns)).repartitionById(cells * shares, place.cast("int")).sortWithinPartitions("cell", "share", "kind")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        along = directions(dims + 1, seed)
        for batch in batches:
            for i in range(batch.num_rows):
                cell, share, kind, raw_ids, raw = (batch.column(c)[i].as_py() for c in columns)
                if (cell, share) != at:
                    at, held = (cell, share), []
                ids, x = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw, np.float64).reshape(-1, dims)
                if kind == 0:
                    held.append(Index(ids, x, log2_norm, along))
                    continue
                for index in held:
                    lists = list(index.nearest(ids, x, k))
                    yield pa.record_batch([pa.array(np.repeat(ids, [len(v) for v, _ in lists])), pa.array(np.concatenate([v for v, _ in lists])), pa.array(np.concatenate([s for _, s in lists]))], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = usable(C.table(spark, sf_dir, "embeddings"))
    return search(vectors.where("vec_id % 20 = 0"), vectors)
