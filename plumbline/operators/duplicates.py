"""The duplicate family: exact copies, line windows, report gates, overlap suppression, similar vectors and names."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import written
from . import graphs

#: Lines times copies, or copies alone, from which a clone is reported.
JOINT_LINES, COPIES = 20, 4


def chunks(rows: DataFrame, key: str) -> DataFrame:
    """Normalised texts of rows(key, text) that are long enough, with their content hash.

    Normalising adds or takes away no filled line and no token, so texts are chosen, and lines counted, before.
    """
    text = F.col("text")
    return rows.where(X.eligible(text)).select(key, X.normalized(text).alias("text"), X.filled_lines(text).alias("loc")).select(key, "text", F.sha2("text", 256).alias("hash"), "loc")


def hashes(rows: DataFrame, key: str) -> DataFrame:
    """key, hash and loc of chunks(), written once: texts are read and normalised a single time whatever joins them."""
    return written(chunks(rows, key).select(key, "hash", "loc"), "hashes")


def copies(rows: DataFrame, key: str) -> DataFrame:
    """Members of groups of equal chunks: key, representative (the smallest key) and members. The group is never gathered."""
    found = hashes(rows, key)
    groups = found.groupBy("hash").agg(F.min(key).alias("representative"), F.count("*").alias("members")).where("members > 1")
    return found.select(key, "hash").join(groups, "hash").select(key, "representative", "members")


def gate(groups: DataFrame) -> DataFrame:
    """reported for groups(min_loc, members)."""
    return groups.withColumn("reported", (F.col("members") >= 2) & ((F.col("min_loc") * F.col("members") >= JOINT_LINES) | (F.col("members") >= COPIES)))


def cache_split(wanted: DataFrame, cache: DataFrame, dims: int | None = None) -> DataFrame:
    """wanted(hash, ...) with hit: whether cache(hash[, vector]) holds it, a vector of another length being a miss."""
    good = cache if dims is None else cache.where(F.size("vector") == dims)
    return wanted.join(good.select("hash", F.lit(True).alias("hit")).dropDuplicates(["hash"]), "hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def line_windows(rows: DataFrame, key: str, size: int = 3) -> DataFrame:
    """Every run of `size` filled lines of a text: key, line (of filled ones, from 0) and the window's hash. Within a row, so nothing is shuffled."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: X.trimmed(x)), lambda x: x != "")
    many = rows.select(key, lines.alias("lines")).where(F.size("lines") >= size)
    at = many.select(key, "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - size)).alias("line"))
    return at.select(key, "line", F.sha2(F.array_join(F.slice("lines", F.col("line") + 1, size), "\n"), 256).alias("window"))


def window_clones(rows: DataFrame, key: str, size: int = 3, least: int = COPIES) -> DataFrame:
    """The windows that stand at `least` places or more, with their number."""
    found = line_windows(rows, key, size)
    often = found.groupBy("window").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return found.join(often, "window")


def without_overlaps(reports: DataFrame) -> DataFrame:
    """Of overlapping reports of one file the longest stays, arm F before W, then by place: greedy, so by file.

    reports: file, arm, start_line, start_col, end_line and any further columns.
    """

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        span = rows["start_line"] - rows["end_line"]
        order = rows.assign(_span=span, _arm=rows["arm"] != "F").sort_values(["_span", "_arm", "start_line", "start_col"], kind="stable")
        starts: list[int] = []  # of the spans taken, in order; they do not overlap
        ends: list[int] = []
        keep = []
        for i, a, b in zip(order.index, order["start_line"], order["end_line"], strict=True):
            at = bisect_right(starts, b)
            if not at or ends[at - 1] < a:
                starts.insert(at, a)
                ends.insert(at, b)
                keep.append(i)
        return rows.loc[sorted(keep)]

    return reports.groupBy("file").applyInPandas(greedy, reports.schema)


BLOCK = 2048


def similar_vectors(vectors: DataFrame, threshold: float, within: str | None = None) -> DataFrame:
    """(a, b, cosine) of every two of vectors(id, v), a < b, whose cosine reaches the threshold: exact, by blocks of rows.

    Vectors are packed into blocks of bytes; each two blocks meet once in one matrix product, and with `within` only blocks
    of equal values of that column. Null vectors take no part; the cosine with a zero vector is 0. Vectors of unlike
    lengths are compared over the shorter length.
    """
    sound = vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), (F.col(within).cast("string") if within else F.lit("")).alias("part"))
    cells = sound.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out(key):
            ids, sizes, flat = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            part, cell = key
            return pa.record_batch([pa.array([part], pa.string()), pa.array([cell], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, flat))], ["part", "cell", "ids", "sizes", "vs"])

        for batch in batches:
            ids, v = np.asarray(batch.column("id")), batch.column("v")
            sizes, flat = np.asarray(v.value_lengths()).astype(np.int64), np.asarray(v.flatten())
            first = np.cumsum(sizes) - sizes
            keys = list(zip(batch.column("part").to_pylist(), batch.column("cell").to_pylist(), strict=True))
            for key in dict.fromkeys(keys):
                own = np.array([k for k, x in enumerate(keys) if x == key])
                at = np.repeat(first[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
                held.setdefault(key, []).append((ids[own], sizes[own], flat[at]))
                if sum(len(x[0]) for x in held[key]) >= BLOCK:  # more rows of one cell are another block
                    yield out(key)
        for key in list(held):
            yield out(key)

    def unpacked(ids: bytes, sizes: bytes, flat: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = np.frombuffer(sizes, np.int64)
        x = np.zeros((len(many), width))
        x[np.arange(width)[None, :] < many[:, None]] = np.frombuffer(flat, np.float64)
        return np.frombuffer(ids, np.int64), many, x

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                width = max((int(np.frombuffer(row[c], np.int64).max()) for c in ("sizes", "sizes_o") if row[c]), default=0)
                one, la, a = unpacked(row["ids"], row["sizes"], row["vs"], width)
                other, lb, b = unpacked(row["ids_o"], row["sizes_o"], row["vs_o"], width)
                if (la == width).all() and (lb == width).all():
                    norm = np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))[None, :]
                else:  # norms over the shorter length of each two
                    ca, cb = np.c_[np.zeros(len(a)), np.cumsum(a**2, 1)], np.c_[np.zeros(len(b)), np.cumsum(b**2, 1)]
                    short = np.minimum(la[:, None], lb[None, :])
                    norm = np.sqrt(np.take_along_axis(ca, short, 1)) * np.sqrt(np.take_along_axis(cb, short.T, 1)).T
                cos = np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)
                i, j = np.nonzero(cos >= threshold)
                p, q = one[i], other[j]
                keep = p < q if row["block"] == row["block_o"] else p != q
                yield pa.record_batch([pa.array(np.minimum(p, q)[keep]), pa.array(np.maximum(p, q)[keep]), pa.array(cos[i, j][keep])], ["a", "b", "cosine"])

    rows = sound.join(cells, "part").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    blocks = written(rows.repartition("part", "cell").select("id", "v", "part", "cell").mapInArrow(pack, "part string, cell int, ids binary, sizes binary, vs binary").withColumn("block", F.xxhash64("ids", "vs")), "blocks")
    # A block is sent to those of its cell and of the cells before; of two in one cell the smaller hash goes to the larger, and each to itself.
    sent = blocks.select("part", F.explode(F.sequence(F.lit(0), "cell")).alias("to"), F.col("cell").alias("cell_o"), *[F.col(c).alias(f"{c}_o") for c in ("ids", "sizes", "vs", "block")])
    met = blocks.join(sent, (blocks["part"] == sent["part"]) & (blocks["cell"] == sent["to"])).where("cell < cell_o OR block <= block_o")
    return met.select("ids", "sizes", "vs", "block", "ids_o", "sizes_o", "vs_o", "block_o").mapInArrow(meet, "a long, b long, cosine double")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, primary) of everything in pairs(a, b): connected items, named by the smallest."""
    return graphs.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("primary"))


def similar_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of every two of rows(key, tokens), a < b, that reach the threshold.

    Exact: two sets that reach it share one of the rarest tokens of each, so only those are joined on.
    """
    sized = rows.select("key", F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0)
    one = sized.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rarity = one.groupBy("token").agg(F.count("*").alias("df"))
    ranked = one.join(rarity, "token").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("df", "token")))
    prefix = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("key", "n", "token")
    other = prefix.select(F.col("key").alias("b"), F.col("n").alias("m"), "token")
    near = prefix.withColumnRenamed("key", "a").join(other, "token").where((F.col("a") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9)).select("a", "b").distinct()
    both = near.join(sized.select(F.col("key").alias("a"), F.col("tokens").alias("s")), "a").join(sized.select(F.col("key").alias("b"), F.col("tokens").alias("t")), "b")
    share = F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))
    return both.select("a", "b", share.alias("jaccard")).where(F.col("jaccard") >= threshold)


def first_arm(hits: DataFrame, keys: list[str], rank: Column, order: list) -> DataFrame:
    """One hit for each of keys: that of the lowest rank, the first on a tie."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *order))
    return hits.withColumn("_k", k).where("_k = 1").drop("_k")

