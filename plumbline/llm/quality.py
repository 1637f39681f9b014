"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Each document becomes FEATURES numbers, computed from the whole text with vectorised passes over its bytes
and words. Trees are grown on the driver from histograms of at most BINS quantile bins with the logistic
loss, on at most SAMPLE labelled documents (a bound of the training alone, chosen by a hash of doc_id). The
trees are flattened into arrays of features, thresholds and children, and walked for a block of documents and
all trees at once, DEPTH steps down.

Edge cases: null and empty texts have all-zero statistics and get a score like any other. A document with
several labels counts with the largest; of rows that repeat a doc_id one is learned from. With no usable label, or labels of one kind only, the score is their
mean (0.5 without any). Rows that repeat a doc_id, or have none, are scored one by one. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 20
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "non_ascii",
    "log_words", "word_mean", "word_std", "word_max", "short_words", "capital_words", "shout_words", "odd_ends", "letterless",
    "distinct_words", "top_word", "distinct_pairs", "log_lines", "line_mean", "distinct_lines", "stops_per_word",
)


def classes() -> np.ndarray:
    """A class from 0 to 8 for each byte: upper, lower, digit, space, newline, sentence stop, other mark, other symbol, non-ASCII."""
    out = np.full(256, 7, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n", b".?!", b",;:'\"-()")):
        out[list(chars)] = k
    out[128:] = 8
    return out


def _distinct(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many distinct hashes, and how often the most frequent one stands."""
    if not len(hashes):
        return np.zeros(n_rows), np.zeros(n_rows)
    key = np.sort((hashes & C.U64((1 << 44) - 1)) | (row.astype(C.U64) << C.U64(44)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    own = (key[first] >> C.U64(44)).astype(np.int64)
    most = np.zeros(n_rows)
    np.maximum.at(most, own, count)
    return np.bincount(own, minlength=n_rows).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) of a block."""
    n, kind = len(offsets) - 1, classes()
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * 9 + kind[data], minlength=n * 9).reshape(n, 9)
    share = counts / np.maximum(size, 1)[:, None]
    starts, ends, before = C.word_bounds(data, offsets, C.byte_class("space"))
    own, words = C.row_of(before), np.diff(before).astype(float)
    many = np.maximum(words, 1)
    by_row = lambda x: np.bincount(own, weights=x, minlength=n)
    length = (ends - starts).astype(float)
    mean = by_row(length) / many
    std = np.sqrt(np.maximum(by_row(length**2) / many - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    head, tail = kind[data[starts]], kind[data[ends - 1]]
    lows, letters = (np.r_[0, np.cumsum(np.isin(kind, k)[data])] for k in ([1], [0, 1, 8]))
    capital = head == 0
    shout = capital & (lows[ends] == lows[starts]) & (length > 1)
    hashes = C.word_hashes(data, starts, ends)
    distinct, top = _distinct(own, hashes, n)
    pair_in = own[1:] == own[:-1]
    pairs, _ = _distinct(own[1:][pair_in], C.mixed(hashes[:-1][pair_in]) + hashes[1:][pair_in], n)
    is_line = np.ones(256, bool)
    is_line[10] = False
    line_start, line_end, line_before = C.word_bounds(data, offsets, is_line)
    lines = np.diff(line_before).astype(float)
    line_kinds, _ = _distinct(C.row_of(line_before), C.word_hashes(data, line_start, line_end), n)
    columns = [
        np.log1p(size), *share.T, np.log1p(words), mean, std, np.log1p(longest), by_row(length <= 2) / many, by_row(capital) / many, by_row(shout) / many, by_row(tail == 7) / many,
        by_row(letters[ends] == letters[starts]) / many, distinct / many, top / many, pairs / np.maximum(words - 1, 1), np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), line_kinds / np.maximum(lines, 1), counts[:, 5] / many,
    ]
    return np.column_stack(columns)


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees as arrays: feature, threshold, left and right child, and value of each node; roots; and the base score."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    model = {k: [] for k in ("feature", "threshold", "left", "right", "value")} | {"roots": [], "base": base}
    if len(np.unique(y)) < 2:
        return {k: np.array(v) for k, v in model.items()}
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root = len(model["feature"])
        model["roots"].append(root)
        at = np.full(len(y), root)
        _node(model)
        level = [root]
        for depth in range(DEPTH + 1):
            n = len(level)
            here = at - level[0]
            active = (here >= 0) & (here < n)
            k, gg, hh = here[active], g[active], h[active]
            total_g, total_h = np.bincount(k, gg, n), np.bincount(k, hh, n)
            for i, node in enumerate(level):
                model["value"][node] = RATE * total_g[i] / (total_h[i] + L2)
            if depth == DEPTH:
                break
            best = np.full(n, 1e-6)
            pick = np.zeros((n, 2), np.int64)
            for f in range(x.shape[1]):
                place = k * BINS + binned[active, f]
                lg, lh, lc = (np.cumsum(np.bincount(place, w, n * BINS).reshape(n, BINS), 1) for w in (gg, hh, None))
                gain = lg**2 / (lh + L2) + (total_g[:, None] - lg) ** 2 / (total_h[:, None] - lh + L2) - (total_g**2 / (total_h + L2))[:, None]
                gain[(lc < LEAST) | (lc[:, -1:] - lc < LEAST)] = 0
                gain[:, len(cuts[f]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                pick[better] = np.column_stack([np.full(n, f), top])[better]
            following = []
            for i, node in enumerate(level):
                if best[i] > 1e-6:
                    f, b = pick[i]
                    left, right = _node(model), _node(model)
                    model["feature"][node], model["threshold"][node], model["left"][node], model["right"][node] = f, cuts[f][b], left, right
                    rows = at == node
                    at[rows] = np.where(binned[rows, f] <= b, left, right)
                    following += [left, right]
            if not following:
                break
            level = following
        margin += np.array(model["value"])[at]
    return {k: np.array(v) for k, v in model.items()}


def _node(model: dict) -> int:
    """A new leaf; its children are itself."""
    k = len(model["feature"])
    for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", 0.0)):
        model[name].append(v)
    return k


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: every tree walked at once, for all rows."""
    margin = np.full(len(x), float(model["base"]))
    if len(model["roots"]):
        at = np.tile(model["roots"].astype(np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, model["feature"][at]] <= model["threshold"][at], model["left"][at], model["right"][at])
        margin += model["value"][at].sum(1)
    return 1 / (1 + np.exp(-margin))


def _measured(docs: DataFrame, finish, schema) -> DataFrame:
    """docs through finish(batch slice, statistics of its texts)."""

    def make(batch):
        data, offsets = C.column_bytes(batch.column("text"))
        for a, b in C.blocks(offsets):
            yield finish(batch.slice(a, b - a), statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))

    return C.map_texts(docs, make, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model for docs(doc_id, text) and labels(doc_id, quality), of which at most `sample` documents are used."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def finish(rows, x):
        return pa.record_batch([rows.column("doc_id"), rows.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # At most `sample` rows of two numbers are broadcast.
    found = _measured(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id"), finish, "doc_id long, quality int, x array<double>")
    # Of the rows that repeat a doc_id one is learned from, so no more than `sample` come to the driver.
    got = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("y")).select("doc_id", "y.quality", "y.x").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return grow(x, (got["quality"].to_numpy(float) >= 1).astype(float))


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with score and predicted added, from the column text alone."""
    plain = docs.columns if keep is None else keep

    def finish(rows, x):
        p = score(model, x)
        return pa.record_batch([*(rows.column(c) for c in plain), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*plain, "score", "predicted"])

    return _measured(docs.withColumn("text", F.col("text").cast("string")), finish, docs.select(*plain).schema.add("score", "double").add("predicted", "integer"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(C.crc_mod("doc_id", 3) != 1))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(asked, model, ["doc_id", "held_out"])
