"""What the operators share: shared storage, Arrow mapping over whole texts, and vectorised words.

Texts are handled as UTF-8 bytes in blocks of whole documents. A block holds about BLOCK_BYTES, or one
document if that is longer, so memory follows the longest text and not the partition: some 60 bytes for each byte
of it in the operators that hash every place of a text (MinHash, both kinds of repeats, decontamination).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, written  # noqa: F401  for the operators

BLOCK_BYTES = 192 * 1024
#: Stands for a null doc_id inside operators that order documents: after all others.
NO_ID = (1 << 63) - 1

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """How many buckets to deal df over: spark.sql.shuffle.partitions, and more where its files hold over `each` bytes for each of them."""
    given = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Without statistics Spark's estimate is far beyond any table.
    return max(given, min(-(-size // each), 1 << 21)) if size < 1 << 55 else given


def crc_mod(doc_id: str | Column, by: int) -> Column:
    """crc32 of doc_id as text, mod by; null counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % by


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, size: int = 0, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows that hold about size bytes (BLOCK_BYTES if 0), or one longer row."""
    size, at, n = size or BLOCK_BYTES, 0, len(offsets) - 1
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, to
        at = to


def map_texts(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each Arrow batch of df through make(), which yields batches of schema."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)

    return df.mapInArrow(run, schema)


def byte_class(words: str) -> np.ndarray:
    """Which bytes belong to a word. space: all but ASCII white space; alnum: 0-9, a-z and all of non-ASCII."""
    is_word = np.ones(256, bool)
    if words == "space":
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    else:
        is_word[:128] = False
        is_word[0x30:0x3A] = is_word[0x61:0x7B] = True
    return is_word


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves every other byte."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row (plus one) the number of words before it. Words never cross rows."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ U64(seed) if seed else x.copy()
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of a's items followed by b's. Scrambled at each step, so no sum of powers cancels in self-similar texts."""
    x = a * U64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def gram_hashes(codes: np.ndarray, n: int, wide: int = 1) -> np.ndarray:
    """64-bit hashes of all spans of n items, by doubling: of spans of wide, 2 wide, 4 wide, ... items those that make up n are joined.

    codes stand for the spans of `wide` items from each item on; n is a multiple of that power of two.
    """
    items = len(codes) + wide - 1
    if items < n:
        return np.zeros(0, U64)
    level, width, out, done = codes, wide, None, 0
    while True:
        if n & width:
            out = level if out is None else joined(out[: items - done - width + 1], level[done:])
            done += width
        if done == n:
            return out
        level = joined(level[:-width], level[width:])
        width *= 2


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: int = 1) -> np.ndarray:
    """64-bit hashes of spans of at least `wide` items, equal for equal items wherever they stand.

    codes are as for gram_hashes. A span is the two spans of the largest power of two that cover it, and its length.
    """
    size = ends - starts
    out = np.empty(len(starts), U64)
    level, width, longest = codes, wide, int(size.max()) if len(size) else 0
    while width <= longest:
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(own):
            out[own] = joined(joined(level[starts[own]], level[ends[own] - width]), size[own].astype(U64))
        if 2 * width <= longest:
            level = joined(level[:-width], level[width:])
        width *= 2
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """(len, 8) view: the eight bytes from each place on, zeros behind the end."""
    return np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))


#: Bytes of a word behind which it is hashed by BLAKE2.
FAR = 256
_LOW = (~U64(0)) >> (U64(64) - U64(8) * np.arange(9, dtype=U64).clip(1))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; what a word has beyond FAR bytes by a digest."""
    view, size = eights(data), ends - starts
    out, left, at = mixed(size.astype(U64) + U64(1)), np.arange(len(starts)), 0
    while len(left) and at < FAR:
        rest = size[left] - at
        x = np.ascontiguousarray(view[starts[left] + at]).view(U64)[:, 0]
        x &= _LOW[np.minimum(rest, 8)]
        out[left] = joined(out[left], x)
        at += 8
        left = left[rest > 8]
    for k in left:
        digest = hashlib.blake2b(data[starts[k] + at : ends[k]].tobytes(), digest_size=8).digest()
        out[k] = joined(out[k : k + 1], np.frombuffer(digest, U64))[0]
    return out


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """For each item the row it belongs to, from the counts before each row."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as disjoint maximal runs, in order; spans that touch are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
