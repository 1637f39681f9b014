"""Dedup of long strings with a logarithmic family of suffix arrays, over bytes.

Positions are sampled by content (the anchors of repeats.py), and documents joined on them: where what surrounds
an anchor is the same as in an earlier document, all its strings of LENGTH bytes are. What differs goes to the task
of the anchor with its bytes. There every batch that arrives gets a suffix array: the places at which a window
starts, in the order of the bytes from there on, cut to LENGTH. It is merge-scanned against the level of its size:
neighbours with a common prefix of LENGTH bytes are long matches, of which the later documents' are reported and
leave, and the merged array moves up a level, geometrically, until a level is free. The last merge leaves each
string to its first document. Only sampled places meet, since all suffixes of a text would take LENGTH times its
size to send. Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id is
removed.

Edge cases: a null or empty text has no bytes. Fewer than LENGTH bytes never match. Repeats inside a
document, and rows that repeat a doc_id, do not remove each other. A null doc_id counts as after all others
and stays null. Bytes left may begin or end inside a character: kept holds them as they are, and the text of
the pipeline drops such remains. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

LENGTH, GRAM = 50, 24


class Levels:
    """Suffix arrays whose sizes grow geometrically; a new one merges with those of its size.

    An array is [suffixes cut to `length` bytes, in their order; doc_id; print; start].
    """

    #: Suffixes of the lowest level.
    BASE = 1 << 14

    def __init__(self, kind: R.Kind):
        self.length, self.levels = kind.length, {}

    def add(self, batch: R.Contexts) -> list[list[np.ndarray]]:
        """Takes a batch of runs; returns entries [doc_id, doc_id, doc_id, print, start, 1] of windows that stand earlier."""
        own = np.repeat(np.arange(len(batch.size)), batch.size)
        within = np.arange(len(own)) - np.repeat(np.cumsum(batch.size) - batch.size, batch.size)
        view = np.lib.stride_tricks.sliding_window_view(batch.tokens, self.length)
        suffixes = np.ascontiguousarray(view[batch.first[own] + within]).view(f"S{self.length}")[:, 0]
        return self.put([suffixes, batch.doc[own], batch.print[own], batch.start[own] + within])

    def put(self, new: list[np.ndarray]) -> list[list[np.ndarray]]:
        """A batch of places into the levels."""
        new, again = scanned([new])
        found = [again]
        while (level := max(0, (len(new[0]) // self.BASE).bit_length())) in self.levels:
            new, again = scanned([self.levels.pop(level), new])
            found.append(again)
        self.levels[level] = new
        return [f for f in found if len(f[0])]

    def close(self) -> Iterator[list[np.ndarray]]:
        """The windows that the last merges find to stand earlier."""
        last: list[list[np.ndarray]] = []
        for level in sorted(self.levels):
            new, again = scanned([self.levels.pop(level), *last])
            last = [new]
            if len(again[0]):
                yield again


def scanned(arrays: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Arrays merged into one in suffix order, without the places whose string also starts in an earlier document; and those."""
    suffixes, doc, mark, start = (np.concatenate(c) for c in zip(*arrays, strict=True))
    order = np.argsort(suffixes, kind="stable")  # merges what is sorted already
    suffixes, doc, mark, start = suffixes[order], doc[order], mark[order], start[order]
    head = np.flatnonzero(np.r_[True, suffixes[1:] != suffixes[:-1]])
    later = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.r_[head, len(doc)])) if len(doc) else np.zeros(0, bool)
    return [x[~later] for x in (suffixes, doc, mark, start)], [*[doc[later]] * 3, mark[later], start[later], np.ones(int(later.sum()), np.int64)]


def bytes_kind(length: int = LENGTH, gram: int = GRAM) -> R.Kind:
    return R.Kind("byte", length, gram, False, Levels)


def _left(raw: bytes, found) -> bytes:
    if not found:
        return raw
    starts, ends = (x.tolist() for x in found)
    return b"".join(raw[x:y] for x, y in zip([0, *ends], [*starts, len(raw)], strict=True))


def without_matches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed bytes), kept (bytes left) and their SHA-256 for every row of docs(doc_id, text)."""

    def finish(rows, spans):
        data, offsets = C.column_bytes(rows.column("text"))
        raw = data.tobytes()
        kept = [_left(raw[a:b], found) for a, b, found in zip(offsets[:-1], offsets[1:], spans, strict=True)]
        size = np.diff(offsets)
        listed = [[{"start": x, "end": y} for x, y in zip(*(v.tolist() for v in f), strict=True)] if f else [] for f in spans]
        columns = [pa.array(size), pa.array(size - np.array([len(k) for k in kept], np.int64)), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        return pa.record_batch([rows.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    out = R.cut(R.keyed(docs), bytes_kind(length), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NO_ID)))


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all columns, matches cut out of text and n_chars counted anew where there is such a column."""
    columns = docs.columns
    carried = R.keyed(docs, F.struct(*[F.col(c) for c in columns if c != "text"]).alias("_row"))

    def finish(rows, spans):
        texts = rows.column("text")
        if any(spans):
            data, offsets = C.column_bytes(texts)
            raw = data.tobytes()
            texts = pa.array([_left(raw[a:b], found).decode("utf-8", "ignore") if found else t for a, b, found, t in zip(offsets[:-1], offsets[1:], spans, texts.to_pylist(), strict=True)], pa.string())
        return pa.record_batch([rows.column("_row"), texts], ["_row", "text"])

    out = R.cut(carried, bytes_kind(length), finish, carried.select("_row", "text").schema)
    back = {c: F.col("text") if c == "text" else F.col(f"_row.{c}") for c in columns}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(back["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in back.items()])


def op9_suffixes(spark, sf_dir: str) -> DataFrame:
    return without_matches(C.table(spark, sf_dir, "documents")).drop("spans", "kept")


SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS g FROM d, unnest(range(0, n)) AS u(i)),
f AS (SELECT g, min(doc_id) AS first FROM p WHERE g IS NOT NULL GROUP BY g),
s AS (SELECT doc_id, i, b, coalesce(first < doc_id, false) AS again FROM p LEFT JOIN f USING (g)),
c AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
