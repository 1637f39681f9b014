"""Substring dedup by seed and extend, over words.

Seeds are winnowed anchors: of the 8-word hashes in each window of LENGTH words the smallest. Documents are joined
on them (repeats.py): where what surrounds an anchor is the same as in an earlier document, all of it is a match;
where it differs, the match is extended from the anchor to both sides, word by word, up to where a neighbouring
anchor takes over. Matches of at least LENGTH words that touch are one maximal repeat. Each word covered by a
window whose words also start earlier (in a smaller doc_id, or earlier in the same document) is removed.

Edge cases: a null, empty or wordless text has no words and an empty kept text. Fewer than LENGTH words never
repeat. Rows that repeat a doc_id are judged by doc_id and place, so equal rows are the same places and do
not remove each other. A null doc_id counts as after all others and stays null. Extra columns are ignored.
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

LENGTH, GRAM = 20, 8


class Extended:
    """Open runs of one anchor, each extended from the anchor against every earlier one."""

    #: Pairs extended at a time.
    PAIRS = 1 << 18

    def __init__(self, kind: R.Kind):
        self.kind, self.parts = kind, []

    def add(self, opened: R.Contexts) -> list[list[np.ndarray]]:
        self.parts.append(opened)
        return []

    def close(self) -> Iterator[list[np.ndarray]]:
        """Spans of windows that stand earlier, as entries: [doc_id, doc_id, doc_id, print, start, windows]."""
        if not self.parts:
            return
        x = R.Contexts.joined(self.parts)
        self.parts = []
        order = np.lexsort((x.start + x.place, x.doc, x.anchor))
        anchor = x.anchor[order]
        head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        before = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        total = np.cumsum(before)
        a = 0
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.PAIRS, "right")))
            later = np.repeat(np.arange(a, b), before[a:b])
            earlier = np.arange(len(later)) - np.repeat(np.cumsum(before[a:b]) - before[a:b], before[a:b]) + np.repeat(np.arange(a, b) - before[a:b], before[a:b])
            yield self.extended(x, order[earlier], order[later])
            a = b

    def extended(self, x: R.Contexts, one: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        """Of pairs of runs with one anchor, what the others repeat of the ones."""
        length, gram = self.kind.length, self.kind.gram
        apart = (x.doc[one] != x.doc[other]) | (x.start[one] + x.place[one] < x.start[other] + x.place[other])
        one, other = one[apart], other[apart]
        p, q = x.first[one] + x.place[one], x.first[other] + x.place[other]
        same = np.ones(len(one), bool)
        for k in range(gram):  # equal hashes are not enough
            same &= x.tokens[p + k] == x.tokens[q + k]
        one, other, p, q = one[same], other[same], p[same], q[same]
        reach = []
        for step, ends in ((-1, (x.first[one] - 1, x.first[other] - 1)), (1, (x.first[one + 1], x.first[other + 1]))):
            at, to = (p - 1, q - 1) if step < 0 else (p + gram, q + gram)
            many, alive = np.zeros(len(one), np.int64), np.arange(len(one))
            for _ in range(length - gram):
                alive = alive[(at[alive] != ends[0][alive]) & (to[alive] != ends[1][alive])]
                alive = alive[x.tokens[at[alive]] == x.tokens[to[alive]]]
                if not len(alive):
                    break
                many[alive] += 1
                at[alive] += step
                to[alive] += step
            reach.append(many)
        left, right = reach
        hit = left + gram + right >= length
        own = other[hit]
        return [*[x.doc[own]] * 3, x.print[own], (x.start + x.place)[own] - left[hit], (left + right)[hit] + gram - length + 1]


def words_kind(length: int = LENGTH, gram: int = GRAM) -> R.Kind:
    return R.Kind("word", length, gram, True, Extended)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words) and kept (text of the words left) for every row of docs(doc_id, text)."""

    def finish(rows, spans):
        data, offsets = C.column_bytes(rows.column("text"))
        raw = data.tobytes()
        n, removed, listed, kept = [], [], [], []
        for a, b, found in zip(offsets[:-1], offsets[1:], spans, strict=True):
            words = raw[a:b].split()
            starts, ends = (x.tolist() for x in found) if found else ([], [])
            left = words if not found else [w for x, y in zip([0, *ends], [*starts, len(words)], strict=True) for w in words[x:y]]
            n.append(len(words))
            removed.append(len(words) - len(left))
            listed.append([{"start": x, "end": y} for x, y in zip(starts, ends, strict=True)])
            kept.append(b" ".join(left))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary(), pa.string()]
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.record_batch([rows.column("doc_id"), *(pa.array(v, k) for v, k in zip((n, removed, listed, kept, sha), kinds, strict=True))], ["doc_id", "n_words", "n_removed", "spans", "kept", "kept_sha256"])

    out = R.cut(R.keyed(docs), words_kind(length), finish, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NO_ID))).withColumn("kept", F.col("kept").cast("string"))


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) AS x WHERE k > 1),
c AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 20)) AS u(p)),
s AS (SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(p, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
