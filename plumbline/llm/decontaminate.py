"""Benchmark decontamination: suffix arrays of the training text, binary-searched with every test suffix.

A shard is a block of documents within a task. Its suffix array holds word positions in the order of the words
from there on (words ordered by their hashes), compared up to WINDOW words. Only positions whose first words, up
to HEAD of them, open some test suffix are put into the array, and only test suffixes whose first words occur in
the shard are searched; no binary search of another could end at a position. Every test suffix of WINDOW words,
and every shorter item as a whole, is found by binary search, which compares word by word; the range found holds
its verbatim places. From the first place on, all test suffixes that start alike are followed word by word, and
the longest verbatim match is kept with its item and its places; the next starts at the first place that the match
does not hold. The matches' words are counted.

The test set is read in blocks of about TEST_BLOCK words. Each is broadcast on its own and met with all
documents, whose rows carry the findings so far by way of a written table; there is no shuffle. A test set of
any size works in bounded memory.

Edge cases: null text has no words and is never contaminated. Null or wordless items match nothing. Items
that repeat an item_id count once; items with a null item_id hit words but are not listed. Documents that
repeat a doc_id are judged row by row. Empty tables give empty results, an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, HEAD = 13, 4
#: Words of test items held in memory, and broadcast, at a time.
TEST_BLOCK = 500_000
#: Bytes of text in a shard.
SHARD = 4 << 20
#: Bits of a head's hash that address the table of flags.
FLAGS = 20

SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
MATCH = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("item_id", T.LongType()).add("item_start", T.IntegerType())
#: What search() adds: words in all, covered spans in words, ids of the items matched, and the longest matches.
FOUND = {"_words": T.LongType(), "_spans": T.ArrayType(SPAN), "_items": T.ArrayType(T.LongType()), "_matches": T.ArrayType(MATCH)}
ARROW = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.int64()), ("item_start", pa.int32())])))


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased word hashes of a block and the number of words before each row; also the words' byte bounds."""
    data = C.lower_table()[data]
    starts, ends, before = C.word_bounds(data, offsets, C.byte_class("alnum"))
    return C.word_hashes(data, starts, ends), before, starts, ends


def item_words(items: DataFrame) -> DataFrame:
    """item_id, n and words (hashes, as bytes) of the items that have words."""

    def make(batch):
        data, offsets = C.column_bytes(batch.column("text"))
        for a, b in C.blocks(offsets):
            hashes, before, _, _ = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            words = [hashes[x:y].tobytes() for x, y in zip(before[:-1], before[1:], strict=True)]
            yield pa.record_batch([batch.column("item_id").slice(a, b - a), pa.array(np.diff(before)), pa.array(words, pa.binary())], ["item_id", "n", "words"])

    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    return C.map_texts(items, make, "item_id long, n long, words binary").where("n > 0")


def in_order(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of the n words from each on, and those words by column."""
    columns = [words[at + c] for c in range(n)]
    order = np.lexsort(columns[::-1])
    return at[order], [c[order] for c in columns]


class Tests:
    """Test suffixes of n words in their order. Those that are equal, a class, are neighbours."""

    def __init__(self, n: int, words: np.ndarray, at: np.ndarray):
        self.n, self.head = n, min(n, HEAD)
        self.at, columns = in_order(words, at, n)
        new = np.zeros(len(at), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        self.first = np.r_[np.flatnonzero(new), len(at)]
        heads = C.gram_hashes(words, self.head)[self.at[self.first[:-1]]]
        self.by_head = np.argsort(heads, kind="stable")
        self.heads = heads[self.by_head]

    def flags(self) -> np.ndarray:
        out = np.zeros(1 << FLAGS, bool)
        out[(self.heads >> C.U64(64 - FLAGS)).astype(np.int64)] = True
        return out


class TestSet:
    """A block of test items: their words end to end, and their suffixes by length."""

    __test__ = False

    def __init__(self, ids: np.ndarray, words: list[bytes]):
        size = np.array([len(w) // 8 for w in words], np.int64)
        self.ids, self.words = ids, np.frombuffer(b"".join(words), C.U64)
        self.ends = np.cumsum(size)
        self.starts = starts = self.ends - size
        self.item = np.repeat(np.arange(len(size)), size)
        long = np.flatnonzero(size >= WINDOW)
        self.tests = [Tests(int(n), self.words, starts[size == n]) for n in np.unique(size[size < WINDOW])]
        if len(long):
            many = size[long] - WINDOW + 1
            self.tests.append(Tests(WINDOW, self.words, np.repeat(starts[long] - (np.cumsum(many) - many), many) + np.arange(many.sum())))

    def places(self, hashes: np.ndarray, before: np.ndarray, flags: list[np.ndarray]) -> Iterator[tuple[Tests, np.ndarray, np.ndarray]]:
        """For each length the places of the shard where a test suffix stands, in order, and the suffixes' classes."""
        row_end = np.repeat(before[1:], np.diff(before))
        grams: dict[int, np.ndarray] = {}
        for tests, flag in zip(self.tests, flags, strict=True):
            if tests.head not in grams:
                grams[tests.head] = C.gram_hashes(hashes, tests.head)
            heads = grams[tests.head]
            at = np.flatnonzero(flag[(heads >> C.U64(64 - FLAGS)).astype(np.int64)])
            at = at[at + tests.n <= row_end[at]]
            low, high = (np.searchsorted(tests.heads, heads[at], side) for side in ("left", "right"))
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            some, where = np.unique(low, return_index=True)
            many = high[where] - some
            asked = tests.by_head[np.repeat(some - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            suffixes, columns = in_order(hashes, at, tests.n)
            low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(suffixes))
            for c, column in enumerate(columns):
                key = self.words[tests.at[tests.first[asked]] + c]
                low, high = bounds(column, low, high, key)
                left = high > low
                asked, low, high = asked[left], low[left], high[left]
            many = high - low
            place = suffixes[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            order = np.argsort(place, kind="stable")
            yield tests, place[order], np.repeat(asked, many)[order]

    def matches(self, tests: Tests, place: np.ndarray, kind: np.ndarray, hashes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, words and places in the items of the longest matches; a match starts at the first place that the one before does not hold."""
        if tests.n < WINDOW:
            return place, np.full(len(place), tests.n), tests.at[tests.first[kind]]
        out, i = [], 0
        while i < len(place):
            size, q = self.longest(tests, int(kind[i]), hashes, int(place[i]), int(end[i]))
            out.append((int(place[i]), size, q))
            i = int(np.searchsorted(place, place[i] + size - tests.n + 1))
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)

    def longest(self, tests: Tests, kind: int, hashes: np.ndarray, place: int, end: int) -> tuple[int, int]:
        """(words, place in the items) of the longest match from a place on, whose row ends at end, of the suffixes of a class."""
        at, size = tests.at[tests.first[kind] : tests.first[kind + 1]], tests.n
        while True:
            if len(at) == 1 or place + size == end:
                break
            going = at[at + size < self.ends[self.item[at]]]
            going = going[self.words[going + size] == hashes[place + size]]
            if not len(going):
                return size, int(at[0])
            at, size = going, size + 1
        rest = min(end - place, int(self.ends[self.item[at[0]]] - at[0])) - size
        differ = np.flatnonzero(hashes[place + size : place + size + rest] != self.words[at[0] + size : at[0] + size + rest])
        return size + (int(differ[0]) if len(differ) else rest), int(at[0])


def bounds(column: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where key stands in column[low:high], which is sorted: binary searches side by side."""
    out = []
    for after in (False, True):
        a, b = low.copy(), high.copy()
        while len(going := np.flatnonzero(a < b)):
            mid = (a[going] + b[going]) // 2
            right = column[mid] <= key[going] if after else column[mid] < key[going]
            a[going[right]] = mid[right] + 1
            b[going[~right]] = mid[~right]
        out.append(a)
    return out[0], out[1]


def search(docs: DataFrame, tests: TestSet, listed: bool = True) -> DataFrame:
    """Every row of docs, which has a column text, with FOUND added, or extended where an earlier block of tests has added it.

    The matches themselves are listed on demand; their words are covered spans in any case.
    """
    plain = [c for c in docs.columns if c not in FOUND]

    def run(batches):
        flags = [t.flags() for t in tests.tests]
        for batch in batches:
            data, offsets = C.column_bytes(batch.column("text"))
            had = "_spans" in batch.schema.names
            for a, b in C.blocks(offsets, SHARD):
                hashes, before, _, _ = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = batch.slice(a, b - a)
                spans, items, matches = ([rows.column(k).to_pylist() for k in ("_spans", "_items", "_matches")] if had else ([[] for _ in range(a, b)] for _ in range(3)))
                found = [(np.zeros(0, np.int64),) * 3]
                for suffixes, place, kind in tests.places(hashes, before, flags):
                    row = np.searchsorted(before, place, "right") - 1
                    # Of each class in each row its items, once.
                    for r, k in np.unique(np.stack([row, kind]), axis=1).T.tolist():
                        items[r] = items[r] + tests.ids[np.unique(tests.item[suffixes.at[suffixes.first[k] : suffixes.first[k + 1]]])].tolist()
                    found.append(tests.matches(suffixes, place, kind, hashes, before[row + 1]))
                start, size, q = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(start, kind="stable")
                start, size, q = start[order], size[order], q[order]
                row = np.searchsorted(before, start, "right") - 1
                cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else []
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    r, own = int(row[x]), start[x:y] - before[row[x]]
                    old = np.array([(z["start"], z["end"]) for z in spans[r]], np.int64).reshape(-1, 2)
                    s, e = C.merged(np.r_[old[:, 0], own], np.r_[old[:, 1], own + size[x:y]])
                    spans[r] = [{"start": u, "end": v} for u, v in zip(s.tolist(), e.tolist(), strict=True)]
                    items[r] = sorted({*items[r]} - {C.NO_ID})
                    if listed:
                        item = tests.item[q[x:y]]
                        ids = [None if k == C.NO_ID else k for k in tests.ids[item].tolist()]
                        columns = own.tolist(), (own + size[x:y]).tolist(), ids, (q[x:y] - tests.starts[item]).tolist()
                        matches[r] = [*matches[r], *(dict(zip(("start", "end", "item_id", "item_start"), m, strict=True)) for m in zip(*columns, strict=True))]
                made = [pa.array(v, k) for v, k in zip((np.diff(before), spans, items, matches), ARROW, strict=True)]
                yield pa.record_batch([*(rows.column(c) for c in plain), *made], [*plain, *FOUND])

    schema = T.StructType([docs.schema[c] for c in plain])
    for name, kind in FOUND.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def blocks_of(items: DataFrame, size: int) -> Iterator[TestSet]:
    """The test items in blocks of about `size` words; at least one block, empty if there is none."""
    rows = C.written(item_words(items), "items")
    n_blocks = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // size))
    for k in range(n_blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == k).select(F.coalesce("item_id", F.lit(C.NO_ID)).alias("item_id"), "words").distinct().toPandas()
        own = own.sort_values(["item_id", "words"], kind="stable")
        yield TestSet(own["item_id"].to_numpy(np.int64), [bytes(w) for w in own["words"]])


def matched(docs: DataFrame, items: DataFrame, test_block: int = TEST_BLOCK, listed: bool = True) -> DataFrame:
    """docs with FOUND (the matches on demand), and _hit (words in matches) and _contaminated."""
    found = docs.withColumn("text", docs["text"].cast("string"))
    for k, tests in enumerate(blocks_of(items, test_block)):
        found = search(C.written(found, "matched") if k else found, tests, listed)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    return found.withColumn("_hit", hit).withColumn("_contaminated", (F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, judged on whole texts."""
    return matched(docs, items, listed=False).where(~F.col("_contaminated")).select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return matched(docs, C.table(spark, sf_dir, "benchmark"), listed=False).select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated")
    )


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS u(i) WHERE len(w) > 0),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM t) AS s, unnest(range(1, len(w) + 2 - n)) AS u(i) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM g JOIN t USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h) AS x, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
