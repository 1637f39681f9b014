"""Exact repeats of at least `length` tokens across documents of any number, without pairs of copies.

A window is `length` successive tokens of one document. Which windows stand earlier elsewhere is found thus:

1. Anchors. Of the `gram`-token hashes in a window the smallest is its anchor (winnowing): equal windows have
   equal anchors. Successive windows with one anchor form a run, which a content hash of all its tokens names.
2. Runs are dealt by anchor, packed into binary rows, and joined on it. A task of the map side first settles the
   runs whose content it has seen in an earlier document itself, so a passage with millions of copies is sent
   once a task. Where a run's content stands earlier, all its windows repeat, and nothing is left to extend. The
   first run of each content stays open if another content of its anchor may share a window with it. A window that
   holds the anchor has at least half of its other tokens on one side of it, so a shared one needs a side of that many
   tokens in common: 16 bits of both sides' hashes go with a run. Anchors alone coincide by chance, and ever more
   of them the larger the table is.
3. Open runs are read again from their texts and dealt by anchor with all their tokens: the anchor with as much
   on either side as its windows reach. The operator's index extends or sorts them, and finds every window of
   theirs that stands earlier. What holds of the hottest anchors: where a task has over HOT contents of one, or all
   tasks over CONTENTS, its windows are dealt by the hash of all their tokens instead, the longest seed there is.
4. What was found joins the texts by document, as packed rows in buckets of documents.

Every text crosses the network twice at most; what is held in memory is a task's share of runs, or the findings
of one bucket of documents. There are as many buckets as spark.sql.shuffle.partitions, or more where the table is
large for that many, each a task of its own. Hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK_BYTES = 8 << 20
#: Entries found to repeat that a task gathers before it packs them.
GATHER = 1 << 18
HOT = 32
#: Longest run of windows kept as one; a longer one is cut at this distance from its start.
LONGEST = 1 << 15
#: Contents of one anchor that are held against each other at most.
CONTENTS = 128
RUNS, DUP, OPEN, SPREAD, TEXT, CONTEXT = range(6)


@dataclass(frozen=True)
class Kind:
    """unit: byte or word. by_place: an earlier start in the same document counts as earlier too. index: what settles open runs."""

    unit: str
    length: int
    gram: int
    by_place: bool
    index: type


#: Bytes that a code of tokens() stands for, from each byte on.
WIDE = 8


def tokens(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """64-bit codes of the tokens of a block, the number of tokens before each row, and how many tokens a code stands for."""
    if unit == "byte":
        return np.ascontiguousarray(C.eights(data)[: max(0, len(data) - WIDE + 1)]).view(C.U64)[:, 0], offsets, WIDE
    starts, ends, before = C.word_bounds(data, offsets, C.byte_class("space"))
    return C.word_hashes(data, starts, ends), before, 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x, done = np.minimum(x[: len(x) - done], x[done:]), done * 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


#: Sides of a run that holds its anchor at several places, and of a marker: it may share a window with any other.
WILD = 0xFFFFFFFF


def sides_of(codes: np.ndarray, grams: np.ndarray, start: np.ndarray, last: np.ndarray, wide: int, kind: Kind) -> np.ndarray:
    """16 bits of the hash of what stands left of each run's anchor, and 16 of what stands right of it; 0 where no window of the run reaches so far.

    A run is that of the windows at start to last. A side is half of the tokens that a window has beside its anchor.
    """
    half, near = -(-(kind.length - kind.gram) // 2), np.lib.stride_tricks.sliding_window_view(grams, kind.length - kind.gram + 1)
    # The leftmost place of the anchor in the first window, and the rightmost in the last one: equal if there is one only.
    place = start + near[start].argmin(1)
    once = place == last + near.shape[1] - 1 - near[last][:, ::-1].argmin(1)
    span = max(half, wide)  # where the half is shorter than a code, some of the anchor goes along
    out = np.zeros(len(start), np.uint32)
    for shift, reached, at in ((16, place - half >= start, place - half), (0, place + kind.gram + half <= last + kind.length, place + kind.gram + half - span)):
        some = np.flatnonzero(once & reached)
        out[some] |= (C.span_hashes(codes, at[some], at[some] + span, wide) % C.U64(0xFFFE)).astype(np.uint32) + np.uint32(1) << np.uint32(shift)
    out[~once] = WILD
    return out


def runs(codes: np.ndarray, before: np.ndarray, wide: int, kind: Kind) -> tuple[np.ndarray, ...]:
    """(anchor, content, row, start, windows, sides) of each run; start is counted from the row's first token."""
    n = int(before[-1]) - kind.length + 1
    if n <= 0:
        return (np.zeros(0, C.U64),) * 2 + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint32),)
    grams = C.gram_hashes(codes, kind.gram, wide)
    least = sliding_min(grams, kind.length - kind.gram + 1)
    row = np.repeat(np.arange(len(before) - 1, dtype=np.int32), np.diff(before))
    whole = row[:n] == row[kind.length - 1 :]
    same = whole[1:] & whole[:-1] & (least[1:] == least[:-1])
    if kind.by_place:
        # A run ends with its leftmost anchor, so that equal windows of one document fall into different runs.
        same &= grams[: n - 1] != least[:-1]
    start = np.flatnonzero(whole & ~np.r_[False, same])
    size = np.flatnonzero(whole & ~np.r_[same, False]) - start + 1
    if len(size) and size.max() > LONGEST:
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + step * LONGEST, np.minimum(np.repeat(size, parts) - step * LONGEST, LONGEST)
    content = C.span_hashes(codes, start, start + size + kind.length - 1, wide)
    own = row[start].astype(np.int64)
    return least[start], content, own, start - before[own], size, sides_of(codes, grams, start, start + size - 1, wide, kind)


def packed(ids: np.ndarray, prints: np.ndarray, rows: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Entries of documents as bytes; rows (ascending) says to which of ids and prints an entry belongs."""
    new = np.r_[True, rows[1:] != rows[:-1]]
    first = np.flatnonzero(new)
    some = rows[first]
    parts = [np.array([len(some), len(rows)], np.int64), ids[some], prints[some], np.diff(np.r_[first, len(rows)]).astype(np.uint32), *columns]
    return zstd.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def unpacked(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    """[doc_id, print, *columns] of each entry."""
    data = zstd.ZstdDecompressor().decompress(raw)
    n_docs, n = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for kind, many in (("i8", n_docs), ("i8", n_docs), ("u4", n_docs), *((k, n) for k in kinds)):
        x = np.frombuffer(data, kind, many, at)
        at += x.nbytes
        out.append(x)
    count = out.pop(2)
    return [np.repeat(out[0], count), np.repeat(out[1], count), *out[2:]]


ENTRY, FACT = ["u8", "u4", "u4", "u4", "u4"], ["u4", "u4"]
SHUFFLED = "p int, kind int, payload binary"


def row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    p, kind, payload = zip(*rows, strict=True)
    return pa.record_batch([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["p", "kind", "payload"])


def dealt(bucket: np.ndarray, kind: int, ids, prints, rows, columns) -> list[tuple[int, int, bytes]]:
    """Entries, in any order, as one packed row for each bucket."""
    order = np.lexsort((columns[-2], rows, bucket))
    bucket, rows, columns = bucket[order], rows[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    return [(int(bucket[a]), kind, packed(ids, prints, rows[a:b], [c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def document_bucket(ids: np.ndarray, prints: np.ndarray, n: int) -> np.ndarray:
    return ((ids ^ prints) % n).astype(np.int32)


def facts_of(kind: int, n: int, ids: np.ndarray, prints: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Findings about documents, packed by bucket of documents."""
    if not len(ids):
        return []
    order = np.lexsort((start, prints, ids))
    ids, prints, start, size = ids[order], prints[order], start[order].astype(np.int64), size[order].astype(np.int64)
    rows = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])])
    if kind == DUP:  # touching spans of windows are one
        far = np.int64(1 << 33)
        start, end = C.merged(start + rows * far, start + size + rows * far)
        own = start // far
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        ids, prints, size, start = ids[first][own], prints[first][own], end - start, start - own * far
        rows = own
    table = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    number = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])
    return dealt(document_bucket(ids, prints, n), kind, ids[table], prints[table], number, [start.astype(np.uint32), size.astype(np.uint32)])


class Joined:
    """Entries met in one join on their key."""

    def __init__(self, by_place: bool):
        self.by_place, self.parts = by_place, []

    def add(self, entries: list[np.ndarray]) -> list[list[np.ndarray]]:
        """Takes [key, low, doc_id, print, start, windows, sides]; returns entries found to repeat so far."""
        self.parts.append(entries)
        return []

    def close(self) -> tuple[list[np.ndarray] | None, list[list[np.ndarray]]]:
        """(first entries in order, repeating entries)."""
        if not self.parts:
            return None, []
        first, again = met([np.concatenate(c) for c in zip(*self.parts, strict=True)], self.by_place)
        return first, [again]


def met(entries: list[np.ndarray], by_place: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(entries with no earlier equal, in order of key; the others). Entries are equal if key and low are. What else an entry has goes with it."""
    order = np.argsort(entries[0], kind="stable")
    key, low = entries[0][order], entries[1][order]
    same = key[1:] == key[:-1]
    if (same & (low[1:] != low[:-1])).any():
        order = np.lexsort((entries[1], entries[0]))
        key, low = entries[0][order], entries[1][order]
        same = (key[1:] == key[:-1]) & (low[1:] == low[:-1])
    entries = [c[order] for c in entries]
    key, _, doc, _, start, size = entries[:6]
    head = np.flatnonzero(np.r_[True, ~same]) if len(key) else np.zeros(0, np.int64)
    if not len(head):
        return entries, [c[:0] for c in entries]
    many = np.diff(np.r_[head, len(key)])
    least = np.minimum.reduceat(doc, head)
    later = doc > np.repeat(least, many)
    if by_place:
        place = np.where(later, np.iinfo(np.int64).max, start.astype(np.int64))
        later |= place > np.repeat(np.minimum.reduceat(place, head), many)
    later &= size > 0  # a marker is never a repeat
    return [c[~later] for c in entries], [c[later] for c in entries]


def may_share(key: np.ndarray, low: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which entries, in order of key, may share a window with another content of their anchor: one has an equal side, or either is wild."""
    anchor = key >> C.U64(32)
    head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    content = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (low[1:] != low[:-1])])
    wild = np.repeat(np.logical_or.reduceat(sides == WILD, head), np.diff(np.r_[head, len(key)]))
    out = wild.copy()
    for side in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
        some = np.flatnonzero(~wild & (side > 0))
        if len(some):
            code = (anchor[some] << C.U64(16)) | side[some]
            order = np.lexsort((content[some], code))
            code, some = code[order], some[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            end = np.r_[first[1:], len(code)]
            out[some] |= np.repeat(content[some[first]] != content[some[end - 1]], end - first)
    return out


def _key(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort key (32 bits of the anchor, 32 of the content) and the content's other 32 bits."""
    return (anchor << C.U64(32)) | (content >> C.U64(32)), content.astype(np.uint32)


def find_runs(docs: DataFrame, kind: Kind, n: int) -> DataFrame:
    """Step 2, map side: docs(doc_id, print, text) as SHUFFLED rows."""

    def make(batch):
        data, offsets = C.column_bytes(batch.column("text"))
        ids, prints = (np.asarray(batch.column(k)) for k in ("doc_id", "print"))
        for a, b in C.blocks(offsets, CHUNK_BYTES):
            found = []
            for x, y in C.blocks(offsets[a : b + 1] - offsets[a]):
                piece = offsets[a + x : a + y + 1]
                anchor, content, row, *more = runs(*tokens(kind.unit, data[piece[0] : piece[-1]], piece - piece[0]), kind)
                found.append((anchor, content, row + a + x, *more))
            anchor, content, row, start, size, sides = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(anchor):
                continue
            key, low = _key(anchor, content)
            first, again = met([key, low, ids[row], prints[row], start, size, sides], kind.by_place)
            out = facts_of(DUP, n, *again[2:6])
            key, low, doc, mark, start, size, sides = first
            head = np.flatnonzero(np.r_[True, (key[1:] >> C.U64(32)) != (key[:-1] >> C.U64(32))])
            contents = np.add.reduceat(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])].astype(np.int64), head)
            hot = np.repeat(contents > HOT, np.diff(np.r_[head, len(key)]))
            out += facts_of(SPREAD, n, *(c[hot] for c in (doc, mark, start, size)))
            marker = head[contents > HOT]
            send = np.r_[np.flatnonzero(~hot), marker]
            size = np.r_[size[~hot], np.zeros(len(marker), size.dtype)]
            sides = np.r_[sides[~hot], np.full(len(marker), WILD, np.uint32)]
            # The bucket comes from the 32 bits of the anchor that the key holds.
            bucket = ((key[send] >> C.U64(32)) % C.U64(n)).astype(np.int32)
            number = _numbered(doc[send], mark[send])
            out += dealt(bucket, RUNS, number[0], number[1], number[2], [key[send], low[send], sides, start[send].astype(np.uint32), size.astype(np.uint32)])
            yield row_batch(out)

    return C.map_texts(docs, make, SHUFFLED)


def _numbered(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, print) pairs and the number of each entry's."""
    order = np.lexsort((prints, ids))
    a, b = ids[order], prints[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[new], b[new], number


def settle(shuffled: DataFrame, kind: Kind, n: int, opened: bool) -> DataFrame:
    """Reduce side of steps 2 and 3 (opened): SHUFFLED rows, where p is now the bucket of documents, and kind DUP, OPEN or SPREAD."""

    def run(batches):
        joined, index = Joined(kind.by_place), kind.index(kind)
        found: list[list[np.ndarray]] = []

        def packed_facts():
            out = facts_of(DUP, n, *(np.concatenate(c) for c in list(zip(*(f[:6] for f in found), strict=True))[2:])) if found else []
            found.clear()
            return [row_batch(out)] if out else []

        for batch in batches:
            sort, payload = batch.column("kind").to_pylist(), batch.column("payload")
            if passed := [k for k, x in enumerate(sort) if x not in (RUNS, CONTEXT)]:
                yield batch.take(pa.array(passed))
            for k, x in enumerate(sort):
                if x == RUNS:
                    doc, mark, key, low, sides, start, size = unpacked(payload[k].as_buffer(), ENTRY)
                    found += joined.add([key, low, doc, mark, start, size, sides])
                elif x == CONTEXT:
                    found += index.add(Contexts.unpacked(payload[k].as_buffer(), kind))
            if sum(len(f[0]) for f in found) > GATHER:
                yield from packed_facts()
        first, repeats = joined.close()
        found += repeats
        for more in index.close():
            found.append(more)
            if sum(len(f[0]) for f in found) > GATHER:
                yield from packed_facts()
        yield from packed_facts()
        if first is not None and len(first[0]) and not opened:
            share = may_share(first[0], first[1], first[6])
            key, low, doc, mark, start, size = (c[share] for c in first[:6])
            head = np.flatnonzero(np.r_[True, (key[1:] >> C.U64(32)) != (key[:-1] >> C.U64(32))]) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.r_[head, len(key)])
            differs = np.r_[False, (key[1:] != key[:-1]) | (low[1:] != low[:-1])][: len(key)] | (size == 0)
            differs &= ~_is_head(head, len(key), size)
            total = lambda x: np.repeat(np.add.reduceat(x.astype(np.int64), head), many) if len(x) else x.astype(np.int64)
            several, hot = (total(differs) > 0) & (size > 0), (total(size == 0) > 0) | (total(differs) >= CONTENTS)
            out = [row for sort, some in ((OPEN, several & ~hot), (SPREAD, several & hot)) for row in facts_of(sort, n, *(c[some] for c in (doc, mark, start, size)))]
            if out:
                yield row_batch(out)

    return shuffled.mapInArrow(run, SHUFFLED)


@dataclass
class Contexts:
    """Open runs: anchor, document, print, start and windows of each, the anchor's place behind the start, and tokens[first[k] : first[k + 1]]."""

    anchor: np.ndarray
    doc: np.ndarray
    print: np.ndarray
    start: np.ndarray
    size: np.ndarray
    place: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    def packed(self, some: np.ndarray) -> bytes:
        many = np.diff(self.first)[some]
        at = np.repeat(self.first[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        parts = [np.array([len(some)], np.int64), *(x[some] for x in (self.anchor, self.doc, self.print)), *(x[some].astype(np.uint32) for x in (self.start, self.size, self.place)), self.tokens[at]]
        return zstd.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))

    @classmethod
    def unpacked(cls, raw: bytes, kind: Kind) -> Contexts:
        data = zstd.ZstdDecompressor().decompress(raw)
        n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for sort in ("u8", "i8", "i8", "u4", "u4", "u4"):
            x = np.frombuffer(data, sort, n, at)
            at += x.nbytes
            out.append(x.astype(np.int64) if sort == "u4" else x)
        return cls(*out, np.frombuffer(data, np.uint8 if kind.unit == "byte" else C.U64, offset=at), np.r_[0, np.cumsum(out[4] + kind.length - 1)])

    @classmethod
    def joined(cls, parts: list[Contexts]) -> Contexts:
        names = ("anchor", "doc", "print", "start", "size", "place", "tokens")
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in names), np.r_[0, np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])


def contexts(doc: int, mark: int, data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: Kind) -> Contexts:
    """The open runs of a text, given as bytes. The anchor is the leftmost smallest gram of a run's last window, which all its windows hold."""
    codes, _, wide = tokens(kind.unit, data, np.array([0, len(data)]))
    grams = C.gram_hashes(codes, kind.gram, wide)
    last = start + size - 1
    near = grams[last[:, None] + np.arange(kind.length - kind.gram + 1)]
    place = near.argmin(1)
    many = size + kind.length - 1
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
    n = len(start)
    return Contexts(near[np.arange(n), place], np.full(n, doc), np.full(n, mark), start, size, last + place - start, (data if kind.unit == "byte" else codes)[at], np.r_[0, np.cumsum(many)])


def _is_head(head: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """The first entry of each anchor differs from nothing, unless it is a marker."""
    out = np.zeros(n, bool)
    out[head] = True
    return out & (size > 0)


def with_facts(facts: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Findings and texts together by bucket of documents, findings first."""
    left = facts.select("p", "kind", "payload", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("print"), F.lit(None).cast("string").alias("text"))
    right = docs.select(F.pmod(F.col("doc_id").bitwiseXOR(F.col("print")), F.lit(n)).cast("int").alias("p"), F.lit(TEXT).alias("kind"), F.lit(None).cast("binary").alias("payload"), "doc_id", "print", "text", *[c for c in docs.columns if c not in ("doc_id", "print", "text")])
    return left.unionByName(right, allowMissingColumns=True).repartitionById(n, "p").sortWithinPartitions("p", "kind")


def by_bucket(batches):
    """(rows of texts, their findings) for stretches of rows of one bucket; findings(doc_id, print) gives starts, sizes and kinds."""
    at, parts, found = None, [], {}
    for batch in batches:
        bucket, sort = np.asarray(batch.column("p")), np.asarray(batch.column("kind"))
        cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | ((sort[1:] == TEXT) != (sort[:-1] == TEXT)), True]) if len(bucket) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if bucket[a] != at:
                at, parts, found = bucket[a], [], {}
            if sort[a] != TEXT:
                for k in range(a, b):
                    entries = unpacked(batch.column("payload")[k].as_buffer(), FACT)
                    parts.append([*entries, np.full(len(entries[0]), sort[k])])
                continue
            if parts:
                doc, mark, start, size, what = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((start, mark, doc))
                doc, mark, start, size, what = doc[order], mark[order], start[order].astype(np.int64), size[order].astype(np.int64), what[order]
                head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
                found = {(int(doc[i]), int(mark[i])): (start[i:j], size[i:j], what[i:j]) for i, j in zip(head, np.r_[head[1:], len(doc)], strict=True)}
                parts = []
            yield batch.slice(a, b - a), found


def find_opened(together: DataFrame, kind: Kind, n: int) -> DataFrame:
    """Step 3, map side: open runs with their tokens as SHUFFLED rows, dealt by anchor, and the windows of the hottest anchors' runs, dealt by window hash."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        opened: list[Contexts] = []
        size, done = 0, set()

        def out():
            rows = _sent(held, kind, n) if held else []
            if opened:
                every = Contexts.joined(opened)
                bucket = ((every.anchor >> C.U64(32)) % C.U64(n)).astype(np.int32)
                order = np.lexsort((every.anchor, bucket))
                cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
                rows += [(int(bucket[order[a]]), CONTEXT, every.packed(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held.clear()
            opened.clear()
            return [row_batch(rows)] if rows else []

        for rows, found in by_bucket(batches):
            ids, prints = (np.asarray(rows.column(k)) for k in ("doc_id", "print"))
            some = [k for k, key in enumerate(zip(ids.tolist(), prints.tolist(), strict=True)) if key in found]
            if not some:
                continue
            data, offsets = C.column_bytes(rows.column("text"))
            for k in some:
                key = int(ids[k]), int(prints[k])
                if key in done:  # an equal row
                    continue
                done.add(key)
                starts, sizes, what = found[key]
                text = data[offsets[k] : offsets[k + 1]]
                if (own := what == OPEN).any():
                    opened.append(contexts(*key, text, starts[own], sizes[own], kind))
                    size += len(opened[-1].tokens) // (8 if kind.unit == "byte" else 1)
                if (own := what == SPREAD).any():
                    starts, ends = C.merged(starts[own], (starts + sizes)[own])
                    codes, _, wide = tokens(kind.unit, text, np.array([0, len(text)]))
                    many = ends - starts
                    at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    held.append([C.span_hashes(codes, at, at + kind.length, wide), np.zeros(len(at), np.uint32), np.full(len(at), ids[k]), np.full(len(at), prints[k]), at, np.ones(len(at), np.int64), np.zeros(len(at), np.uint32)])
                    size += len(at)
            if size > CHUNK_BYTES // 16:
                yield from out()
                size = 0
        yield from out()

    return together.mapInArrow(run, SHUFFLED)


def _sent(held: list[list[np.ndarray]], kind: Kind, n: int) -> list[tuple[int, int, bytes]]:
    first, again = met([np.concatenate(c) for c in zip(*held, strict=True)], kind.by_place)
    key, low, doc, mark, start, size, sides = first
    ids, prints, number = _numbered(doc, mark)
    return facts_of(DUP, n, *again[2:6]) + dealt((key % C.U64(n)).astype(np.int32), RUNS, ids, prints, number, [key, low, sides, start.astype(np.uint32), size.astype(np.uint32)])


def repeated(docs: DataFrame, kind: Kind) -> tuple[DataFrame, int]:
    """(findings about docs(doc_id, print, text), number of buckets): spans of windows that stand earlier."""
    n = C.partitions(docs)
    plain = docs.select("doc_id", "print", "text")
    facts = C.written(settle(find_runs(plain, kind, n).repartitionById(n, "p"), kind, n, False), "runs")
    opened = facts.where(F.col("kind") != DUP)
    settled = facts.where(F.col("kind") == DUP)
    if opened.limit(1).count():
        more = find_opened(with_facts(opened, plain, n), kind, n)
        settled = settled.unionByName(C.written(settle(more.repartitionById(n, "p"), kind, n, True), "extended"))
    return settled, n


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """docs with doc_id (null as NO_ID), print (a hash of the text, which tells rows of one doc_id apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"), *more)


def cut(docs: DataFrame, kind: Kind, finish, schema) -> DataFrame:
    """keyed() docs, with any further columns, through finish(rows, spans): spans has for each row the starts and ends, in tokens, to remove."""
    facts, n = repeated(docs, kind)
    length = kind.length

    def run(batches):
        for rows, found in by_bucket(batches):
            keys = zip(rows.column("doc_id").to_pylist(), rows.column("print").to_pylist(), strict=True)
            spans = [C.merged(s, s + z + length - 1) if s is not None else None for s, z, _ in (found.get(key, (None, None, None)) for key in keys)]
            yield finish(rows, spans)

    return with_facts(facts, docs, n).mapInArrow(run, schema)
