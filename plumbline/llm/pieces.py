"""SentencePiece encoding and decoding with suffix arrays.

For a batch the distinct stretches of text that no piece can cross (a piece has its spaces in front) and that
the task has not met yet are joined into one text. Its suffix array, cut to the longest piece, is
binary-searched for every piece, which gives all places of all pieces. These edges are sorted by position; a
place that no edge crosses divides the text further. Then edges are relaxed: a unigram model would take the
best path, but the given vocabulary is a BPE model, whose right result is that of merges in the order of
score, leftmost first. So every part starts as single characters and, in rounds over all parts at once, takes
its best edge that joins two neighbours, until none is left. Characters without a piece become byte pieces.
Long parts go through the same merges with a heap. What a stretch is encoded as depends on it alone, so results are
remembered, up to MEMORY stretches of MEMORY_CHARS characters, and each is indexed once while it is.

The model's pieces are read on the driver and travel with the tasks; the path is a parameter. Models with
byte fallback, a dummy prefix and no other normalisation are supported; others raise ValueError.

Edge cases: null and empty texts have no ids, and null decodes to null. U+2581 in a text decodes to a space,
as in the original library. Repeated rows, null ids and extra columns are carried as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import importlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SPACE = "▁"
MEMORY = 500_000
#: Characters of the stretches that are remembered at most.
MEMORY_CHARS = 32 << 20
#: Parts of at most so many characters are merged in rounds, longer ones one by one.
SHORT = 48
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> dict:
    """What encoding needs of a model: pieces, their ids and ranks, and the ids of bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    n = model.vocab_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    of_byte = np.full(256, -1, np.int32)
    for i in range(n):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
    if (of_byte < 0).any() or model.decode(model.encode(" a  b\tﬁ ")) != " a  b\tﬁ ":
        raise ValueError("the model lacks byte fallback or normalises texts")
    scores = np.array([model.get_score(i) for i in plain])
    if any(SPACE in p.lstrip(SPACE) for p in map(model.id_to_piece, plain)):
        raise ValueError("a piece has a space behind another character")
    _, rank = np.unique(-scores, return_inverse=True)
    table = [b""] * n
    for i in range(n):
        table[i] = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
    for i in range(n):
        if model.is_control(i):
            table[i] = b""
    return {"pieces": [model.id_to_piece(i) for i in plain], "ids": np.array(plain, np.int32), "rank": rank.astype(np.int64), "of_byte": of_byte, "table": table}


class Encoder:
    """Encodes batches of texts; remembers stretches."""

    def __init__(self, model: dict):
        self.model = model
        self.longest = max(map(len, model["pieces"]))
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in model["pieces"]]
        self.length = np.array([len(p) for p in points])
        self.points = np.concatenate(points)
        self.first = np.r_[0, np.cumsum(self.length)]
        self.alphabet = np.unique(self.points)
        single = np.flatnonzero(self.length == 1)
        order = np.argsort(self.points[self.first[single]])
        self.single_point, self.single = self.points[self.first[single]][order], single[order]
        self.many = np.flatnonzero(self.length > 1)
        self.forget()

    def forget(self) -> None:
        """Stretches by number; the ids of stretch k are flat[begin[k] : begin[k + 1]]."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every longer piece at every place of text (code points), by place and length."""
        present = self.alphabet[np.isin(self.alphabet, text)]
        bits = 8 if len(present) < 255 else 16
        each = 64 // bits
        n_keys = -(-self.longest // each)
        # Characters of no piece are 0 and sort first; padding behind a piece is all zeros or all ones.
        code = np.searchsorted(present, text)
        code = np.where((code < len(present)) & (present[np.minimum(code, len(present) - 1)] == text), code + 1, 0) if len(present) else np.zeros(len(text), np.int64)
        padded = np.zeros(len(text) + n_keys * each, C.U64)
        padded[: len(text)] = code
        key = np.zeros(len(text) + (n_keys - 1) * each, C.U64)
        for k in range(each):
            key |= padded[k : k + len(key)] << C.U64(bits * (each - 1 - k))
        keys = [key[k * each : k * each + len(text)] for k in range(n_keys)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        # Of the pieces, only those whose characters all occur can be found.
        whole = np.logical_and.reduceat(np.isin(self.points, present), self.first[:-1])
        some = self.many[whole[self.many]]
        size = self.length[some]
        own = np.searchsorted(present, self.points).astype(C.U64) + C.U64(1)
        bounds = np.zeros((2, n_keys, len(some)), C.U64)
        bounds[1] = ~C.U64(0)
        for at in range(self.longest):
            has = size > at
            k, shift = at // each, C.U64(bits * (each - 1 - at % each))
            mask = C.U64((1 << bits) - 1) << shift
            for b in bounds:
                b[k, has] = (b[k, has] & ~mask) | (own[self.first[some[has]] + at] << shift)
        low, high = np.searchsorted(keys[0], bounds[0, 0], "left"), np.searchsorted(keys[0], bounds[1, 0], "right")
        for k in range(1, n_keys):
            for i in np.flatnonzero((high > low) & (size > k * each)):
                part = keys[k][low[i] : high[i]]
                low[i], high[i] = low[i] + np.searchsorted(part, bounds[0, k, i], "left"), low[i] + np.searchsorted(part, bounds[1, k, i], "right")
        count = high - low
        piece = np.repeat(some, count)
        place = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        bits = C.U64(len(self.length).bit_length())
        both = np.sort(((place * (self.longest + 1) + self.length[piece]).astype(C.U64) << bits) | piece.astype(C.U64))
        key, piece = (both >> bits).astype(np.int64), (both & ((C.U64(1) << bits) - C.U64(1))).astype(np.int64)
        return key // (self.longest + 1), key % (self.longest + 1), piece

    def relax(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, pieces) of the encoding of text, whose zeros divide it; piece -1 for a character without one."""
        place, length, piece = self.edges(text)
        wide = self.longest + 1
        self.edge_keys, self.edge_piece = place * wide + length, piece
        n = len(text)
        crossed = np.bincount(place + 1, minlength=n + 1) - np.bincount(place + length, minlength=n + 1)
        joined = np.cumsum(crossed)[:n] > 0
        part = np.cumsum(~joined) - 1
        size = np.bincount(part)
        start = np.arange(n)
        in_short = (size <= SHORT)[part]
        done = [np.zeros(0, np.int64)]
        s, p = start[in_short], part[in_short]
        while len(s):
            # Symbols s of the parts still merging; each may join the next one of its part.
            end = np.r_[s[1:], s[-1] + 1]
            last = np.r_[p[1:] != p[:-1], True]
            end[last] = (np.cumsum(size))[p[last]]
            to = np.r_[end[1:], 0]
            rank = np.where(last, np.iinfo(np.int64).max, self.rank_of(s, to - s, ~last))
            head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            best = np.minimum.reduceat(rank, head)
            going = best < np.iinfo(np.int64).max
            many = np.diff(np.r_[head, len(s)])
            stays = np.repeat(going, many)
            done.append(s[~stays])
            is_best = (rank == np.repeat(best, many)) & stays
            chosen = np.flatnonzero(is_best)
            chosen = chosen[np.r_[True, p[chosen][1:] != p[chosen][:-1]]] if len(chosen) else chosen
            keep = stays
            keep[chosen + 1] = False
            s, p = s[keep], p[keep]
        bounds = np.cumsum(size)
        for k in np.flatnonzero(size > SHORT):
            done.append(self.merged(int(bounds[k] - size[k]), int(bounds[k])))
        starts = np.sort(np.concatenate(done))
        ends = np.r_[starts[1:], n]
        size = ends - starts
        at = np.minimum(np.searchsorted(self.single_point, text[starts]), len(self.single) - 1)
        piece = np.where(self.single_point[at] == text[starts], self.single[at], -1)
        far = size > 1
        if far.any():
            piece[far] = self.edge_piece[np.searchsorted(self.edge_keys, (starts * wide + size)[far])]
        return starts, piece

    def rank_of(self, start: np.ndarray, length: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """The rank of the piece at each place, or the largest number where there is none."""
        out = np.full(len(start), np.iinfo(np.int64).max)
        ask = ask & (length <= self.longest)
        if len(self.edge_keys) and ask.any():
            key = start[ask] * (self.longest + 1) + length[ask]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            out[ask] = np.where(self.edge_keys[at] == key, self.model["rank"][self.edge_piece[at]], np.iinfo(np.int64).max)
        return out

    def merged(self, a: int, b: int) -> np.ndarray:
        """Starts of the symbols of text[a:b] after all merges, with a heap."""
        wide = self.longest + 1
        low, high = np.searchsorted(self.edge_keys, [a * wide, b * wide])
        rank = dict(zip(self.edge_keys[low:high].tolist(), self.model["rank"][self.edge_piece[low:high]].tolist(), strict=True))
        after, before = list(range(1, b - a + 1)), list(range(-1, b - a - 1))
        alive = [True] * (b - a)
        heap = []

        def offer(i):
            j = after[i]
            if j < b - a and (r := rank.get((a + i) * wide + after[j] - i)) is not None:
                heapq.heappush(heap, (r, i, j, after[j]))

        for i in range(b - a):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if alive[i] and j < b - a and alive[j] and after[i] == j and after[j] == end:
                alive[j] = False
                after[i] = end
                if end < b - a:
                    before[end] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return a + np.flatnonzero(alive)

    def learn(self, new: list[str]) -> None:
        """Encodes stretches and remembers them."""
        text = np.frombuffer("\0".join(new).encode("utf-32-le"), np.uint32)
        size = np.array([len(s) for s in new])
        first = np.cumsum(size + 1) - size - 1
        # A zero inside a stretch is a character like any other: only those between stretches are left out.
        starts, pieces = self.relax(text)
        between = np.zeros(len(text) + 1, bool)
        between[(first + size)[:-1]] = True
        inside = ~between[starts]
        starts, pieces = starts[inside], pieces[inside]
        own = np.searchsorted(first, starts, "right") - 1
        ids, bytes_each = self.model["ids"][np.maximum(pieces, 0)], np.ones(len(pieces), np.int64)
        if len(strange := np.flatnonzero(pieces < 0)):
            spelled = [self.model["of_byte"][np.frombuffer(chr(x).encode(), np.uint8)] for x in text[starts[strange]].tolist()]
            bytes_each[strange] = [len(x) for x in spelled]
            at = np.repeat(np.cumsum(bytes_each) - bytes_each, np.where(pieces < 0, bytes_each, 0))
            within = np.arange(len(at)) - np.repeat(np.cumsum(bytes_each[strange]) - bytes_each[strange], bytes_each[strange])
            ids = np.repeat(ids, bytes_each)
            ids[at + within] = np.concatenate(spelled)
        count = np.bincount(own, weights=bytes_each, minlength=len(new)).astype(np.int64)
        self.chars += int(size.sum())
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(count)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and their offsets."""
        if len(self.known) > MEMORY or self.chars > MEMORY_CHARS:
            self.forget()
        rows = [STRETCH.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        stretches = list(chain.from_iterable(rows))
        if new := list(set(stretches).difference(self.known)):
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        count = self.begin[which + 1] - self.begin[which]
        total = np.r_[0, np.cumsum(count)]
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[which] - total[:-1], count)]
        return ids, total[np.cumsum([0, *map(len, rows)])]


def decode(table: list[bytes], ids: np.ndarray) -> str:
    """The text of ids."""
    text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """docs with tokens (ids), n_tokens and decoded added; with digests, doc_id with SHA-256 of both and whether the round trip was exact."""
    model = read_model(path)
    plain = [] if digests else [c for c in docs.columns if c not in ("tokens", "n_tokens", "decoded")]

    def run(batches):
        encoder = Encoder(model)
        for batch in batches:
            data, offsets = C.column_bytes(batch.column("text"))
            for a, b in C.blocks(offsets, 1 << 20):
                rows = batch.slice(a, b - a)
                texts = rows.column("text").to_pylist()
                flat, at = encoder.encode(texts)
                ids = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                back = [None if t is None else decode(model["table"], x) for t, x in zip(texts, ids, strict=True)]
                n = pa.array(np.diff(at))
                if digests:
                    sha = lambda many: pa.array([hashlib.sha256(x).hexdigest() for x in many])
                    yield pa.record_batch([rows.column("doc_id"), n, sha([x.astype("<i4").tobytes() for x in ids]), sha([(t or "").encode() for t in back]), pa.array([x == y for x, y in zip(texts, back, strict=True)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
                else:
                    tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                    yield pa.record_batch([*(rows.column(c) for c in plain), tokens, n, pa.array(back, pa.string())], [*plain, "tokens", "n_tokens", "decoded"])

    if digests:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    schema = T.StructType([docs.schema[c] for c in plain])
    return docs.select(*plain).mapInArrow(run, schema.add("tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("decoded", T.StringType()))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(C.table(spark, sf_dir, "documents"), digests=True)
