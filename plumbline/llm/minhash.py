"""Near-duplicates by b-bit MinHash, with links confirmed on the full shingle sets.

1. Every document becomes its set of distinct WORDS-word shingles (64-bit hashes), HASHES minima, BANDS band
   keys, and a packed signature of BITS low bits of each minimum. Equal sets are one class, named by its
   smallest doc_id; only classes go on, so copies never meet each other.
2. Classes that share a band key are candidates. In each bucket every class meets the bucket's leader, not
   every other class. These pairs are estimated from the packed signatures by bit counts, corrected for
   chance collisions of low bits, and those far below the threshold are left to steps 4 and 5.
3. The others are confirmed on the full sets, and confirmed links are joined into components.
4. In a bucket of at most SMALL members that still holds several components, the pairs between these are listed.
   A pair mostly shares several buckets, and many are confirmed or refuted in step 3 already: each of the others is
   compared once, on the full sets, whatever the estimate says.
5. In a larger bucket that still holds several components, the members outside the largest are held against all
   members of other components, on the full sets, block against block. A task returns only the links that
   join its components, so what comes out grows with the members and not with their pairs.
In steps 4 and 5 members whose size alone rules out every member of another component are left out: sets alike by
SHARE differ by no more than that in size.

So of the candidates of step 2 no link between components goes unseen: an estimate only decides where a pair is
compared. With BANDS bands of 4 minima, a pair of similarity 0.75 shares no band with probability 5e-6.

Edge cases: a null, empty or wordless text has an empty set, n_shingles 0 and is linked with nothing. Fewer
words than WORDS make one shingle. Rows that repeat a doc_id are one document: what one is linked with, all
are. A row with a null doc_id takes no part: component_id null, kept false. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

WORDS, SHARE = 5, 75
HASHES, BANDS, BITS = 128, 32, 2
#: Standard errors of an estimate by which it may fall below the threshold before the pair is left to what follows.
ERRORS = 5
#: Members that pass by one copy of a leader's set.
SPREAD = 1024
#: Members of a bucket up to which its pairs are listed.
SMALL = 16
#: Bits of the filter of texts for each node that is to pass, and in all.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Members, and shingles, that a block holds on average.
BLOCK, WEIGHT = 256, 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    data = C.lower_table()[data]
    starts, ends, before = C.word_bounds(data, offsets, C.byte_class("space"))
    words = C.word_hashes(data, starts, ends)
    grams = C.gram_hashes(words, WORDS)
    out = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(C.span_hashes(words, np.array([a]), np.array([b])) if b > a else np.zeros(0, C.U64))
    return out


def minima_of(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """(rows, hashes) minima of the sets, none of which is empty."""
    all_hashes = (np.concatenate(sets) >> C.U64(32)).astype(np.uint32)
    first = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    codes = C.mixed(np.arange(1, 2 * hashes + 1, dtype=C.U64))
    minima = np.empty((len(sets), hashes), np.uint32)
    for k in range(hashes):
        minima[:, k] = np.minimum.reduceat(all_hashes * np.uint32(codes[2 * k] | C.U64(1)) + np.uint32(codes[2 * k + 1] >> C.U64(32)), first)
    return minima.astype(C.U64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys."""
    keys = np.zeros((len(minima), BANDS), C.U64)
    for k in range(HASHES // BANDS):
        keys = C.mixed(keys + minima[:, k :: HASHES // BANDS])
    return C.mixed(keys + np.arange(BANDS, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15)).view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """(rows, longs): BITS low bits of each minimum."""
    each = 64 // BITS
    low = (minima ^ (minima >> C.U64(16))) & C.U64((1 << BITS) - 1)
    return (low.reshape(len(minima), -1, each) << (np.arange(each, dtype=C.U64) * C.U64(BITS))).sum(2, dtype=C.U64).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set, null if empty), bands and sig of every row of docs(doc_id, text)."""

    def make(batch):
        data, offsets = C.column_bytes(batch.column("text"))
        for a, b in C.blocks(offsets):
            sets = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            d1, d2 = np.zeros((2, b - a), np.int64)
            bands, sig = [None] * (b - a), [None] * (b - a)
            if len(full):
                some = [sets[k] for k in full]
                minima = minima_of(some, HASHES)
                for k, keys, low in zip(full, band_keys(minima), packed(minima), strict=True):
                    bands[k], sig[k] = keys, low
                joined, first = np.concatenate(some), np.r_[0, np.cumsum(size[full])[:-1]]
                for out, seed in ((d1, 0x51), (d2, 0xA7)):
                    out[full] = np.add.reduceat(C.mixed(joined, seed), first).view(np.int64)
            empty = size == 0
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(d1, mask=empty), pa.array(d2, mask=empty), pa.array(bands, longs), pa.array(sig, longs)], ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    return C.map_texts(docs, make, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>")


def likely(one, other, hashes: int):
    """Column: whether two packed signatures of so many minima leave the threshold within reach.

    The similarity is estimated by bit counts and corrected for chance, which makes 1 / 2**BITS of unequal minima look equal.
    """
    differ = F.lit(0)
    for k in range(hashes * BITS // 64):
        x = one[k].bitwiseXOR(other[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    alike = chance + (1 - chance) * SHARE / 100
    error = (alike * (1 - alike) / hashes) ** 0.5 / (1 - chance)
    return ((1 - differ / hashes) - chance) / (1 - chance) >= SHARE / 100 - ERRORS * error


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the rows whose doc_id is in nodes(node), a written table, and of some others: a join with the nodes follows, to which the texts of most others need not be sent.

    A row passes where its hash is one of a node's. Where nodes are more than FILTER_MOST allows for, more others pass.
    """
    size, most = 1 << 15, min(FILTER_BITS * nodes.count(), FILTER_MOST)
    while size < most:
        size *= 2
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(size)) + 1
    slots = nodes.select(slot("node").alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k"))
    bits = np.zeros(size >> 3, np.uint8)
    for row in slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        bits[(row.k - 1) << 12 : row.k << 12] = np.frombuffer(row.bits, np.uint8)

    def make(batch):
        at = batch.column("slot").to_numpy() - 1
        yield batch.select(["node", "text"]).filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))

    return C.map_texts(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text", slot("doc_id").alias("slot")), make, "node long, text string")


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= SHARE * union, and share anything."""
    if not len(one) or not len(other) or 100 * min(len(one), len(other)) < SHARE * max(len(one), len(other)):
        return False
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int((other[at] == one).sum())
    return both > 0 and 100 * both >= SHARE * (len(one) + len(other) - both)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(u, v) whose documents' full sets are alike; v is the leader of many u.

    A leader's set is made once for SPREAD of its members, which pass by it as a stream.
    """
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts"))
    leaders = salts.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("v").alias("node"))
    members = pairs.join(salts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("u").alias("node"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    rows = leaders.unionByName(members).join(texts_of(docs, nodes), "node").repartition("v", "salt").sortWithinPartitions("v", "salt", "kind")

    def run(batches):
        at, held = None, []
        for batch in batches:
            data, offsets = C.column_bytes(batch.column("text"))
            v, salt, kind, node = (batch.column(k).to_pylist() for k in ("v", "salt", "kind", "node"))
            links = []
            for a, b in C.blocks(offsets):
                for i, mine in enumerate(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    if (v[i], salt[i]) != at:
                        at, held = (v[i], salt[i]), []
                    if not kind[i]:
                        held.append(mine)
                    elif any(alike(mine, x) for x in held):
                        links.append((node[i], v[i]))
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return rows.select("v", "salt", "kind", "node", "text").mapInArrow(run, "u long, v long")


def _packed_sets(rows: DataFrame) -> DataFrame:
    """rows(band, kind, part, parts, node, component, text) as one row for each band, kind and part, with all its sets as bytes."""
    keys = ["band", "kind", "part", "parts"]
    schema = pa.schema([("band", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        at, held = None, []

        def out():
            nodes, components, sets = zip(*held, strict=True)
            payload = b"".join([np.array([len(sets)], np.int64).tobytes(), np.array(nodes, np.int64).tobytes(), np.array(components, np.int64).tobytes(), np.array([len(x) for x in sets], np.int64).tobytes(), np.concatenate(sets).tobytes()])
            return pa.record_batch([pa.array([x], t) for x, t in zip((*at, payload), schema.types, strict=True)], schema=schema)

        for batch in batches:
            data, offsets = C.column_bytes(batch.column("text"))
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            node, component = (batch.column(k).to_pylist() for k in ("node", "component"))
            for a, b in C.blocks(offsets):
                for i, mine in enumerate(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    if key[i] != at:
                        if held:
                            yield out()
                        at, held = key[i], []
                    if len(mine):
                        held.append((node[i], component[i], mine))
        if held:
            yield out()

    dealt = rows.repartition("band", "kind", "part").sortWithinPartitions("band", "kind", "part")
    return dealt.select(*keys, "node", "component", "text").mapInArrow(run, "band long, kind int, part int, parts int, payload binary")


def _sets_of(payload: bytes) -> tuple[np.ndarray, ...]:
    """(components, sizes, sets end to end) of a packed row."""
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    components, sizes = (np.frombuffer(payload, np.int64, n, 8 + 8 * n * k) for k in (1, 2))
    return components, sizes, np.frombuffer(payload, C.U64, offset=8 + 24 * n)


def met_in_blocks(mixed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, the table of blocks behind them): links u, v between the components of mixed(band, node, size, component, largest) that alike sets of one bucket join.

    The sets of a bucket's members are packed in blocks, and so are those of its members outside the largest
    component. Each of the latter blocks is sent to every one of the former, in whose task all sets of both are
    compared in full. Only links that join what the task has not joined yet come out: fewer than it has components.
    """
    parts = lambda rows, name: rows.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / WEIGHT)).cast("int").alias(name))
    outside = F.col("component") != F.col("largest")
    counted = mixed.join(parts(mixed, "parts"), "band").join(parts(mixed.where(outside), "minor_parts"), "band")
    places = F.array(
        F.struct(F.lit(0).alias("kind"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")),
        F.when(outside, F.struct(F.lit(1).alias("kind"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("minor_parts")).cast("int").alias("part"))),
    )
    dealt = counted.select("band", "parts", "node", "component", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("x")).select("band", "parts", "node", "component", "x.*")
    blocks = C.written(_packed_sets(dealt.join(texts_of(docs, mixed.select("node")), "node")), "blocks")
    sent = blocks.where("kind = 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = blocks.where("kind = 0").unionByName(sent.select(*blocks.columns)).repartition("band", "part").sortWithinPartitions("band", "part", "kind")

    def run(batches):
        at, block, root = None, None, {}

        def top(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                band, part, kind, payload = (batch.column(k)[i].as_py() for k in ("band", "part", "kind", "payload"))
                components, sizes, flat = _sets_of(payload)
                first = np.r_[0, np.cumsum(sizes)]
                if (band, part) != at:
                    at, block, root = (band, part), None, {}
                if kind == 0:
                    vocabulary, own = np.unique(flat, return_inverse=True)
                    block = components, sizes, vocabulary, own, first[:-1]
                    continue
                if block is None:
                    continue
                theirs, their_sizes, vocabulary, own, their_first = block
                place = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                known = vocabulary[place] == flat
                for k, component in enumerate(components.tolist()):
                    some = place[first[k] : first[k + 1]][known[first[k] : first[k + 1]]]
                    if not len(some):
                        continue
                    has = np.zeros(len(vocabulary), np.int64)
                    has[some] = 1
                    both = np.add.reduceat(has[own], their_first)
                    near = (100 * both >= SHARE * (their_sizes + sizes[k] - both)) & (both > 0) & (theirs != component)
                    for other in np.unique(theirs[near]).tolist():
                        x, y = top(component), top(other)
                        if x != y:
                            root[x] = y
                            links.append((component, other))
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return met.select("band", "part", "kind", "payload").mapInArrow(run, "u long, v long"), blocks


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.written(described(docs), "sets")
    known = rows.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    is_head = F.col("doc_id") == F.col("node")
    named = C.written(known.join(classes, ["d1", "d2"]).select("doc_id", "node", "n_shingles", F.when(is_head, F.col("bands")).alias("bands"), F.when(is_head, F.col("sig")).alias("sig")), "classes")
    heads = named.where("bands IS NOT NULL")
    sigs = heads.select("node", "sig").distinct()
    in_bands = heads.select("node", "n_shingles", F.explode("bands").alias("band")).groupBy("band", "node").agg(F.max("n_shingles").alias("size"))
    crowded = in_bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = C.written(in_bands.join(crowded, "band"), "buckets")

    # Rows that repeat a doc_id can stand for several sets: those are linked as they are.
    twice = named.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).join(heads.select(F.col("node").alias("u")), "u", "left_semi")
    # The member that meets most others over all its buckets leads: in a crowd of near-copies mostly one text, the least changed.
    crowd = members.groupBy("node").agg(F.sum("n").alias("crowd"))
    rank = F.col("crowd") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    leader = members.join(crowd, "node").groupBy("band").agg(F.max_by("node", rank).alias("lead"))
    pairs = members.join(leader, "band").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    pairs = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v")
    pairs = C.written(pairs.where(likely(F.col("a"), F.col("b"), HASHES)).select("u", "v").distinct(), "pairs")
    label = joined(None, C.written(confirmed(pairs, docs), "links").unionByName(twice))

    small = _mixed(members.where(F.col("n") <= SMALL), label)
    if small.limit(1).count():
        listed = C.written(unsettled(small, pairs), "pairs")
        links = C.written(confirmed(listed, docs), "links")
        C.dropped(spark, listed, small)
        label = joined(label, links)
    mixed = _mixed(members.where(F.col("n") > SMALL), label)
    if mixed.limit(1).count():
        links, blocks = met_in_blocks(mixed, docs)
        links = C.written(links, "links")
        C.dropped(spark, blocks, mixed)
        label = joined(label, links)
    C.dropped(spark, members, pairs)
    by_node = named.select("doc_id", "node").distinct().join(label, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    by_doc = by_node.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def unsettled(mixed: DataFrame, settled: DataFrame) -> DataFrame:
    """(u, v), each once: the pairs of mixed(band, node, component, ...) in one bucket and of two components, without those in settled(u, v)."""
    one, other = (mixed.select("band", F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in "uv")
    pairs = one.join(other, "band").where("u > v AND of_u <> of_v").select("u", "v").distinct()
    return pairs.join(settled.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """band, node, size, component and largest for the members of buckets that hold several components."""
    tagged = members.join(label, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("component"))
    parts = tagged.groupBy("band", "component").agg(F.count("*").alias("k"))
    several = parts.groupBy("band").agg(F.count("*").alias("kinds"), F.max_by("component", F.col("k") * (1 << 20) + F.pmod(F.xxhash64("component"), F.lit(1 << 20))).alias("largest")).where("kinds > 1")
    every = C.written(tagged.join(several.select("band", "largest"), "band"), "mixed")
    found = C.written(of_like_size(every), "mixed")
    C.dropped(members.sparkSession, every)
    return found


#: Steps of size in which sets that can be alike lie apart at most.
STEPS = 4


def of_like_size(mixed: DataFrame) -> DataFrame:
    """The rows of mixed(band, size, component, ...) whose bucket has another component with a set that could be alike by its size alone."""
    # Just over the exact step, so that rounding parts no two sets of a share of exactly SHARE.
    step = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) * (STEPS * (1 - 1e-9) / np.log(100 / SHARE).item())).cast("int")
    rows = mixed.withColumn("step", step)
    around = rows.select("band", "component", F.explode(F.sequence(F.col("step") - STEPS, F.col("step") + STEPS)).alias("step"))
    several = around.groupBy("band", "step").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return rows.join(several.select("band", "step"), ["band", "step"], "left_semi").select(*mixed.columns)


def joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label(node, component) with links(u, v) added: only the components they join are gone through again."""
    if label is None:
        return C.written(components(links), "label")
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    moved = C.written(components(between), "moved").select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(label.select("node"), "node", "left_anti")
    return C.written(old.unionByName(new), "label")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows whose component has a smaller doc_id; rows equal in doc_id and text stay once."""
    gone = near_duplicates(docs).where(F.col("component_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id IS NULL"))


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) AS c USING (doc_id)
"""
