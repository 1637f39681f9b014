"""MinHash, substring and suffix-array dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, decontaminate, minhash, repeats, substrings, suffixes

from .fixtures import by_id, frame, texts


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def near_duplicates(rows):
    sets = {}
    for k, text in rows:
        w = words_of(text, True)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = texts(seed)
    got = by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept")
    assert got == near_duplicates(rows)


def chain():
    """A chain of texts each close to the next only, and many close to none that share most bands."""
    rng = random.Random(3)
    base = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base)))
        base = list(base)
        for j in range(10 * k % 120, 10 * k % 120 + 3):
            base[j] = f"r{k}_{j}"
    for k in range(25):
        other = [f"z{j}" for j in range(120)]
        for j in rng.sample(range(120), 6):
            other[j] = f"y{k}_{j}"
        rows.append((100 + k, " ".join(other)))
    return rows


def test_chains_and_crowds(spark):
    rows = chain()
    assert by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept") == near_duplicates(rows)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "p q r s t u"), (3, "a b c d e f"), (4, "P q r s t u"), (5, None)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, False), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)}
    left = minhash.without_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 5), (True, 0)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_estimate_and_signature():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    minima = minhash.minima_of([np.sort(shared), np.sort(np.r_[shared, own])], minhash.HASHES)
    keys, packed = minhash.band_keys(minima), minhash.packed(minima)
    assert (keys[0] == keys[1]).sum() > 3
    same = sum(128 // 4 - bin(((int(a) ^ int(b)) | ((int(a) ^ int(b)) >> 1)) & 0x5555555555555555).count("1") for a, b in zip(packed[0].view(np.uint64), packed[1].view(np.uint64), strict=True))
    assert abs((same / 128 - 0.25) / 0.75 - 0.8) < 0.2


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = list(range(1100))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {k: find(k) for k in {x for link in links if link[0] != link[1] for x in link}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def without_word_repeats(rows):
    first, out = {}, {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        w = words_of(text)
        gone = set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (k, i)) < (k, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
@pytest.mark.parametrize("seed", [1, 4])
def test_substrings(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = texts(seed)
    assert by_id(substrings.without_repeats(frame(spark, rows)), "n_words", "n_removed", "kept_sha256") == without_word_repeats(rows)


def without_byte_matches(rows):
    first, out = {}, {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], k) < k:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[k] = (len(b), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
@pytest.mark.parametrize("seed", [1, 4])
def test_suffixes(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(suffixes.Levels, "BASE", 64)
    rows = texts(seed)
    assert by_id(suffixes.without_matches(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_byte_matches(rows)


def test_long_runs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LONGEST", 40)
    rows = [(1, "ab" + "x" * 500 + "cd"), (2, "ef" + "x" * 300 + "gh"), (3, "x" * 400)]
    assert by_id(suffixes.without_matches(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_byte_matches(rows)


def test_rows_that_repeat_an_id(spark):
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(None, long), (5, long), (5, long), (5, long + " more"), (7, long)]
    words = substrings.without_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id or 99), r.n_removed) for r in words) == [(5, 0), (5, 0), (5, 0), (7, 40), (99, 40)]
    cut = suffixes.cleaned(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id or 99), r.text, r.n_chars) for r in cut.collect()) == [(5, long, len(long)), (5, long, len(long)), (5, long + " more", len(long) + 5), (7, "", 0), (99, "", 0)]
    assert substrings.without_repeats(frame(spark, [])).count() == suffixes.without_matches(frame(spark, [])).count() == suffixes.cleaned(frame(spark, [])).count() == 0


def test_self_similar_texts(spark):
    """Thue-Morse texts and their complements: a polynomial mod 2**64 takes them for equal."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, morse), (2, other), (3, " ".join(["x"] * 30 + [morse] + ["y"] * 30)), (4, " ".join(["x"] * 30 + [other] + ["y"] * 30)), (5, " ".join(morse)), (6, " ".join(other))]
    assert by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept") == near_duplicates(rows)
    assert by_id(substrings.without_repeats(frame(spark, rows)), "n_words", "n_removed", "kept_sha256") == without_word_repeats(rows)
    assert by_id(suffixes.without_matches(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_byte_matches(rows)
    items = frame(spark, [(7, morse + " " + " ".join(morse[:20]))]).withColumnRenamed("doc_id", "item_id")
    hit = {r.doc_id: r._hit for r in decontaminate.matched(frame(spark, [(1, " ".join([morse, *morse[:20]])), (2, " ".join([other, *morse[:11]]))]), items).collect()}
    assert hit == {1: 21, 2: 0}


def test_levels_find_what_one_scan_finds():
    rng = np.random.default_rng(2)
    levels = suffixes.Levels(suffixes.bytes_kind())
    levels.BASE = 8
    found, every = [], []
    for _ in range(30):
        n = int(rng.integers(1, 40))
        batch = [np.array([b"k%d" % k for k in rng.integers(0, 200, n)], "S50"), rng.integers(0, 50, n), np.zeros(n, np.int64), np.arange(n)]
        every.append(batch)
        found += levels.put([c.copy() for c in batch])
        assert all((level[0][1:] >= level[0][:-1]).all() for level in levels.levels.values())
    found += list(levels.close())
    _, again = suffixes.scanned(every)
    flat = lambda parts: sorted((int(d), int(s)) for f in parts for d, s in zip(f[2], f[4], strict=True))
    assert flat(found) == flat([again])


def test_extension_stops_where_words_differ():
    kind = substrings.words_kind(6, 2)
    words = lambda text: np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    one, other = "abcXYdef", "zbcXYdeq"
    first = np.array([0, len(one), len(one) + len(other)])
    x = repeats.Contexts(np.array([1, 1], np.uint64), np.array([1, 2]), np.zeros(2, np.int64), np.array([10, 20]), np.array([3, 3]), np.array([3, 3]), words(one + other), first)
    index = substrings.Extended(kind)
    index.add(x)
    (found,) = index.close()
    assert [c.tolist() for c in found[2:]] == [[2], [0], [21], [1]]


@pytest.mark.parametrize("contents", [1, 3])
def test_many_contents_of_one_anchor(spark, contents, monkeypatch):
    """A passage in ever other surroundings: over CONTENTS of them go by whole windows."""
    monkeypatch.setattr(repeats, "CONTENTS", contents)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(24)]
    rows = [(k, " ".join([f"u{rng.randrange(3)}" for _ in range(rng.randrange(30))] + passage + [f"v{rng.randrange(3)}" for _ in range(rng.randrange(30))])) for k in range(40)]
    assert by_id(substrings.without_repeats(frame(spark, rows)), "n_words", "n_removed", "kept_sha256") == without_word_repeats(rows)
    assert by_id(suffixes.without_matches(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_byte_matches(rows)


def test_buckets_follow_the_size_of_the_table(spark, tmp_path):
    from plumbline.llm import common

    frame(spark, texts(1), extra=False).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(docs) == given
    assert given < common.partitions(docs, 1024) <= 1 + sum(f.stat().st_size for f in tmp_path.glob("d/*.parquet")) // 1024
    rows = texts(1)
    original, common.partitions = common.partitions, lambda df: original(df, 4096)
    try:
        assert by_id(substrings.without_repeats(docs), "n_words", "n_removed", "kept_sha256") == without_word_repeats(rows)
    finally:
        common.partitions = original


@pytest.mark.parametrize("kind", [suffixes.bytes_kind(), suffixes.bytes_kind(20, 10), substrings.words_kind(), substrings.words_kind(7, 2)])
def test_sides_keep_every_shared_window(kind):
    """Runs of different contents that share a window may do so by their sides, too, and few others may."""
    from plumbline.llm import common

    rng = random.Random(3)
    unit = 1 if kind.unit == "byte" else 3
    words = lambda n, of: "".join(rng.choice(of) + " " * (kind.unit == "word") for _ in range(n))
    shared = [words(kind.length + rng.randrange(3 * unit), "abcdefgh") for _ in range(20)]
    rows = [words(rng.randrange(90), "ijklmnop") + rng.choice(shared) + words(rng.randrange(90), "qrstuvwx") for _ in range(200)]
    # Anchors in common, but no window.
    rows += [words(60, "ijklmnop") + shared[0][: unit * (kind.length - 1)] + words(60, "qrstuvwx") for _ in range(50)] + ["a " * 200, "a " * 150 + "b"]
    data, offsets = common.column_bytes(pa.array(rows))
    codes, before, wide = repeats.tokens(kind.unit, data, offsets)
    anchor, content, row, start, size, sides = repeats.runs(codes, before, wide, kind)
    key, low = repeats._key(anchor, content)
    order = np.lexsort((low, key))
    may = np.zeros(len(order), bool)
    may[order] = repeats.may_share(key[order], low[order], sides[order])
    tokens = [list(r.encode()) if kind.unit == "byte" else r.split() for r in rows]
    holders = {}
    for k in range(len(order)):
        for at in range(start[k], start[k] + size[k]):
            holders.setdefault(tuple(tokens[row[k]][at : at + kind.length]), set()).add(k)
    must = {k for found in holders.values() if len({int(content[k]) for k in found}) > 1 for k in found}
    assert must and all(may[k] for k in must)
    assert may.sum() < len(may) / 2


def test_anchors_that_coincide_stay_closed(spark):
    """Texts with 24 bytes in common, and so an anchor, but no 50: nothing of them is sent again."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common_part = letters(30)
    rows = [(k, letters(300) + common_part + letters(300)) for k in range(30)] + [(50, (some := letters(200)) + letters(90)), (51, letters(90) + some)]
    kind, docs = suffixes.bytes_kind(), repeats.keyed(frame(spark, rows, extra=False))
    facts = repeats.settle(repeats.find_runs(docs, kind, 3).repartitionById(3, "p"), kind, 3, False).collect()
    opened = {int(d) for f in facts if f.kind in (repeats.OPEN, repeats.SPREAD) for d in repeats.unpacked(bytes(f.payload), repeats.FACT)[0]}
    assert opened == {50, 51}
    assert by_id(suffixes.without_matches(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_byte_matches(rows)


def test_only_sets_of_like_size_are_met(spark):
    """Of a bucket, members stay that could be alike to one of another component by their size: at least all pairs of a share of SHARE."""
    sizes = [1, 3, 4, 30, 40, 41, 75, 100, 300, 1000, 5000, 7500, 10000]
    pairs = [(a, b) for a in sizes for b in sizes if a <= b]
    rows = [(k, 2 * k + i, size, 2 * k + i, 2 * k) for k, pair in enumerate(pairs) for i, size in enumerate(pair)] + [(-1, 900, 50, 7, 7), (-1, 901, 50, 7, 7), (-1, 902, 500, 8, 7)]
    mixed = spark.createDataFrame(rows, "band long, node long, size long, component long, largest long")
    left = minhash.of_like_size(mixed)
    assert left.columns == mixed.columns
    kept = [r.band for r in left.collect()]
    for k, (a, b) in enumerate(pairs):
        assert kept.count(k) in (0, 2)
        assert kept.count(k) == 2 or 100 * a < minhash.SHARE * b
        assert kept.count(k) == 0 or 100 * a >= 55 * b
    assert -1 not in kept


@pytest.mark.parametrize("small", [1, 4, 1000])
def test_small_and_large_buckets_find_the_same(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    if small == 1000:
        monkeypatch.setattr(minhash, "met_in_blocks", None)
    rows = chain()
    assert by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept") == near_duplicates(rows)


def test_pairs_of_small_buckets_are_listed_once(spark):
    """Pairs in several buckets, of one component, or compared already."""
    mixed = spark.createDataFrame([(band, node, node // 2) for band in (1, 2, 3) for node in (2, 3, 4, 6)] + [(4, 3, 1), (4, 9, 4)], "band long, node long, component long")
    settled = spark.createDataFrame([(2, 4), (6, 3), (1, 9)], "u long, v long")
    assert sorted(map(tuple, minhash.unsettled(mixed, settled).collect())) == [(4, 3), (6, 2), (6, 4), (9, 3)]


@pytest.mark.parametrize("most", [1 << 10, minhash.FILTER_MOST])
def test_texts_of_other_documents_are_left(spark, most, monkeypatch):
    monkeypatch.setattr(minhash, "FILTER_MOST", most)
    docs = spark.range(-30000, 30000).select("id", F.concat(F.lit("t"), "id").alias("text")).unionByName(spark.createDataFrame([(None, "none"), (7, None)], "id long, text string")).withColumnRenamed("id", "doc_id")
    some = {*range(-30000, 30000, 17), 7, 10**15}
    got = [(r.node, r.text) for r in minhash.texts_of(docs, spark.createDataFrame([(k,) for k in some for _ in range(2)], "node long")).collect()]
    assert (7, None) in got and {k for k, _ in got} >= some - {10**15}
    assert all(text in (None, f"t{k}") for k, text in got) and len(got) == len({*got})
    assert len(some) < len(got) < (10_000 if most > 1 << 10 else 20_000)
