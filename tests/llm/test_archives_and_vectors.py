"""WARC archives and nearest neighbours on small tables."""

import hashlib
import io
import random

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, neighbours, warc


def round_trip(spark, rows):
    folder = common.new_path(spark, "test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1)).repartition(3)
    archives = common.written(warc.write(warc.roles(pages), folder), "archives")
    assert (archives.agg(F.sum("n_records")).first()[0] or 0) == len(rows)
    return warc.read(archives).collect()


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(1)
    page = lambda n: "".join(rng.choice("<p>é ab\n") for _ in range(n))
    same, short = page(300), page(60)
    rows = [(k, f"http://x/{k}", page(rng.choice([0, 50, 900, 4000]))) for k in range(60)]
    rows += [(100, "u", same), (90, None, same), (95, "a\r\nb", same), (110, "u", short), (111, "u", short), (120, "u", None), (121, "u", ""), (None, "u", page(200)), (130, "u", page(400_000)), (90, None, same)]
    got = round_trip(spark, rows)
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for k, _, html in rows:
        size = len((html or "").encode())
        first = min((x for x, _, h in rows if x is not None and size >= 100 and (h or "") == html), default=k)
        again = size >= 100 and first != k
        want.append((k, size, digest(html), "revisit" if again else "response", first if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    texts = {k: html for k, _, html in rows}
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    assert len({r.archive for r in got}) > 3


def test_archives_of_dead_attempts_are_not_read(spark):
    folder = common.new_path(spark, "test")
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 30) for k in range(20)], "page_id long, url string, html string")
    common.written(warc.write(warc.roles(pages), folder), "dead")
    archives = common.written(warc.write(warc.roles(pages), folder), "archives")
    assert sorted(r.page_id for r in warc.read(archives).collect()) == list(range(20))


def test_many_records_and_long_ones_cross_slices(monkeypatch):
    rng = random.Random(4)
    records = [one(k, rng.randbytes(n)) for k, n in enumerate([10] * 300 + [200_000, 3, 70_000] + [warc.SLICE] * 3)]
    raw = archive(records)
    found = list(warc.frames(raw, "x"))
    assert [r for _, r in found] == records
    for size in (5, 1000):
        monkeypatch.setattr(warc, "SLICE", size)
        assert list(warc.frames(io.BytesIO(raw), "x")) == found


def test_reading_is_linear_in_the_number_of_records():
    """Bytes handed to the decoder twice (what is left of a slice) stay within a slice a record."""
    raw, read = archive([one(k, random.Random(k).randbytes(300)) for k in range(4000)]), []

    class Source(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    assert sum(1 for _ in warc.frames(Source(raw), "x")) == 4000
    assert max(read) <= warc.DICT_BYTES and len(read) <= len(raw) / warc.SLICE + 5


def test_empty(spark):
    assert round_trip(spark, []) == []


def archive(records):
    sink = io.BytesIO()
    warc.archive(iter(records), sink)
    return sink.getvalue()


def one(page_id=1, payload=b"hello"):
    return warc.record(page_id, "http://x", payload, hashlib.sha256(payload).hexdigest(), "response", None)


def test_damage_is_found():
    raw = archive([one(k) for k in range(5)])
    assert [warc.parse(r, "x")["fields"]["warc-page-id"] for _, r in warc.frames(memoryview(raw), "x")] == list("01234")
    for bad in (raw[8:], raw[:-3], raw[:20], raw + b"rest", b""):
        with pytest.raises(warc.Invalid):
            list(warc.frames(memoryview(bad), "x"))
    flipped = bytearray(raw)
    flipped[-20] ^= 255
    with pytest.raises(warc.Invalid):
        [warc.parse(r, "x") for _, r in warc.frames(memoryview(bytes(flipped)), "x")]
    record = one()
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"hello", b"hullo"), (b"hello", b"hell"), (b"WARC-Date", b"WARC-Data"), (b"WARC-Type: response", b"WARC-Type response")):
        with pytest.raises(warc.Invalid):
            warc.parse(record.replace(old, new), "x")


def vectors(seed, n, d, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 1.5, (n, 1))
    x[:hot] = x[0]
    return [(k, x[k].tolist()) for k in range(n)]


def exact(rows, k):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in sound:
        if i % 20 == 0:
            out[i] = sorted(((float(q @ x), -j) for j, x in sound if j != i), reverse=True)[:k]
    return out


@pytest.mark.parametrize("hot", [0, 200])
def test_recall(spark, hot):
    rows = vectors(1, 700, 16, hot)
    table = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(1)))
    got = {}
    for r in neighbours.search(table.where("vec_id % 20 = 0"), table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want, hits, scores = exact(rows, 20), 0, dict(rows)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        assert all(abs(s - np.dot(scores[q], scores[v])) < 1e-9 for v, s in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in found.values()} & {-j for _, j in want[q]})
    assert len(got) == len(want) and hits / (20 * len(want)) >= 0.9


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (None, [1.0, 1.0]), (3, [1.0]), (4, []), (2, [0.5, -0.5])]
    table = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(table.where("vec_id % 20 = 0"), table).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]  # an id is listed once
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0
    assert neighbours.search(table.where("vec_id % 20 = 7"), table).count() == 0


def ranked(spark, rows, k=20):
    table = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = {}
    for r in sorted(neighbours.search(table.where("vec_id % 20 = 0"), table, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_copies_come_in_the_order_of_their_ids(spark):
    same = np.random.default_rng(8).normal(size=37).tolist()
    got = ranked(spark, [(k, same) for k in range(70)])
    assert {q: [v for v, _ in found] for q, found in got.items()} == {q: [v for v in range(22) if v != q][:20] for q in (0, 20, 40, 60)}
    assert len({s for found in got.values() for _, s in found}) == 1


def test_rows_that_repeat_an_id_are_listed_once(spark):
    rng = np.random.default_rng(9)
    rows = [(0, rng.normal(size=5).tolist()) for _ in range(40)] + [(k, rng.normal(size=5).tolist()) for k in range(1, 16)]
    got = ranked(spark, rows)[0]
    assert sorted(v for v, _ in got) == list(range(1, 16))
    product = lambda q, v: reduce(lambda s, x: s + x[0] * x[1], zip(q, v, strict=True), 0.0)  # noqa: E731  in the order of components
    best = {k: max(product(q, v) for i, q in rows if i == 0) for k, v in rows[40:]}
    assert got == sorted(((k, s) for k, s in best.items()), key=lambda x: (-x[1], x[0]))


def test_norms_that_overflow_or_vanish(spark):
    rows = [(0, [1e-200, 0.0, 0.0, 0.0]), (20, [1e200, 1e200, 0.0, 0.0]), (40, [5e-324, 0.0, 0.0, 0.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [-1e200, 1e200, 0.0, 1.0]), (3, [1e308, 1e308, 1e308, 1e308]), (4, [2.0, -1.0, 0.0, 0.0])]
    got = ranked(spark, rows)
    assert [v for v, _ in got[0]] == [3, 20, 4, 1, 40, 2]
    assert got[20][0] == (3, float("inf")) and [v for v, _ in got[20][1:]] == [1, 4, 0, 40]  # 2 cancels to no number
    assert sorted(v for v, _ in got[40]) == [0, 1, 2, 3, 4, 20]


def test_each_length_is_searched_among_its_own(spark):
    rows = [*vectors(3, 60, 4), *[(k + 100, v) for k, v in vectors(4, 30, 3)]]
    table = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(table.where("vec_id % 20 = 0"), table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == [0, 20, 40, 100, 120]
    assert all(len(v) == 20 and all((x >= 100) == (q >= 100) for x in v) for q, v in got.items())


def test_blocks_follow_from_the_row_count(spark, monkeypatch):
    many, packed = [], neighbours.packed
    monkeypatch.setattr(neighbours, "packed", lambda rows, by, size, parts: many.append((by, parts)) or packed(rows, by, size, parts))
    table = neighbours.usable(spark.createDataFrame(vectors(5, 20, 4), "vec_id long, embedding array<double>")).crossJoin(spark.range(820).select("id")).drop("id")
    for parallel in (1, 64):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _, p=parallel: p))
        neighbours.search(table.where("vec_id = 0"), table)
    cells = [parts for by, parts in many if by == "cell"]
    assert cells == [neighbours.blocks(16_400)] * 2
