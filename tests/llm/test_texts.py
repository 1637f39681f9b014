"""Language ID, quality, licences, decontamination and SentencePiece on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, decontaminate, langid, licenses, pieces, quality

from .fixtures import by_id, frame, texts


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    syllables = {"aa": ["the", "ing", "wh", "ou"], "bb": ["ßen", "öch", "ung", "ie"], "cc": ["ção", "lha", "nho", "eu"]}
    return [(k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(rng.choice([3, 20, 90]))), lang) for k in range(n) for lang in [rng.choice(sorted(syllables))]]


def test_language_id(spark):
    rows = [*corpus(), (900, None, "aa"), (901, "", "aa"), (902, "123 ---", "bb"), (903, "the ing", None), (None, "the ouing", "aa"), (903, "the ing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("zz")).withColumn("score", F.lit(9))
    model = langid.train(langid.training_rows(docs))
    asked = docs.select("doc_id", "text", F.col("lang").alias("true"), (common.crc_mod("doc_id", 4) == 2).alias("held"))
    got = langid.predict(asked, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held and r.true and r.doc_id < 900]
    assert len(held) > 40 and sum(r.lang_pred == r.true for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.lang_pred for r in got if r.doc_id in (903, None)] == ["aa"] * 3
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3 and kept.where("lang is null").count() == 0


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.train(langid.training_rows(docs)) is None
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.accepted(docs, None).count() == 1
    assert langid.train(langid.training_rows(docs.limit(0))) is None


def test_presence_is_that_of_all_grams():
    texts_ = ["abcab", "", "é", "a"]
    raw = "".join(texts_).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts_])]
    sets = langid.presence(np.frombuffer(raw, np.uint8), offsets)
    grams = [{t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)} for t in texts_]
    assert [int(s.sum()) for s in sets] == [len(g) for g in grams]


def test_scores_against_a_dense_solution():
    """Kernel ridge regression over all landmarks, solved densely from a kernel that is computed pair by pair from sets of n-grams."""
    rows = [(t, lang) for _, t, lang in corpus(7, 60)]
    presence = lambda many: langid.presence(np.frombuffer("".join(many).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in many])])
    sets = presence([t for t, _ in rows])
    model = langid.fit(np.packbits(sets.astype(bool), axis=1), [lang for _, lang in rows])
    langs = sorted({lang for _, lang in rows})
    each = langid.LANDMARKS // len(langs)
    places = [set(np.flatnonzero(s).tolist()) for s in sets]
    marks = [k for lang in langs for k in [i for i, (_, x) in enumerate(rows) if x == lang][:each]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k_nm = np.array([[kernel(places[i], places[j]) for j in marks] for i in range(len(rows))])
    weight = np.diag([len(rows) / (len(langs) * sum(x == lang for _, x in rows)) for _, lang in rows])
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    features = np.c_[k_nm, np.ones(len(rows))]
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1] = k_nm[marks]
    penalty[-1, -1] = 1
    solved = np.linalg.lstsq(features.T @ weight @ features + langid.RIDGE * len(rows) * penalty, features.T @ weight @ target, rcond=1e-12)[0]
    others = [t for _, t, _ in corpus(8, 40)]
    asked = [set(np.flatnonzero(s).tolist()) for s in presence(others)]
    want = np.array([[kernel(a, places[j]) for j in marks] + [1.0] for a in asked]) @ solved
    assert np.abs(langid.scores(model, presence(others)) - np.clip((want + 1) / 2, 0, 1)).max() < 1e-3


def test_repeated_ids_and_rare_languages_in_training(spark):
    rows = [(1, f"the thing {k}", "aa") for k in range(300)] + [(k, "the ing ou", "aa") for k in range(2, 60)] + [(1000, "ção lha", "cc"), (None, "wh ou", "aa"), (None, "ing ou", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert langid.train(docs, 20)["classes"] == ["aa", "cc"]
    held = {r.doc_id: r.held for r in docs.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held")).collect()}
    assert held[None] is False


def test_many_short_texts_and_a_long_one(spark):
    rows = [*corpus(), *[(2000 + k, "a", None) for k in range(3000)], (9000, "the ing wh ou " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs)).collect()}
    assert got[9000] == "aa" and len(got) == len(rows)


def test_statistics_against_plain_counts():
    many = ["Hello world. THIS is 1 line!\nHello, world é\n\nHello world", "", "x", "a a a a bb", "\n\n", "ÀÉ ß 12"]
    got = quality.statistics(np.frombuffer("".join(many).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in many])])
    for text, row in zip(many, got, strict=True):
        raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        lines, n = [x for x in raw.split(b"\n") if x], max(1, len(words))
        share = lambda some: sum(b in some for b in raw) / max(1, len(raw))  # noqa: B023, E731
        length = [len(w) for w in words]
        want = {
            "log_bytes": np.log1p(len(raw)), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share(b"0123456789"), "space": share(b" \t\r\v\f"), "newline": share(b"\n"), "stop": share(b".?!"), "non_ascii": share(bytes(range(128, 256))),
            "log_words": np.log1p(len(words)), "word_mean": sum(length) / n, "word_std": np.std(length) if words else 0, "word_max": np.log1p(max(length, default=0)), "short_words": sum(x <= 2 for x in length) / n, "capital_words": sum(w[:1].isupper() for w in words) / n,
            "shout_words": sum(w[:1].isupper() and len(w) > 1 and not any(97 <= b <= 122 for b in w) for w in words) / n, "letterless": sum(not any(b >= 128 or chr(b).isalpha() for b in w) for w in words) / n,
            "distinct_words": len(set(words)) / n, "top_word": max([words.count(w) for w in words], default=0) / n, "distinct_pairs": len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
            "log_lines": np.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)), "stops_per_word": sum(b in b".?!" for b in raw) / n,
        }
        for name, value in want.items():
            assert abs(row[quality.FEATURES.index(name)] - value) < 1e-9, (text, name)


def test_first_split_against_all_splits(monkeypatch):
    """A tree of depth one splits where trying every feature and value gains most."""
    monkeypatch.setattr(quality, "TREES", 1)
    monkeypatch.setattr(quality, "DEPTH", 1)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, len(quality.FEATURES))).astype(float)
    y = (x[:, 7] + rng.normal(size=300) > 6).astype(float)
    model = quality.grow(x, y)
    p = y.mean()
    gain = {}
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST:
                g, h = lambda some: (y[some] - p).sum(), lambda some: some.sum() * p * (1 - p)
                gain[f, cut] = sum(g(s) ** 2 / (h(s) + quality.L2) for s in (left, ~left))
    f, cut = max(gain, key=gain.get)
    assert model["feature"][0] == f and ((x[:, f] <= model["threshold"][0]) == (x[:, f] <= cut)).all()
    left = x[:, f] <= cut
    for side, node in ((left, model["left"][0]), (~left, model["right"][0])):
        assert abs(model["value"][node] - quality.RATE * (y[side] - p).sum() / (side.sum() * p * (1 - p) + quality.L2)) < 1e-9


def test_repeated_ids_in_quality_training(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "other words") for k in range(2, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 50)], "doc_id long, quality int")
    seen = []
    original = quality.grow
    quality.grow = lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.grow = original
    assert seen == [49]


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 12))).capitalize() for _ in range(6)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "CLICK***", "777"]) for _ in range(60))
    rows = [(k, good() if k % 2 else bad()) for k in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (3, rows[3][1])], "doc_id long, text string").withColumn("score", F.lit("no"))
    labels = spark.createDataFrame([*[(k, k % 2, 0) for k in range(240)], (5, None, 0), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels.where(common.crc_mod("doc_id", 3) != 1))
    got = quality.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 900) >= 238
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.predict(docs.select("doc_id", "text"), nothing).collect()} == {0.5}
    assert quality.predict(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_flat_trees_walk_as_grown():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(quality.FEATURES)))
    model = quality.grow(x, (x[:, 3] * x[:, 5] > 0).astype(float))

    def walk(row, node):
        while model["left"][node] != node:
            node = model["left"][node] if row[model["feature"][node]] <= model["threshold"][node] else model["right"][node]
        return model["value"][node]

    want = [1 / (1 + np.exp(-(model["base"] + sum(walk(r, n) for n in model["roots"])))) for r in x[:50]]
    assert np.allclose(quality.score(model, x[:50]), want)
    assert ((quality.score(model, x) > 0.5) == (x[:, 3] * x[:, 5] > 0)).mean() > 0.9


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licences(spark):
    rows = [
        (1, "Licensed under CC-BY 4.0. All rights reserved? cc by cc by-sa"),
        (2, "GNU General Public License, version 3 or any later version."),
        (3, None),
        (4, ""),
        (5, "accby is no licence"),
        (6, "All Rights\nRESERVED all rights reserved"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (8, "SPDX-License-Identifier: Apache-2.0"),
        (9, "é " * 50_000 + "cc by"),
        (9, "a"),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 9:
            continue
        words = alnum(dict(rows[:9])[r.doc_id])
        at = sorted(i for phrase, _ in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        labels = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(words)} "}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    of = {r.doc_id: r for r in got}
    assert "gpl-3.0-or-later" in of[2].labels.split(",") and "gpl-3.0" not in of[2].labels.split(",")
    assert "mit" in of[7].labels and "apache-2.0" in of[8].labels and of[5].labels == ""
    assert (50_001, 50_000) in {(r.n_words - 1, r.first_word) for r in got if r.doc_id == 9}
    assert licenses.scan(frame(spark, [])).count() == 0 and len(licenses.rules()) > 200


def wordings(parsed):
    """One text at least for each way through the alternatives and options of a parsed regex."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(x) if str(kind) == "LITERAL" else "7" for kind, x in arg]
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in wordings(branch)]
        elif op == "SUBPATTERN":
            some = wordings(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [*([""] if not arg[0] else []), *wordings(arg[2])]
        else:
            some = {"AT": [""], "ANY": ["q"]}[op]
        out = [a + b for a in out for b in some]
    return out


def test_labels_and_scores_against_a_plain_scan(spark):
    """Every rule run over every text without the prefilter, containment judged pair by pair, words counted from the start."""
    rows = [(1, "Licensed under the MIT License. MIT license!"), (2, "GNU General Public License version 2 or later; gpl 3"), (3, "CC BY-SA 4.0 and cc by, all rights reserved. (C) copyright 2020"), (4, "nothing"), (5, None), (6, "apache license 2.0 " * 300), (7, "SPDX-License-Identifier: GPL-2.0-only\nredistribution and use in source and binary forms")]
    _, compiled, _ = licenses.scanner()
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for k, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        joined = (" " + " ".join(words) + " ").encode()
        found = [(m.start(), m.end(), priority, rule, label, weight) for rule, (label, priority, weight, pattern) in enumerate(compiled) for m in pattern.finditer(joined) if m.end() > m.start()]
        stronger = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and ((y[2] > x[2]) or (y[2] == x[2] and (y[1] - y[0], -y[3]) > (x[1] - x[0], -x[3])))
        left = [x for x in found if not any(stronger(x, y) for y in found if y is not x)]
        base = {label for phrase, label in licenses.BASE if f" {phrase} ".encode() in joined}
        assert got[k].labels == ",".join(sorted(base | {x[4] for x in left}))
        keep = 1.0
        for label in {x[4] for x in left}:
            keep *= 1 - max(x[5] for x in left if x[4] == label)
        assert abs(got[k].score - (1 - keep)) < 1e-12
        assert sorted((d.first_word, d.n_words, d.label) for d in got[k].detections) == sorted((joined[: x[0]].count(b" ") - 1, joined[x[0] : x[1]].count(b" ") + 1, x[4]) for x in left)
        assert licenses.scan(frame(spark, rows[:1]), detections=False).first().detections is None


def test_the_prefilter_loses_no_rule():
    automaton, compiled, _ = licenses.scanner()
    for rule, (label, _, _, _, pattern) in enumerate(licenses.rules()):
        for words in wordings(re._parser.parse(pattern)):
            text = f" {words} ".encode()
            hit = {k for _, some in automaton.iter(text.decode("latin-1")) for k in some}
            if compiled[rule][3].search(text):
                assert rule in hit, (label, words)
            elif "  " not in f" {words} ":
                raise AssertionError((label, words))


@pytest.mark.parametrize(
    "text, label",
    [("Licensed under MPL 2.0", "mpl-2.0"), ("EPL-2.0", "epl-2.0"), ("CDDL 1.0", "cddl-1.0"), ("EUPL-1.2", "eupl-1.2"), ("LPPL 1.3", "lppl-1.3"), ("a BSD-style license", "bsd"), ("the zlib/libpng license", "zlib"), ("Unauthorised copying of this file is strictly prohibited", "proprietary"), ("PHP licence", "php"), ("PHP 3.01", "php-3.01")],
)
def test_gated_scan_is_that_of_all_rules(text, label):
    automaton, compiled, _ = licenses.scanner()
    words = f" {' '.join(alnum(text))} ".encode()
    hit = {k for _, some in automaton.iter(words.decode("latin-1")) for k in some}
    got = licenses.detect(words, hit, compiled)
    assert got == licenses.detect(words, set(range(len(compiled))), compiled) and label in {d[3] for d in got}


def test_no_rule_stands_twice():
    rules = licenses.rules()
    assert len(rules) == len({(label, priority, weight, pattern) for label, priority, weight, _, pattern in rules})


def test_containment_suppresses_the_weaker():
    compiled = [(label, priority, 0.5, re.compile(rb"(?<= )" + p)) for label, priority, p in (("long", 80, rb"a b c"), ("inner", 40, rb"b"), ("across", 40, rb"c d"), ("same", 80, rb"a b"))]
    assert [d[3] for d in licenses.detect(b" a b c d ", {0, 1, 2, 3}, compiled)] == ["long", "across"]


def contamination(rows, items):
    tests = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            tests.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for k, text in rows:
        w, hit, found = alnum(text), set(), set()
        for n in {len(t) for t in tests}:
            for i in range(len(w) - n + 1):
                if some := tests.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= some - {None}
        out.append((k, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontaminate.TEST_BLOCK, 20])
def test_decontamination(spark, block):
    rows = [*texts(3, 50), (300, None), (None, "q r s"), (301, "Q r S " + "z " * 500)]
    words = [alnum(t) for _, t in rows if t and len(alnum(t)) > 20]
    items = [(k, " ".join(w[3:18])) for k, w in enumerate(words[:12])] + [(50, "q R s"), (51, None), (52, "--"), (53, words[0][0] + " " + words[0][1]), (None, "z z z z"), (54, "nowhere at all"), (2, "z z")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x")).withColumn("key", F.lit(1))
    got = decontaminate.matched(frame(spark, rows), table, block)
    assert sorted(((r.doc_id, r._words, r._hit, r._items, r._contaminated) for r in got.collect()), key=str) == contamination(rows, items)
    kept = decontaminate.clean(frame(spark, rows), table)
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(x[0]) for x in contamination(rows, items) if not x[4])
    assert decontaminate.clean(frame(spark, rows), table.limit(0)).count() == len(rows)
    assert decontaminate.matched(frame(spark, []), table).count() == 0


def test_longest_matches(spark):
    """Two items quoted back to back are two matches, and of items that start alike the longest is kept."""
    one, two = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(20)]
    items = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(["x", *one[:20], "y"])), (4, "short one")]
    rows = [(1, " ".join(["p", *one[5:], *two, "q"])), (2, " ".join(one[:20])), (3, "Short one and a short, one"), (4, "a " * 40)]
    items.append((5, "a " * 25))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r._matches] for r in decontaminate.matched(frame(spark, rows), table).collect()}
    assert got[1] == [(1, 26, 1, 5), (26, 46, 2, 0)]
    assert got[2] in ([(0, 20, 1, 0)], [(0, 20, 3, 1)])
    assert got[3] == [(0, 2, 4, 0), (4, 6, 4, 0)]
    assert [(s, e) for s, e, _, _ in got[4]] == [(0, 25), (13, 38), (26, 40)]
    assert all(not m for m in (r._matches for r in decontaminate.matched(frame(spark, rows), table, listed=False).collect()))


def test_sentencepiece(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(4)
    some = ["".join(rng.choice("ab  \t\n▁éßñ.,!12<>\0ﬁ日本語😀 the---###   ") for _ in range(rng.choice([0, 1, 3, 10, 90]))) for _ in range(150)]
    some += [None, "", " ", " " * 40 + "a", "a" * 200, "the" * 90, "日本語の文章" * 30, *[t for _, t in texts(1, 20)]]
    rows = list(enumerate(some)) + [(None, "the"), (0, "the")]
    got = pieces.encoded(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(k, t): model.encode(t) if t else [] for k, t in rows}
    for r in got:
        ids = want[r.doc_id, r.text]
        assert list(r.tokens) == ids and r.n_tokens == len(ids)
        assert r.decoded == (None if r.text is None else model.decode(ids))
    digests = by_id(pieces.encoded(frame(spark, [(1, "a b"), (2, "a▁b")]), digests=True), "exact", "ids_sha256")
    assert digests[1][0] and not digests[2][0] and digests[1][1] == hashlib.sha256(np.array(model.encode("a b"), "<i4").tobytes()).hexdigest()
    assert pieces.encoded(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name, value", [("MEMORY", 0), ("MEMORY", 5), ("MEMORY_CHARS", 10), ("SHORT", 1), ("SHORT", 5)])
def test_pieces_at_the_borders_of_memory_and_rounds(name, value, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, name, value)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder = pieces.Encoder(pieces.read_model())
    rng = random.Random(3)
    for _ in range(6):
        many = [" ".join("".join(rng.choice("abcé語 0") for _ in range(rng.choice([1, 4, 9, 60]))) for _ in range(5)) for _ in range(4)] + [None, ""]
        flat, at = encoder.encode(many)
        assert [flat[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [library.encode(t) if t else [] for t in many]
