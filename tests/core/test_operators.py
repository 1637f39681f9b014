"""Operators on small tables, against plain loops; sources and the stream on small folders."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import names, text, vectors
from plumbline.operators import duplicates, graphs, relational
from plumbline.sources import files
from plumbline.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_rules(spark):
    lit = F.lit
    assert one(spark, text.trimmed(lit("   a b 　\n"))) == "a b"
    assert one(spark, text.normalized(lit("\n a\n \t\n\n\nb \n"))) == "a\n\nb"
    assert one(spark, text.filled_lines(lit("a\n\n  \nb\n"))) == 2 and one(spark, text.token_count(lit(" a\tb　c "))) == 3
    rows = spark.createDataFrame([("src/a.d.ts",), ("src/a.test.ts",), ("x/__tests__/a.ts",), ("x/fixtures/a.ts",), ("src/attest.ts",)], "p string")
    assert [r[0] for r in rows.select(text.is_js_test_path(F.col("p"))).collect()] == [True, True, True, True, False]
    rows = spark.createDataFrame([("conftest.py",), ("a/test_x.py",), ("a/x_test.py",), ("tests/x.py",), ("a/x.pyi",), ("a/contest.py",), ("a/x.spec.py",)], "p string")
    assert [r[0] for r in rows.select(text.is_python_test_path(F.col("p"))).collect()] == [True, True, True, True, True, False, True]


def test_names(spark):
    given_ = ["DEFAULT_maxStepsCount", "CFG_", "FORCE_CAP_N", "DEFAULT_FORCE_CAP", "timeoutMs", "_S", "LEGACY_CFG_A_MS_S", "plain"]
    rows = spark.createDataFrame([(x,) for x in given_], "n string").select(names.normal(F.col("n")).alias("x"), names.gated(F.col("n")).alias("g")).collect()
    assert [r.x for r in rows] == ["MAX_STEPS", "CFG_", "FORCE_CAP", "FORCE_CAP", "TIMEOUT", "_S", "CFG_A_MS", "PLAIN"]
    assert [r.g for r in rows] == [True, False, True, True, True, False, False, False]
    assert one(spark, names.gated(F.lit("my.plain_x"), ("my.*_x",))) and not one(spark, names.gated(F.lit("myoplain_x"), ("my.*_x",)))
    assert one(spark, names.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0


def test_cosine(spark):
    pair = lambda a, b: one(spark, vectors.cosine(F.lit(a), F.lit(b)))
    assert pair([0.0, 0.0], [1.0, 2.0]) == 0 and abs(pair([3.0, 4.0], [3.0, 4.0, 9.0]) - 1) < 1e-12 and pair([1.0, 0.0], [0.0, 1.0]) == 0


def test_similar_vectors(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 7)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 4]))]) for k in range(30)] + [(40, [0.0, 0.0, 0.0]), (41, None)]
    got = {(r.a, r.b): r.cosine for r in duplicates.similar_vectors(spark.createDataFrame(rows, "id long, v array<double>"), 0.7).collect()}
    want = {}
    for a, x in rows:
        for b, y in rows:
            if x and y and a < b:
                n = min(len(x), len(y))
                norm = (sum(c * c for c in x[:n]) * sum(c * c for c in y[:n])) ** 0.5
                if norm and sum(c * d for c, d in zip(x, y, strict=False)) / norm >= 0.7:
                    want[a, b] = sum(c * d for c, d in zip(x, y, strict=False)) / norm
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_similar_sets(spark):
    rng = random.Random(2)
    rows = [(f"k{k}", rng.sample("abcdefghij", rng.randint(1, 8))) for k in range(60)] + [("none", [])]
    for t in (0.3, 0.75, 1.0):
        got = {(r.a, r.b) for r in duplicates.similar_sets(spark.createDataFrame(rows, "key string, tokens array<string>"), t).collect()}
        assert got == {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) / len({*x, *y}) >= t}


def test_report_gate_boundaries(spark):
    rows = spark.createDataFrame([(9, 2), (10, 2), (1, 4), (3, 3), (3, 4), (13, 2), (20, 1)], "min_loc int, members int")
    assert [r.reported for r in duplicates.gate(rows).collect()] == [False, True, True, False, True, True, False]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("FW"), st.integers(1, 30), st.integers(1, 3), st.integers(0, 8)), max_size=25))
def test_overlaps(spark, spans):
    rows = [("f", arm, a, c, a + n) for arm, a, c, n in dict.fromkeys(spans)]
    got = duplicates.without_overlaps(spark.createDataFrame(rows, "file string, arm string, start_line int, start_col int, end_line int")).collect()
    kept = []
    for r in sorted(rows, key=lambda r: (r[2] - r[4], r[1] != "F", r[2], r[3])):
        if all(k[4] < r[2] or r[4] < k[2] for k in kept):
            kept.append(r)
    assert sorted(map(tuple, got)) == sorted(kept)


def test_components_and_closure(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), *[(20 + k, 21 + k) for k in range(15)]], "u long, v long")
    got = {r.node: r.component for r in graphs.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 9, **{k: 20 for k in range(20, 36)}}
    reached = graphs.closure(links, spark.createDataFrame([(3,), (99,)], "node long"))
    assert sorted(r.node for r in reached.collect()) == [1, 2, 3, 99]


def test_imports_and_companions(spark):
    known = spark.createDataFrame([("a/b.ts",), ("a/b/index.ts",), ("a/c/index.tsx",), ("a/d.ts",), ("doc.md",)], "path string")
    imports = spark.createDataFrame([("m.ts", "a/b"), ("m.ts", "a/c"), ("m.ts", "a/none"), ("m.ts", "a/d.ts"), ("a/d.ts", "a/d")], "file string, target string")
    assert sorted((r.u, r.v) for r in graphs.resolved_imports(imports, known).collect()) == [("m.ts", "a/b.ts"), ("m.ts", "a/c/index.tsx"), ("m.ts", "a/d.ts")]
    pairs = spark.createDataFrame([("doc.md", "a/d.ts"), ("gone.md", "a/b.ts")], "a string, b string")
    closed = known.where("path IN ('a/d.ts', 'a/b.ts')")
    assert sorted(r.path for r in graphs.with_companions(closed, pairs, known).collect()) == ["a/b.ts", "a/d.ts", "doc.md"]


def test_sequences_and_prefixes(spark):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate("veppvpev")] + [(2, 1, "v")], "u int, t int, x string")
    assert [r.t for r in relational.followed_before(rows, ["u"], ["t"], "x", "v", "e", "p").collect()] == [0]
    codes = spark.createDataFrame([("E501",), ("E",), ("EXE2",), ("W",), ("",)], "code string")
    prefixes = spark.createDataFrame([("E",), ("E5",), ("EXE",)], "prefix string")
    got = {r.code: r.prefix for r in relational.longest_prefix(codes, "code", prefixes, r"^[0-9]*\z").collect()}
    assert got == {"E501": "E5", "E": "E", "EXE2": "EXE", "W": None, "": None}


def test_languages_and_flags(spark):
    found = spark.createDataFrame([("a.ts",), ("b/c.tsx",), ("/".join("x" * 9) + ".py",)], "path string")
    assert tuple(relational.languages(found).first()) == (True, True, False)
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    flags = relational.flags_of(("dirty", paths("a", "a")), ("tracked", paths("a", "b")))
    assert sorted(map(tuple, flags.collect())) == [("a", True, True), ("b", False, True)]


def test_workspace(spark, tmp_path):
    for name in ("src/a.py", "src/b.ts", "node_modules/x.ts", "src/dist/y.py", "src/c.js", "plumbline.config.ts", "src/skip/z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    got = files.workspace(spark, str(tmp_path), exclude=("src/skip/**",)).collect()
    assert sorted(r.path for r in got) == ["src/a.py", "src/b.ts"] and {r.text for r in got} == {"# src/a.py", "# src/b.ts"}


def test_clone_report(spark):
    member = lambda f, k, **more: {"file": f, "name": "n", "start_line": k, "end_line": k + 5, "similarity": 0.9, "representative": False, "test": False} | more
    report = {"schema_version": 2, "clusters": [{"id": "c1", "similarity": 0.9, "test_only": False, "trait_impl_only": False, "members": [member("b", 1), member("a", 9), member("t", 1, test=True)]}, {"id": "c2", "similarity": 1, "test_only": False, "trait_impl_only": False, "members": [member("a", 1), member("gone", 1)]}, {"id": "c3", "similarity": 1, "test_only": True, "trait_impl_only": False, "members": [member("a", 1), member("b", 1)]}]}
    known = spark.createDataFrame([("a",), ("b",), ("t",)], "path string")
    frame = lambda r: spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),)], "json string")
    got = files.clone_members(frame(report), known).collect()
    assert sorted((r.cluster_id, r.file, r.representative) for r in got) == [("c1", "a", True), ("c1", "b", False)]
    for bad in ("{", report | {"schema_version": 3}):
        with pytest.raises(Exception, match="MALFORMED|unknown clone report"):
            files.clone_members(frame(bad), known).collect()


def test_vector_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_vectors(spark, path, "m", "1").count() == 0
    files.write_vectors(spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [1.0])], "hash string, vector array<float>"), path, "m", "1")
    wanted = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hash string")
    split = duplicates.cache_split(wanted, files.read_vectors(spark, path, "m", "1"), dims=2)
    assert {r.hash: r.hit for r in split.collect()} == {"h1": True, "h2": False, "h3": False}
    assert files.read_vectors(spark, path, "m", "2").count() == 0


def test_stream_checks_what_a_change_reaches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    workspace = spark.createDataFrame([("a", "old a"), ("b", "old b"), ("c", "old c")], changes.FILES)
    edges = spark.createDataFrame([("a", "b")], "u string, v string")
    spark.createDataFrame([("a", "new a")], changes.FILES).write.parquet(folder)
    changes.check_stream(changes.changed(spark, folder), workspace, edges, lambda f: f, out, str(tmp_path / "state")).awaitTermination(120)
    assert sorted((r.path, r.text) for r in spark.read.parquet(out).collect()) == [("a", "new a"), ("b", "old b")]


def test_diagnostics_and_documents(spark, tmp_path):
    row = {"code": "E1", "filename": "a.py", "message": "m", "location": {"row": 3, "column": 4}}
    lines = spark.createDataFrame([(json.dumps(row),), ("{",), ("{}",)], "json string")
    assert [tuple(r) for r in files.diagnostics(lines).collect()] == [("E1", "a.py", 3, 4, "m")]
    (tmp_path / "a.md").write_text("x\ny")
    assert [r.text for r in files.documents(spark, [str(tmp_path / "a.md")]).collect()] == ["x\ny"]


def test_components_of_loops_and_nulls(spark):
    links = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, None), (5, 6), (6, 7), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in graphs.components(links).collect()} == {1: 1, 2: 2, 3: 2, 5: 5, 6: 5, 7: 5}


def test_similar_vectors_within_a_column(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 3)
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)], "ab"[k % 2]) for k in range(40)]
    got = {(r.a, r.b) for r in duplicates.similar_vectors(spark.createDataFrame(rows, "id long, v array<double>, p string"), 0.6, "p").collect()}
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    assert got == {(i, j) for i, x, p in rows for j, y, q in rows if i < j and p == q and cosine(x, y) >= 0.6}
