"""Similar chunks, clone clusters and constants declared twice."""

import pytest

from plumbline.plans import dry_rules, engine
from plumbline.sources.python_ast import package_roots, python_nodes

BODY = "".join(f"    total_{k} = compute(total_{k}, rate, days)\n" for k in range(8))


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def nodes_and_packages(spark, files, projects=()):
    known = frame(spark, files)
    return python_nodes(known), package_roots(known, spark.createDataFrame([(p,) for p in projects], "path string"))


def report(spark, rule_id, inputs, options=None):
    return engine.check(spark, {rule_id: ("error", options or {})}, engine.Inputs({k: (lambda v: lambda _: v)(v) for k, v in inputs.items()})).collect()


def test_package_roots(spark):
    known = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",)], "path string")
    roots = package_roots(known, spark.createDataFrame([("a/pyproject.toml",), ("a/b/pyproject.toml",)], "path string"))
    assert {r.file: r.package_dir for r in roots.collect()} == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": ""}


def test_semantic_duplicates(spark):
    files = {"src/a.py": f"def one(rate, days):\n{BODY}", "src/b.py": f"class K:\n  def two(self, rate, days):\n{BODY.replace('    ', '      ')}", "tests/c.py": f"def one(rate, days):\n{BODY}", "src/short.py": "def x():\n    return 1\n"}
    nodes, _ = nodes_and_packages(spark, files)
    chunks = dry_rules.python_chunks(nodes, frame(spark, files))
    assert sorted((r.path, r.name) for r in chunks.collect()) == [("src/a.py", "one"), ("src/b.py", "K"), ("src/b.py", "K.two")]
    rows = report(spark, "dry/no-semantic-duplicate", {"chunks": dry_rules.embedded(chunks)})
    assert [(r.file, r.start_line, r.start_col) for r in rows] == [("src/a.py", 1, 5)]
    assert rows[0].message == '"one" is a semantic near-duplicate of "K" at src/b.py:1, "K.two" at src/b.py:2.'
    cache = spark.createDataFrame([(chunks.first().hash, [0.0] * 31)], "hash string, vector array<double>")
    assert dry_rules.embedded(chunks, cache).count() == 3
    assert not report(spark, "dry/no-semantic-duplicate", {"chunks": dry_rules.embedded(chunks, embed=lambda t: [float("nan")] * 32)})
    with pytest.raises(engine.ConfigError):
        engine.settings(["dry"], {"dry/no-semantic-duplicate": ["error", {"threshold": 0}]})


def test_whole_function_clones(spark):
    rows = [("c1", 0.905, f, "f", a, b) for f, a, b in (("src/b.py", 1, 10), ("src/a.py", 5, 14))] + [("c2", 1.0, f, "g", a, b) for f, a, b in (("src/b.py", 20, 28), ("src/c.py", 1, 9))] + [("c3", 1.0, "src/b.py", "h", 2, 12), ("c3", 1.0, "src/a.py", "h", 1, 11)] + [("c4", 1.0, "src/a.ts", "k", 1, 12), ("c4", 1.0, "src/b.ts", "k", 1, 12)]
    clones = spark.createDataFrame(rows, "cluster_id string, similarity double, file string, name string, start_line int, end_line int")
    got = report(spark, "dry/no-duplicate-python", {"clones": clones})
    assert [(r.file, r.start_line, r.message) for r in got] == [("src/b.py", 2, '"h" is duplicate logical code of "h" in src/a.py:1 (100% similar).')]
    assert [r.file for r in report(spark, "dry/no-duplicate-code", {"clones": clones})] == ["src/b.ts"]


THRESHOLDS = {
    "p/a.py": "MAX_STEPS = 10\nDEFAULT_FORCE_CAP = 3\nRETRY_TIMEOUT_MS = 5\nPLAIN = 1\ntwice = 1\ntwice = 2\n",
    "p/b.py": "MAX_STEPS = 12\nFORCE_CAP_N = 4\nRETRY_TIMEOUT = 5.0\nplain_one = 1\n",
    "p/c.py": "from a import MAX_STEPS\nMAX_STEPS = 10\n",
    "q/d.py": "MAX_STEPS = 10\n",
    "p/tests/e.py": "MAX_STEPS = 10\n",
}


def test_thresholds(spark):
    nodes, packages = nodes_and_packages(spark, THRESHOLDS, ["p/pyproject.toml", "q/pyproject.toml"])
    rows = report(spark, "python/single-source-threshold", {"python": nodes, "packages": packages})
    got = [(r.file, r.start_line, r.message) for r in rows]
    assert [(f, n) for f, n, _ in got] == [("p/b.py", 1), ("p/b.py", 2), ("p/b.py", 3)]
    assert got[0][2] == '"MAX_STEPS" is a second definition of MAX_STEPS at p/a.py. Define it once and import it. Values disagree — confirm split-brain.'
    assert got[1][2] == '"FORCE_CAP_N" redeclares the same threshold as DEFAULT_FORCE_CAP at p/a.py. Define it once and import it. Values disagree — confirm split-brain.'
    assert got[2][2].endswith("Define it once and import it.")
    exact = {"arms": {"normalized": False, "embedNames": False}}
    assert len(report(spark, "python/single-source-threshold", {"python": nodes, "packages": packages}, exact)) == 1
