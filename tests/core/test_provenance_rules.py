"""Rules on records, seeds and fitting, on files that break and keep them."""

import pytest

from plumbline.plans import engine, provenance_rules  # noqa: F401
from plumbline.sources.python_ast import package_roots, python_nodes


def check(spark, rule_id, files, options=None, git=()):
    known = spark.createDataFrame(list(files.items()), "path string, text string")
    inputs = {"python": python_nodes(known), "packages": package_roots(known, known.limit(0)), "git": spark.createDataFrame([(p,) for p in git], "path string")}
    rows = engine.check(spark, {rule_id: ("error", options or {})}, engine.Inputs({k: (lambda v: lambda _: v)(v) for k, v in inputs.items()})).collect()
    return [(r.file, r.start_line, r.message) for r in rows]


TRAIN = "def train():\n    loss.backward()\n"
GUARD = "loss.backward()\nif __name__ == '__main__':\n    run.main()\n"


def test_a_writer_is_needed(spark):
    writer = "def save_metadata(d):\n    json.dump(d, f)\n"
    files = {
        "a.py": TRAIN,
        "b.py": "def save_metadata(d):\n    print(d)\n" + TRAIN,
        "c.py": writer + TRAIN,
        "d.py": writer + "def train():\n    loss.backward()\n    helper()\ndef helper():\n    deeper()\ndef deeper():\n    save_metadata({})\n",
        "e.py": "from c import save_metadata\ndef f():\n    torch.save(m, 'x')\n    save_metadata({})\n",
        "g.py": GUARD,
        "h.py": "def save_metadata(d):\n    with open('x', mode='w') as f:\n        f.write(d)\nsave_metadata(1)\njoblib.dump(m, 'y')\n",
        "i.py": "def train():\n    pass\n",
        "tests/test_a.py": TRAIN,
    }
    got = check(spark, "ml/metadata-writer-required", files)
    assert [(f, n, m.split('" ')[1].split(" ")[0]) for f, n, m in got] == [("a.py", 1, "is"), ("b.py", 3, "does"), ("c.py", 3, "is"), ("g.py", 2, "is")]
    assert "is not called" in got[2][2] and "is defined or imported" in got[0][2]
    assert check(spark, "ml/metadata-writer-required", {"a.py": "def go():\n    loss.backward()\n    note()\ndef note():\n    p.write_text('x')\n"}, {"writerName": "note", "entryPoints": ["pkg/go.py"]}) == []
    with pytest.raises(engine.ConfigError):
        engine.settings([], {"ml/metadata-writer-required": ["error", {"writer": "x"}]})


def test_the_record_holds_a_version(spark):
    call = "def train():\n    loss.backward()\n    {}\n"
    head = "def save_metadata(d):\n    json.dump(d, f)\n"
    files = {
        "a.py": head + call.format("save_metadata({'lr': lr})"),
        "b.py": head + call.format("save_metadata({'Git_Sha': x})"),
        "c.py": head + call.format("save_metadata(lr=1, code_version=2)"),
        "d.py": head + call.format("save_metadata(unknown)"),
        "e.py": head + "def train():\n    loss.backward()\n    d = 1\n    d = {'a': git_commit}\n    save_metadata(d)\n",
        "f.py": "def save_metadata(d):\n    d = {'x': 1, 'rev': os.environ['CODE_REV']}\n    json.dump(d, f)\n" + call.format("save_metadata(1)"),
        "g.py": "def save_metadata(d):\n    json.dump({'x': 1}, f)\n" + call.format("save_metadata(1)"),
    }
    assert [(f, n) for f, n, _ in check(spark, "ml/record-code-version", files)] == [("a.py", 3), ("g.py", 3)]


def test_what_a_run_takes_is_recorded(spark):
    head = "def save_metadata(d):\n    json.dump(d, f)\n"
    args = "p.add_argument('--learning-rate')\np.add_argument('-b', '--batch')\np.add_argument('-q')\np.add_argument('path', dest='where')\n"
    files = {
        "a.py": head + args + "def train():\n    loss.backward()\n    save_metadata({'batch': 1, 'where': 2})\n",
        "b.py": head + "@dataclass\nclass Config:\n    lr: float\n    depth: int = 3\n    other = 1\nclass Plain:\n    zzz: int\ndef train():\n    c = Config(1)\n    loss.backward()\n    save_metadata(lr=1)\n",
        "c.py": head + "p.add_argument('--x')\ndef train():\n    loss.backward()\n    save_metadata(blob)\n",
        "d.py": head + "class A(BaseModel):\n    u: int\nclass B(pydantic.BaseModel):\n    v: int\ndef train():\n    A(), B()\n    loss.backward()\n    save_metadata(w=1)\n",
    }
    got = check(spark, "ml/run-metadata-completeness", files)
    assert got == [("a.py", 7, 'Run metadata is missing "learning_rate", "q".'), ("b.py", 10, 'Run metadata is missing "depth".')]
    assert check(spark, "ml/run-metadata-completeness", {"a.py": files["a.py"]}, {"allowExclusions": ["q", "learning_rate"]}) == []


def test_seeds_reach_a_generator(spark):
    files = {
        "a.py": "def train(seed):\n    rng = random.Random(seed)\n    train_test_split(x, random_state=seed)\n    loss.backward()\n",
        "b.py": "def train(seed):\n    rng = random.Random(seed)\n    torch.manual_seed(seed)\n    loss.backward()\n",
        "c.py": "def train(seed):\n    rng = random.Random(seed)\n    setup(seed)\n    loss.backward()\n",
        "d.py": "def f(seed):\n    rng = random.Random(seed)\n",
        "e.py": "DataLoader(x)\nsplit = train_test_split(x, args.split_seed)\nclass A:\n    def f(self, seed):\n        def g():\n            torch.manual_seed(seed)\n        return Random(seed)\n",
    }
    assert [(f, n) for f, n, _ in check(spark, "ml/seed-must-reach-framework-rng", files)] == [("a.py", 2), ("e.py", 2), ("e.py", 7)]


def test_entry_points_have_tests_that_run_twice(spark):
    twice = "from a import train\ndef test():\n    x, y = train(), train()\n    assert x.state_dict() == y.state_dict()\n"
    assert check(spark, "ml/determinism-test-required", {"a.py": TRAIN, "tests/test_a.py": twice}) == []
    assert check(spark, "ml/determinism-test-required", {"a.py": TRAIN, "test_b.py": "import a\na.train()\na.main()\nnp.allclose(a.train, 1)\n"}) == []
    for bad in (twice.replace("train(), train()", "train(), 1"), twice.replace("==", "!="), twice.replace("state_dict", "weights"), twice.replace("train", "main")):
        assert [(f, n) for f, n, _ in check(spark, "ml/determinism-test-required", {"a.py": TRAIN, "tests/test_a.py": bad})] == [("a.py", 1)]
    got = check(spark, "ml/determinism-test-required", {"a.py": GUARD, "b.py": "def fit_all():\n    DataLoader(x)\n"}, {"entryPoints": ["b.fit_all"]})
    assert [(f, n, m.split('"')[1]) for f, n, m in got] == [("a.py", 2, "main"), ("b.py", 1, "fit_all")]


def test_artifacts_are_not_clobbered(spark):
    files = {
        "src/a.py": "torch.save(m, 'out/m.pt')\njoblib.dump(m, filename='./w.pkl')\ntorch.save(m, path)\ntorch.save(m, f='/out/m.pt')\n",
        "src/b.py": "def f():\n    torch.save(m, 'out/m.pt')\n    os.replace('out/tmp', 'out/m.pt')\ndef g():\n    open('notes.txt', 'w')\n    open('weights.bin', mode='wb')\n    open('weights.bin')\n",
        "src/c.py": "def f():\n    Path('notes.txt').write_bytes(b)\n    torch.save(m, 'unknown.pt')\ndef g():\n    Path('notes.txt').write_bytes(b)\n",
    }
    got = check(spark, "ml/no-inplace-artifact-clobber", files, git=["out/m.pt", "src/w.pkl", "notes.txt", "src/weights.bin"])
    assert [(f, n, m.split('"')[1]) for f, n, m in got] == [("src/a.py", 1, "out/m.pt"), ("src/a.py", 2, "src/w.pkl"), ("src/b.py", 6, "src/weights.bin"), ("src/c.py", 2, "notes.txt")]


def test_nothing_is_fitted_at_inference(spark):
    files = {
        "serving/a.py": "s = StandardScaler()\nt = s\ndef f(x):\n    t.fit(x)\n    u = sklearn.PCA\n    u.fit_transform(x)\n    model.fit(x)\n    StandardScaler().fit(x)\n",
        "b.py": "def predict(x):\n    y = model(x)\n    m = x.mean()\n    n = m\n    return (y - n) / x.std(0)\ndef train(x):\n    PCA().fit(x)\n    return (x - x.mean()) / 2\n",
        "c.py": "net.load_state_dict(d)\nx -= np.mean(x)\nz = np.mean(x)\nw = mean(x) - 1\n",
        "d.py": "class predict_server:\n    def go(self, x):\n        PCA().fit(self.net(x))\n    def act(self, x):\n        PCA().fit(x)\n",
    }
    got = [(f, n) for f, n, _ in check(spark, "ml/no-refit-at-inference", files)]
    assert got == [("b.py", 3), ("b.py", 5), ("c.py", 2), ("d.py", 3), ("serving/a.py", 4), ("serving/a.py", 6), ("serving/a.py", 8)]
