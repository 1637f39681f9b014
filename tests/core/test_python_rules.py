"""Each rule on a file that breaks it and one that keeps it."""

import pytest

from plumbline.model import exit_status
from plumbline.plans import engine, python_rules  # noqa: F401
from plumbline.sources.files import report_lines
from plumbline.sources.python_ast import package_roots, python_nodes

CASES = {
    "python/no-bare-except": (
        "try:\n    f()\nexcept:\n    g()\ntry:\n    f()\nexcept (ValueError, BaseException):\n    g()\ntry:\n    f()\nexcept BaseException:\n    g()\n",
        [3, 7, 11],
        "try:\n    f()\nexcept (ValueError, OSError):\n    g()\nexcept Exception:\n    raise\n",
    ),
    "python/no-silent-except": (
        "def f():\n    for x in y:\n        try:\n            g()\n        except ValueError:\n            continue\ntry:\n    g()\nexcept ValueError:\n    'text'\ntry:\n    g()\nexcept OSError:\n    ...\n",
        [5, 9, 13],
        "def f():\n    for x in y:\n        try:\n            g()\n        except ValueError:\n            continue\n    raise KeyError\ndef h():\n    try:\n        g()\n    except ValueError:\n        pass\n    return 1\ntry:\n    g()\nexcept OSError:\n    log()\n",
    ),
    "python/no-open-without-with": ("f = open('x')\nopen('y')\ng: object = open('z')\ndef h():\n    k = open('w')\n", [1, 2, 3, 5], "with open('x') as f:\n    pass\nself.f = open('x')\nclose(open('x'))\n"),
    "python/require-typed-public": (
        "def f(a):\n    pass\nclass A:\n    def g(self) -> int:\n        pass\n    async def h(self, *rest) -> int:\n        pass\n",
        [1, 6],
        "def f(a: int) -> int:\n    def inner(x):\n        pass\ndef _p(a):\n    pass\nclass _B:\n    def g(self, a):\n        pass\n@overload\ndef o(a):\n    pass\n",
    ),
    "python/no-public-any": (
        "import typing\nfrom typing import Any as Whatever\nLoose = typing.Any\ndef f(a: Any) -> int:\n    pass\ndef g(a: int) -> typing.Any:\n    pass\ndef h(*, a: Whatever) -> int:\n    pass\ndef k(a: Loose):\n    pass\n",
        [4, 6, 8, 10],
        "from typing import Any\ndef f(a: list[Any], *rest: Any) -> int:\n    pass\n",
    ),
    "python/no-mutable-default": (
        "rows = list\ndef make():\n    return {}\ndef f(a=[], *, b=dict()):\n    pass\ndef g(a=rows(), b=make()):\n    pass\n",
        [4, 4, 6, 6],
        "def f(a=None, b=(), c=frozenset()):\n    g = lambda x=[]: x\n",
    ),
    "python/no-sys-path-hack": (
        "import sys\nimport sys as s\nfrom sys import path as p, path_hooks\nsys.path.append('x')\ns.path = []\np[0] = 'y'\npath_hooks.insert(0, h)\nsys.path += ['z']\n",
        [4, 5, 6, 7, 8],
        "early.path.append('x')\nimport sys\nsys.argv.append('x')\nprint(sys.path)\n",
    ),
    "ml/optimizer-zero-grad": ("def f():\n    loss.backward()\n    self.optimizer.step()\n    opt.step()\n", [3], "def f():\n    opt.zero_grad()\n    loss.backward()\n    opt.step()\ndef g():\n    loss.backward()\n    clock.step()\n"),
    "ml/train-mode-restored": (
        "def f():\n    model.eval()\n    loss.backward()\ndef g():\n    model.train()\n    model.eval()\n    loss.backward()\n    model.train()\n",
        [2, 6],
        "def f():\n    model.eval()\n    model.train()\n    loss.backward()\ndef g():\n    loss.backward()\n    model.eval()\n",
    ),
    "ml/no-cuda-hardcoded": ("x.cuda()\ny = x.to('cuda:0')\nz = torch.zeros(1, device='cuda')\nd = torch.device('cuda')\n", [1, 2, 3, 4], "x.to(device)\nx.to('cpu')\nf('cuda')\nx.to('cuda0')\n"),
    "ml/dataloader-worker-seeding": ("DataLoader(d, num_workers=4)\ntorch.utils.data.DataLoader(d, num_workers=1)\n", [1, 2], "DataLoader(d, num_workers=0)\nDataLoader(d, num_workers=n)\nDataLoader(d, num_workers=2, generator=g)\nDataLoader(d)\n"),
    "ml/tensor-to-device-result-ignored": ("x.to(d)\nx.half()\nbatch.x.cuda()\n", [1, 2, 3], "x = x.to(d)\nmodel.to(d)\nself.cuda()\nx.to()\n"),
    "ml/deterministic-algorithms-opt-in": ("x = 1\nfor b in DataLoader(d):\n    loss.backward()\n", [2], "torch.backends.cudnn.deterministic = True\nloss.backward()\n"),
    "ml/require-global-seed": ("import numpy as np\nimport torch\nnp.random.seed(1)\nDataLoader(d)\n", [4], "import random\nimport torch\nfrom numpy import random as nr\nrandom.seed(1)\nnr.seed(1)\ntorch.manual_seed(1)\nDataLoader(d)\n"),
    "ml/pack-padded-sequence-before-rnn": (
        "def f(x):\n    out, (h, c) = self.lstm(x)\n    return h\ndef g(x):\n    r = gru(x)\n    return r[1]\ndef k(x):\n    return self.rnn(x)[1]\n",
        [2, 5, 8],
        "def f(x):\n    p = pack_padded_sequence(x)\n    out, h = self.lstm(p)\n    return h\ndef g(x):\n    out, _ = gru(x)\n    return out\ndef k(x):\n    r = gru(x)\n    return r[0]\n",
    ),
    "ml/inference-mode-required": (
        "def f(x):\n    return model(x)\ndef g(x):\n    model.eval()\n    with torch.no_grad(), torch.enable_grad():\n        return self.net(x)\ndef h(x):\n    with no_grad():\n        y = model.forward(x)\n    model.eval()\n",
        [2, 6, 9],
        "def f(x):\n    model.eval()\n    with torch.inference_mode():\n        with open(p) as f:\n            return model(x)\n@torch.no_grad()\ndef g(x):\n    net.eval()\n    return net.forward(x)\ndef t(x):\n    loss = model(x)\n    loss2 = (lambda z: model(z))\ndef b(x):\n    model(x)\n    z.backward()\ndef j(x):\n    torch.jit.trace.forward(x)\n",
    ),
    "ml/tf32-must-be-explicit": ("y = x.to(torch.device('cuda'))\nz = x.cuda()\ntorch.backends.cuda.matmul.allow_tf32 = True\n", [1], "torch.backends.cuda.matmul.allow_tf32 = True\ntorch.backends.cudnn.allow_tf32 = False\nx.cuda()\n"),
}


def run(spark, rule_id, *files):
    nodes = python_nodes(spark.createDataFrame(list(files), "path string, text string"))
    return engine.check(spark, {rule_id: ("warn", {})}, engine.Inputs({"python": lambda _: nodes}))


@pytest.mark.parametrize("rule_id", sorted(CASES))
def test_rule(spark, rule_id):
    bad, lines, good = CASES[rule_id]
    got = run(spark, rule_id, ("src/bad.py", bad), ("src/good.py", good), ("tests/test_bad.py", bad), ("src/broken.py", "def ("), ("src/empty.py", ""))
    rows = got.collect()
    assert [(r.file, r.start_line) for r in rows] == [("src/bad.py", n) for n in lines]
    assert all(r.severity == "warn" and r.rule_id == rule_id and r.message and r.suggestion for r in rows)


def test_late_seeds(spark):
    text = "import torch\nmodel = torch.nn.Linear(1, 1)\ntorch.manual_seed(1)\nloss.backward()\n"
    rows = run(spark, "ml/require-global-seed", ("a.py", text)).collect()
    assert [(r.start_line, r.message) for r in rows] == [(3, "Seed calls appear after the first DataLoader or torch.nn construction.")]


def test_network_in_tests(spark):
    bad = "m = resnet(pretrained=True)\nM.from_pretrained('x')\ntorch.hub.load('x')\nm = resnet(weights=W.DEFAULT)\nm = resnet(weights='x')\n"
    good = "m = resnet(pretrained=False)\nm = resnet(weights=None)\njson.load(f)\n"
    rows = run(spark, "ml/no-network-in-tests", ("tests/a.py", bad), ("tests/b.py", good), ("src/a.py", bad)).collect()
    assert [(r.file, r.start_line) for r in rows] == [("tests/a.py", n) for n in range(1, 6)]


def test_init_lists_public_names(spark):
    text = "def f(a):\n    pass\ndef g(a):\n    pass\n"
    files = [("a/__init__.py", "__all__ = ['f']\n" + text), ("b/__init__.py", text), ("c/__init__.py", "__all__ = ['f']\n__all__ += ['g']\n" + text)]
    rows = run(spark, "python/require-typed-public", *files).collect()
    assert [(r.file, r.start_line, r.start_col, r.end_col) for r in rows] == [("a/__init__.py", 2, 5, 6)]


def test_exports_need_tests(spark):
    files = {
        "pkg/__init__.py": "from .a import f, g as renamed\nfrom .b import h\n_hidden = h\nalias = h\nother = unknown\n",
        "pkg/listed/__init__.py": "from ..a import f, g\n__all__ = ['f', 'g', '_x']\n",
        "pkg/loud/__init__.py": "__all__ = ['z']\n__all__ += ['y']\n",
        "pkg/a.py": "def f():\n    pass\ndef g():\n    pass\n",
        "pkg/b.py": "def h():\n    pass\n",
        "tests/test_x.py": "from pkg.a import f\nimport pkg.b as b\nb.h()\n",
    }
    known = spark.createDataFrame(list(files.items()), "path string, text string")
    nodes, packages = python_nodes(known), package_roots(known, known.limit(0))
    rows = engine.check(spark, {"python/public-exports-tested": ("error", {})}, engine.Inputs({"python": lambda _: nodes, "packages": lambda _: packages})).collect()
    assert [(r.file, r.start_line, r.message.split('"')[1]) for r in rows] == [("pkg/__init__.py", 1, "renamed"), ("pkg/__init__.py", 5, "other"), ("pkg/listed/__init__.py", 2, "g")]


def test_report_and_status(spark):
    rows = run(spark, "python/no-bare-except", ("a.py", CASES["python/no-bare-except"][0]))
    assert exit_status(rows) == 1 and exit_status(rows.limit(0)) == 0
    assert report_lines(rows).first()[0].startswith("a.py:3:1  warn  python/no-bare-except  Bare except")


def test_settings():
    enabled = engine.settings(["python", "ml"], {"ml/no-cuda-hardcoded": "off", "python/no-bare-except": ["warn", {}]})
    assert "ml/no-cuda-hardcoded" not in enabled and enabled["python/no-bare-except"][0] == "warn"
    assert set(engine.filtered(enabled, plugins=["ml"], names=["ml/optimizer-zero-grad"])) == {"ml/optimizer-zero-grad"}
    assert not [k for k in engine.filtered(enabled, without=["ml"]) if k.startswith("ml/")]
    for bad in (lambda: engine.settings(["nope"], {}), lambda: engine.settings([], {"x/y": "error"}), lambda: engine.settings(["ml"], {"ml/no-cuda-hardcoded": "loud"}), lambda: engine.filtered(enabled, names=["ml/no-cuda-hardcoded"])):
        with pytest.raises(engine.ConfigError):
            bad()
    number = {"type": "object", "additionalProperties": False, "properties": {"t": {"type": "number", "exclusiveMinimum": 0, "maximum": 1}}}
    assert engine.validated(number, {"t": 1}, "x") == {"t": 1}
    for bad in ({"t": 0}, {"t": 2}, {"t": "a"}, {"u": 1}, {"t": True}, []):
        with pytest.raises(engine.ConfigError):
            engine.validated(number, bad, "x")


def test_schemas_and_required_options():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "string"}}}}
    assert engine.validated(schema, {"a": ["x"], "more": 1}, "r") == {"a": ["x"], "more": 1}
    for bad in ({}, {"a": [1]}, {"a": "x"}):
        with pytest.raises(engine.ConfigError):
            engine.validated(schema, bad, "r")
    for bad in ({"type": "array"}, {"type": "array", "items": {"type": "number"}}, {"type": "integer"}, {"type": "string", "pattern": "a"}, {"type": "object", "required": "a"}, {"type": "number", "minimum": "0"}, {"type": "object", "additionalProperties": {"type": "string"}}):
        with pytest.raises(engine.ConfigError):
            engine.compiled(bad, "r")


def test_providers_of_plugins():
    a, b = (lambda _: None), (lambda _: None)
    assert engine.provided({"python": a, "files": a}, {"p": {"python": b}}) == {"python": b, "files": a}
    with pytest.raises(engine.ConfigError, match="p and q"):
        engine.provided({}, {"p": {"x": a}, "q": {"x": b}})


def test_sources_are_parsed_once(spark):
    """All python/ and ml/ rules of a check read one table of nodes: none of their plans parses."""
    nodes = python_nodes(spark.createDataFrame([("a.py", "def f(a=[]):\n    try:\n        g()\n    except:\n        pass\n")], "path string, text string"))
    packages = spark.createDataFrame([("a.py", "")], "file string, package_dir string")
    inputs = engine.Inputs({"python": lambda _: nodes, "packages": lambda _: packages})
    enabled = {k: ("error", {}) for k, r in engine.RULES.items() if set(r.requires) <= {"python", "packages"}}
    assert len(enabled) > 18
    plan = engine.check(spark, enabled, inputs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in nodes._jdf.queryExecution().optimizedPlan().toString() and "run(path" not in plan
