"""Defs and classes that do and do not pay for their indirection, on small packages."""

from plumbline.plans import indirection_rules  # noqa: F401
from plumbline.sources.python_ast import flat

from .test_provenance_rules import check

BIG = "".join(f"    x{k} = {k}\n" for k in range(11))


def test_defs(spark):
    files = {
        "pkg/a.py": "def unused():\n    return f()\ndef once():\n    return g()\ndef twice():\n    return 1\ndef long():\n" + BIG + "def loop():\n    for x in y:\n        if x:\n            return x\n    for z in (1,\n            2,\n            3,\n            4,\n            5,\n            6,\n            7):\n        while z:\n            pass\n"
        "def read():\n    return 1\ntable = [read]\nonce()\ntwice(), twice()\ndef selfish():\n    return selfish()\n",
        "pkg/b.py": "from a import twice as t, once\nimport a\na.once()\nt()\ndef __special__():\n    return 1\n",
        "pkg/__init__.py": "def quiet():\n    return 1\n",
        "pkg/c.py": "class A:\n    def m(self):\n        return self.n()\n    def n(self):\n        return 1\n    def lonely(self):\n        return 1\nclass B(external.Base):\n    def hook(self):\n        return 1\nclass C(A):\n    def m(self):\n        return 1\n",
        "pkg/d.py": "class D:\n    part = A\n    def __init__(self):\n        self.tool = E()\n    def go(self):\n        self.tool.run()\n        self.part.lonely()\n        self.part.lonely()\nclass E:\n    def run(self):\n        return 1\nx.m()\nD().go()\n",
        "pkg/test_a.py": "unused()\n",
    }
    got = check(spark, "python/no-unnecessary-def", files)
    names = [(f, m.split('"')[1], "not used" in m) for f, _, m in got]
    assert names == [("pkg/a.py", "unused", True), ("pkg/a.py", "selfish", True), ("pkg/c.py", "n", False), ("pkg/d.py", "go", False), ("pkg/d.py", "run", False)]


def test_classes(spark):
    files = {
        "pkg/a.py": "class Thin:\n    x = 1\n    def f(self):\n        pass\nclass Used:\n    pass\nclass Based(Used):\n    pass\nUsed()\nclass Real:\n    def __init__(self):\n        self.x = 1\nclass Special:\n    def __eq__(self, o):\n        pass\n    def __hash__(self):\n        pass\n"
        "class Meta(metaclass=M):\n    pass\nclass One:\n    '''text'''\n    def run(self):\n        return go()\nclass Read:\n    pass\nkinds = [Read]\nclass Plain(object):\n    pass\ndef f():\n    class Inner:\n        pass\nclass Loose:\n    self.x = 1\n",
        "pkg/b.py": "from a import One as O, Plain\nimport a\nO()\na.Plain()\nPlain()\n",
    }
    got = check(spark, "python/no-unnecessary-class", files)
    assert [(n, m.split('"')[1], "not inst" in m) for _, n, m in got] == [(1, "Thin", True), (20, "One", False)]


def test_bodies():
    import ast

    text = "async def f():\n    return await (await g())\ndef h():\n    if a:\n        pass\n    elif b:\n        pass\ndef k():\n    if a:\n        while b:\n            pass\ndef m():\n    '''doc'''\n    return g()\n"
    rows = {r[8]: r[-1] for r in flat("x", ast.parse(text), text) if r[7].endswith("FunctionDef")}
    assert rows == {"f": ["passes", "small"], "h": ["small"], "k": [], "m": ["small"]}
