"""Rules on hash functions, on files that break and keep them."""

from plumbline.plans import fingerprint_rules  # noqa: F401
from plumbline.sources.python_ast import core_of

from .test_provenance_rules import check

CONFIG = "class Base:\n    seed: int\n    kind: ClassVar[str] = 'x'\n    __slots__: tuple\nclass Config(Base):\n    lr: float\n    depth: int = 3\n    plain = 1\n"


def test_every_field_is_read(spark):
    files = {
        "src/pkg/conf.py": CONFIG,
        "src/pkg/h.py": "from conf import Config\ndef key(config: Config):\n    return part(1, config) + config['depth']\ndef part(n, c):\n    return deep(x=c)\ndef deep(x):\n    return far(x) + getattr(x, 'seed')\ndef far(y):\n    return y.lr\n"
        "def good(self, c: 'Config' | None = None):\n    pass\ndef fine(cfg: Optional[Config]):\n    return cfg.lr, cfg.depth, cfg.seed\nclass K:\n    def hash(self, c: Config):\n        return c.lr\n",
    }
    rule_id, named = "fingerprint/hash-covers-every-config-field", ["pkg.h.key", "pkg.h.fine", "pkg.h.K.hash", "pkg.h.good", "nowhere.f"]
    got = check(spark, rule_id, files, {"hashFunctions": named})
    assert got == [("src/pkg/h.py", 2, 'Hash function "pkg.h.key" does not read config fields: lr.'), ("src/pkg/h.py", 15, 'Hash function "pkg.h.K.hash" does not read config fields: depth, seed.')]
    assert check(spark, rule_id, files, {"hashFunctions": named, "excludeFields": {"Config": ["lr", "depth", "seed"]}}) == []
    assert check(spark, rule_id, {"a.py": "x = 1\n"}) == [("a.py", 1, f"{rule_id} is enabled but hashFunctions is empty.")]


def test_versions_go_into_the_payload(spark):
    files = {
        "a.py": "def one(c):\n    h.update(dumps({'schema_version': 2}))\ndef two(c):\n    x = SCHEMA_VERSION\n    return sha256(c)\ndef three(c):\n    return help_(c)\ndef help_(c):\n    return md5(c + GIT_SHA + MY_VERSION)\ndef four(c):\n    return hash(x=c.rev)\n",
    }
    names = {"hashFunctions": ["a.one", "a.two", "a.three", "a.four"]}
    assert [n for _, n, _ in check(spark, "fingerprint/versioned-hash-payload", files, names)] == [3, 10]
    assert [n for _, n, _ in check(spark, "fingerprint/versioned-hash-payload", files, names | {"versionKeys": ["rev"]})] == [3]
    assert [n for _, n, _ in check(spark, "fingerprint/hash-includes-code-version", files, names)] == [1, 3, 10]
    assert [n for _, n, _ in check(spark, "fingerprint/hash-includes-code-version", files, names | {"codeVersionNames": ["rev"]})] == [1, 3]


def test_types_without_their_wrapping():
    import ast

    core = lambda text: core_of(ast.parse(text, mode="eval").body)
    assert [core(t) for t in ("A", "m.A", "Optional[A]", "t.Union[A, None]", "Union[A, B]", "A | None", "None | m.A", "list[A]", "Optional[A | None]")] == ["A", "A", "A", "A", None, "A", "A", None, "A"]
