"""Token rules and import edges."""

import pytest

from plumbline.operators.graphs import resolved_imports
from plumbline.plans import engine, typescript_rules  # noqa: F401
from plumbline.sources import typescript

CASES = {
    "ts/no-empty-catch": (
        "try { f() } catch (e) { /* quiet */ }\ntry { f() } catch {\n  // nothing\n}\ntry { f() } catch ({ message }) {}\n",
        [1, 2, 5],
        "try { f() } catch (e) { g(e) }\np.catch(() => {})\n// catch {}\nconst s = 'catch {}'\n",
    ),
    "ts/no-export-star": ("export * from './a'\nexport * as b from './b'\nexport type * from './c'\n", [1, 2, 3], "export { a } from './a'\nimport * as b from './b'\nexport const c = a * from\n"),
    "ts/no-non-null-assertion": ("const a = b!.c\nf(x!)\nconst d = g()! + h[0]!\n", [1, 2, 3, 3], "if (!a) {}\nconst b = a != c\nlet x!: string\nreturn !y\nconst t = `a!`\n"),
    "dev/concrete-suggestion": (
        "context.report({ file, suggestion: NO_SUGGESTION });\nreport({\n  suggestion: core.NO_SUGGESTION,\n});\nreport({ suggestion: 'No suggestion available for this rule.' })\n",
        [1, 3, 5],
        "report({ suggestion: 'Do this.' })\nconst x = { suggestion: NO_SUGGESTION }\nreport(x)\nreport({ suggestion: NO_SUGGESTION + 'x' })\n",
    ),
    "ts/no-unsafe-assertion": ("const a = b as any\nconst c = d as unknown as T\nconst e = (f as unknown) as T\nconst g = <any>h\n", [1, 2, 3, 4], "const a = b as unknown\nconst c = d as Any\nimport { as } from './any'\nconst s = 'x as any'\nconst m = new Map<any>()\n"),
}


def tokens(spark, *files):
    return typescript.typescript_tokens(spark.createDataFrame(list(files), "path string, text string"))


@pytest.mark.parametrize("rule_id", sorted(CASES))
def test_rule(spark, rule_id):
    bad, lines, good = CASES[rule_id]
    found = tokens(spark, ("src/bad.ts", bad), ("src/good.ts", good), ("src/a.test.ts", bad), ("src/a.d.ts", bad), ("src/a.py", bad), ("src/empty.ts", ""))
    got = engine.check(spark, {rule_id: ("error", {})}, engine.Inputs({"typescript": lambda _: found})).collect()
    assert [(r.file, r.start_line) for r in got] == [("src/bad.ts", n) for n in lines]


def test_lexer():
    text = "a /* x */ = b / c; r = /[/]\\/x/g.test(`a${ {b: '}'} }c`) // end\n'it\\'s'"
    assert [text[a:b] for _, a, b in typescript.lexed(text)] == ["a", "=", "b", "/", "c", ";", "r", "=", "/[/]\\/x/g", ".", "test", "(", "`a${ {b: '}'} }c`", ")", "'it\\'s'"]


def test_import_edges(spark):
    found = tokens(spark, ("src/a/m.ts", "import x from './n'\nexport { y } from '../b'\nimport 'lib'\nimport './side.ts'\n"), ("src/a/n.ts", ""), ("src/b/index.ts", ""), ("src/a/side.ts", ""))
    known = spark.createDataFrame([("src/a/m.ts",), ("src/a/n.ts",), ("src/b/index.ts",), ("src/a/side.ts",)], "path string")
    edges = resolved_imports(typescript.imports(found), known)
    assert sorted((r.u, r.v) for r in edges.collect()) == [("src/a/m.ts", "src/a/n.ts"), ("src/a/m.ts", "src/a/side.ts"), ("src/a/m.ts", "src/b/index.ts")]
