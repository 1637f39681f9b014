"""Rules over TypeScript declarations, on files that break and keep them."""

from plumbline.plans import engine, typescript_exports
from plumbline.sources import typescript_decls as T


def check(spark, rule_id, files):
    known = spark.createDataFrame(list(files.items()), "path string, text string")
    inputs = {"declarations": T.declarations(known), "import_names": T.import_names(known), "call_sites": T.call_sites(known), "files": known}
    rows = engine.check(spark, {rule_id: ("error", {})}, engine.Inputs({k: (lambda v: lambda _: v)(v) for k, v in inputs.items()})).collect()
    return [(r.file, r.start_line, r.start_col, r.message) for r in rows]


DECLARED = """export function f(a: any) { return 1 }
export function g(a: number): { y: any } { return { y: 1 } }
export const h = async (x: Function) => x + 1, k: any[] = [];
export const typed: (a: number) => void = (a) => { };
const hidden = () => 1;
export class A<T> extends B {
  private p() { }
  m<T>(a: any) { return a }
  get v() { return 1 }
  get w(): number { return 1 }
  #own() { }
}
export default (a) => a;
export declare function d(a: Object);
export const w = y as any;
"""


def test_return_types(spark):
    got = check(spark, "ts/explicit-public-return-types", {"a.ts": DECLARED, "a.test.ts": DECLARED, "b.d.ts": DECLARED})
    assert [(n, c, m.split('"')[1]) for _, n, c, m in got] == [(1, 17, "f"), (3, 18, "h"), (8, 3, "A.m"), (9, 7, "A.v"), (13, 16, "default")]


def test_public_any(spark):
    got = check(spark, "ts/no-public-any", {"a.ts": DECLARED})
    assert [(n, m.split('"')[1]) for _, n, _, m in got] == [(1, "f"), (3, "h"), (3, "k"), (14, "d"), (15, "w")]


def test_exports_are_tested(spark):
    files = {
        "src/a.ts": "export const a = 1, b = 2;\nexport function c() {}\nexport default class D {}\nconst x = 1;\nexport { x, x as y, type Z };\nexport enum E { A }\nexport interface I {}\nexport type { Q } from './q';\n",
        "src/lib/index.ts": "export const inner = () => 1;\nexport * from './z';\n",
        "src/a.test.ts": "import D, { a, c as see } from './a.js';\nimport * as all from './a';\nimport { inner } from './lib';\nimport { b } from 'pkg';\n",
        "src/__tests__/t.ts": "import { x } from '../a';\n",
    }
    got = check(spark, "ts/public-exports-tested", files)
    assert [(f, n, m.split('"')[1]) for f, n, _, m in got] == [("src/a.ts", 1, "b"), ("src/a.ts", 5, "y"), ("src/a.ts", 6, "E")]


def test_effects_do_not_fetch(spark):
    files = {
        "a.tsx": "import React, { useEffect as ue } from 'react';\nimport ax, { create } from 'axios';\nue(() => {\n  fetch('/a');\n  ax.get('/b');\n  (async () => { await ax('/c') })();\n  const later = () => fetch('/d');\n  on(function () { fetch('/e') });\n}, []);\nReact.useLayoutEffect(async function () { create() });\nue(load);\nfetch('/f');\n",
        "b.tsx": "import { useEffect } from 'react';\nfunction fetch() {}\nuseEffect(() => fetch());\n",
        "c.tsx": "import { useEffect } from 'other';\nuseEffect(() => fetch('/x'));\n",
        "d.tsx": "import { useEffect } from 'react';\nuseEffect(() => fetch('/x'), []);\n",
    }
    got = check(spark, "react/no-fetch-in-useeffect", files)
    assert [(f, n, m.split(" ")[3]) for f, n, _, m in got] == [("a.tsx", 4, "fetch"), ("a.tsx", 5, "ax.get"), ("a.tsx", 6, "ax"), ("a.tsx", 10, "create"), ("d.tsx", 2, "fetch")]


def test_chunks(spark):
    body = "{\n" + "".join(f"  const x{k} = call{k}(a, b);\n" for k in range(6)) + "}"
    files = {
        "a.ts": f"class A {{\n  go(a: number) {body}\n  constructor() {body}\n  short() {{ }}\n}}\nexport const arrow = (a) => {body};\nfunction plain() {body}\n",
        "a.test.ts": f"function plain() {body}\n",
    }
    known = spark.createDataFrame(list(files.items()), "path string, text string")
    got = typescript_exports.typescript_chunks(T.declarations(known)).collect()
    assert sorted((r.name, r.line) for r in got) == [("A", 1), ("A.constructor", 10), ("A.go", 2), ("arrow", 20), ("plain", 28)]
    assert len({r.hash for r in got}) == 5 and {r.text for r in got if r.name == "plain"} == {f"function plain() {body}"}


def test_odd_sources_do_not_break_the_scan():
    for text in ("", "class", "export", "export {", "const = ;", "function (", "=> }", "export default", "class A { get", "import", "a<b>(", "`${`", "}{)("):
        scan = T.Scan("x.ts", text)
        scan.run(), T.called(scan), T.imported_names(scan)
