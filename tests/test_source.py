"""Lexical facts of sources and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from loam.operators import source as Z


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("const a = 1\nf(a)", 1), ("do { x() } while (y)", 2), ("const z = b && c || d ?? e", 4), ("const t = a ? b : c", 2), ("x ||= 1", 2), ("a?.b?.(c)\nfunction f(p?: string) {}", 1),
        ("// if (a) && b\nconst s = 'if (x) ? 1 : 2'", 1), ("switch (a) { case 1: break; default: }", 2), ("for (const a of b) { if (c) { try { d() } catch (e) {} } }", 4),
    ],
)
def test_cyclomatic(spark, code, want):
    assert one(spark, code, Z.cyclomatic) == want


def test_imports(spark):
    code = """import a from './a'
import { b, c as d, type T } from "./b"
import * as ns from './ns'
import './side'
import type { U } from './u'
import x = require('./x')
const y = require('./y'), z = await import('./z')
export { q as r } from './q'
// import no from './no'
const s = `import ${no} from`
"""
    got = [(r["spec"], r["names"], r["namespace"]) for r in one(spark, code, lambda c: Z.imports(Z.blank_comments(c)))]
    assert got == [
        ("./a", ["default"], False), ("./b", ["b", "c", "T"], False), ("./ns", [], True), ("./side", [], False), ("./u", ["U"], False), ("./x", [], True), ("./y", [], True), ("./z", [], True), ("./q", ["q"], False),
    ]


def test_exports(spark):
    code = "export const a = 1\nexport default function f() {}\nexport { x, y as z }\nexport * as ns from './n'\nexport * from './s'\nexport type T = 1\n  export const inner = 2\n/*\nexport const no = 1 */\nexport async function g() {}"
    got = [(r["name"], r["line"]) for r in one(spark, code, lambda c: Z.exports(Z.blank_comments(c)))]
    assert got == [("a", 1), ("default", 2), ("x", 3), ("z", 3), ("ns", 4), ("T", 6), ("inner", 7), ("g", 10)]
    assert one(spark, code, Z.stars) == ["./s"]


def test_scan(spark):
    r = Z.scan(spark.createDataFrame([("a.ts", "import './b'\nif (x) {}\n"), ("e.ts", "")], "path string, content string")).orderBy("path").collect()
    assert [(x["path"], x["loc"], x["complexity"], len(x["imports"])) for x in r] == [("a.ts", 3, 2, 1), ("e.ts", 1, 1, 0)]


def test_manifests(spark):
    text = '{\n  "main": "./dist/index.js", // entry\n  "exports": {".": {"import": "./lib/a.mjs"}},\n  "scripts": {"go": "node tools/run.ts --x"},\n  "dependencies": {\n    "left": "1",\n    "right": "2",\n  },\n}'
    df = spark.createDataFrame([("package.json", text)], "path string, text string").withColumn("text", Z.strict_json(F.col("text")))
    assert json.loads(df.first()["text"])["dependencies"] == {"left": "1", "right": "2"}
    assert [tuple(r) for r in Z.dependencies(df).collect()] == [("package.json", "left", 6), ("package.json", "right", 7)]
    assert sorted(r["value"] for r in Z.entry_values(df).collect()) == ["./dist/index.js", "./lib/a.mjs", "tools/run.ts"]
