"""The lexer on code that misleads one: regular expressions, nested templates, patterns, decorators, and very long texts."""

import pytest
from pyspark.sql import functions as F

from loam.operators import language as L
from loam.operators import source as Z


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def offered(spark, code):
    return [tuple(x) for x in one(spark, code, Z.exports)]


def taken(spark, code):
    return [tuple(x) for x in one(spark, code, Z.imports)]


SLASHES = [
    "const r = s.replace(/\\/*$/, '')", "return /[/]*'\"`/g", "const a = x / y; // '", "if (!/\\s*\\/\\//.test(q)) z()", "const n = i++ / 2 / k /* ' */", "f(a, /`/y, b)", "ok = v\n  ? /\"/\n  : /'/u", "x = `a ${b ? `//${'}'}` : `/*`} c`",
    "const o = { k: /['\"]/ }", "y => /'/", "[/`/][0]", "w = (1 + 2) / 3 // `", "case /'/.test(a):", "`${'`'}` + `\\``",
]


@pytest.mark.parametrize("line", SLASHES)
def test_nothing_is_swallowed(spark, line):
    code = f"{line}\nimport {{ first }} from './first'\nexport const kept = 1\nexport * from './rest'\n"
    at = line.count("\n") + 3
    assert taken(spark, code) == [("./first", ["first"], False)]
    assert offered(spark, code) == [("kept", at)]
    assert one(spark, code, Z.stars) == ["./rest"]
    assert one(spark, code, Z.blank_comments).count("\n") == code.count("\n")


def test_strings_hold_no_imports(spark):
    code = "const t = \"import a from 'b'\" + `require('c') ${import('./d')} ` // require('e')\nconst r = /import('f')/\nrequire('g' + h)\nimport(`./i`)\n"
    assert taken(spark, code) == [("./i", [], True)]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("export const { p: { q, r: [s, , ...t] }, u = { v: 1, w: [2] }, ...x } = y", [(n, 1) for n in "qstux"]),
        ("if (a) {\n  f()\n}\n  export const deep = 1\n\texport function soft() {}", [("deep", 4), ("soft", 5)]),
        ("@Part({ a: [1] }) export class Wheel {}\nexport @Part() @Other class Axle {}", [("Wheel", 1), ("Axle", 2)]),
        ("export let one = 1\n  , two = 2\n  , three\nother(), four = 4", [("one", 1), ("two", 2), ("three", 3)]),
        ("export const big = {\n  a: [1, 2],\n  b() { return { c, d } },\n}, small = (x, y) => {\n  z(x, y)\n}, last = q < 1, end", [("big", 1), ("small", 4), ("last", 6), ("end", 6)]),
        ("export const typed: Map<string, Set<number>> = make<A, B>(1), fn: (a: number, b: string) => void = g\nexport var v!: string, w", [("typed", 1), ("fn", 1), ("v", 2), ("w", 2)]),
        ("namespace N {\n  export const inner = 1\n}\ndeclare module 'm' { export function no(): void }\nexport { N }", [("N", 5)]),
        ("export default class Named {}\nexport abstract class Base {}\nexport declare namespace Space {}\nexport = nothing\nmodule.export = x\nconst export_ = 1", [("default", 1), ("Base", 2), ("Space", 3)]),
        ("export type { T, U as V } from './t'\nexport { type A, b as default }\nexport type Pair<X, Y> = [X, Y]", [("T", 1), ("V", 1), ("A", 2), ("default", 2), ("Pair", 3)]),
        ("export const text = `\n  export const no = 1\n`, after = 2; export const beside = 3", [("text", 1), ("after", 3), ("beside", 3)]),
        ("export const {\n  lower,\n  'quoted-key': upper,\n  [computed]: third,\n} = o", [("lower", 2), ("upper", 3), ("third", 4)]),
        ("", []), ("export", []), ("export const", []), ("export {", []),
    ],
)
def test_exports_of_all_forms(spark, code, want):
    assert offered(spark, code) == want


def test_branches_in_literals_do_not_count(spark):
    assert one(spark, "const a = /x||y?z&&/.test(b) ? 1 : 2\nconst t = `${p && q}`\n// if", Z.cyclomatic) == 2


def test_very_long_texts(spark):
    code = "x = '" + "a\\n" * 100_000 + "'\nimport 'end'\n/* " + "long * / " * 50_000 + "*/ export const far = `" + "y${1}" * 50_000 + "`, more = {" + "a: { b: 1 }, " * 20_000 + "}, last = 2"
    assert taken(spark, code) == [("end", [], False)]
    assert offered(spark, code) == [("far", 3), ("more", 3), ("last", 3)]
    assert one(spark, None, Z.exports) is None and one(spark, None, Z.imports) is None


def test_a_file_behind_a_regular_expression_is_alive(spark):
    files = {
        "src/index.ts": "const bare = (s) => s.replace(/\\/*$/, '')\nimport { part } from './part.js'\nexport const main = part",
        "src/part.ts": "const q = /[\"'`]/\n  export const part = 1,\n    idle = 2",
    }
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    manifests = table({"package.json": '{"main": "./dist/index.js"}'}).withColumnRenamed("content", "text")
    found = L.analyze(L.scan_files(table(files)), manifests, manifests.limit(0))
    assert [tuple(r) for r in found["edges"].select("from", "to").collect()] == [("src/index.ts", "src/part.ts")]
    assert [tuple(r) for r in found["dead_code"].collect()] == [("src/part.ts", "idle", 3, "unreferenced-export")]
