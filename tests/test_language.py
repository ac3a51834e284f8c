"""The static half of an analysis on small repositories, and what it is built from."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loam import engine
from loam.functions import js
from loam.operators import graph as G
from loam.operators import language as L
from loam.operators import modules as M
from loam.operators import source as Z
from loam.operators import text as X
from loam.operators import views as V

PACKAGE = json.dumps({"name": "demo", "main": "./dist/index.js", "dependencies": {"used": "^1.0.0", "unused": "^1.0.0"}}, indent=2)


def run(spark, sources, tracked):
    files = spark.createDataFrame(list(sources.items()), "path string, content string")
    table = lambda keep: spark.createDataFrame([(k, v) for k, v in tracked.items() if keep(k)], "path string, text string")
    return L.analyze(L.scan_files(files), table(lambda k: k.endswith("package.json")), table(lambda k: not k.endswith("package.json")))


def dead(out):
    return [tuple(r) for r in V.sorted_findings(out["dead_code"]).select("path", "symbol", "line", "reason").collect()]


def test_three_shapes_of_dead_code(spark):
    out = run(
        spark,
        {
            "src/index.ts": "import { greet } from './greet.js';\nimport 'used';\nexport function main() { return greet(); }",
            "src/greet.ts": 'export function greet() { return "hi"; }\nexport function shout() { return "HI"; }', "src/orphan.ts": "export const nobody = 1;",
        },
        {"package.json": PACKAGE},
    )
    assert dead(out) == [("package.json", "unused", 6, "unused-dependency"), ("src/greet.ts", "shout", 2, "unreferenced-export"), ("src/orphan.ts", None, None, "unreachable-file")]
    assert {(r["path"], r["loc"], r["complexity"], r["duplication"]) for r in out["code_metrics"].collect()} == {("src/index.ts", 3, 1, 0.0), ("src/greet.ts", 2, 1, 0.0), ("src/orphan.ts", 1, 1, 0.0)}


def test_aliases_lazy_imports_and_barrels(spark):
    config = {"tsconfig.base.json": '{"compilerOptions": {"paths": {"@app/*": ["src/*"],},}} // base', "tsconfig.json": '{"extends": "./tsconfig.base"}'}
    out = run(
        spark,
        {"src/main.ts": "import { user } from '@app/user.js';\nexport const open = () => import('./panel.js');", "src/user.ts": "export const user = 1;", "src/panel.ts": "export const panel = 2;"},
        {"package.json": '{ "name": "demo", "main": "./dist/main.js" }', **config},
    )
    assert sorted((r["from"], r["to"]) for r in out["edges"].collect()) == [("src/main.ts", "src/panel.ts"), ("src/main.ts", "src/user.ts")]
    assert dead(out) == []
    out = run(spark, {"src/index.ts": "export { helper } from './helper.js';\nexport * from './all'", "src/helper.ts": "export const helper = 1;", "src/all.ts": "export const x = 1"}, {"package.json": '{"main": "./dist/index.js"}'})
    assert sorted((r["from"], r["to"]) for r in out["edges"].collect()) == [("src/index.ts", "src/all.ts"), ("src/index.ts", "src/helper.ts")]
    assert dead(out) == []


def test_summary_and_cycles(spark):
    sources = {
        "src/index.ts": "import { a } from './a.js';\nimport { b } from './b.js';\nexport const main = () => a + b;", "src/a.ts": "import { shared } from './shared.js';\nexport const a = shared;",
        "src/b.ts": "import { shared } from './shared.js';\nexport const b = shared;", "src/shared.ts": "export const shared = 1;",
    }
    out = run(spark, sources, {"package.json": '{"main": "./dist/index.js"}'})
    assert tuple(out["summary"].first()) == (4, 4, 0, 0, "src/shared.ts", 2, "src/index.ts", 2)
    out = run(spark, {"src/a.ts": "import { b } from './b.js';\nexport const a = () => b();", "src/b.ts": "import { a } from './a.js';\nexport const b = () => a();"}, {})
    assert (out["summary"].first()["cycles"], out["summary"].first()["cycle_nodes"]) == (1, 2)
    assert dead(out) == []  # no entry point, so nothing is said about exports


def test_workspace_packages_and_entries(spark):
    files = spark.createDataFrame([(p,) for p in ("packages/sdk/src/index.ts", "packages/sdk/src/deep.ts", "packages/core/src/main.ts", "lib2/index.js", "a/b/src/c.ts", "x.config.ts", "t/__tests__/u.ts")], "path string")
    imports = spark.createDataFrame([("packages/core/src/main.ts", s) for s in ("@s/sdk", "@s/sdk/deep", "@s/none", "./main")], "path string, spec string")
    packages = spark.createDataFrame([("@s/sdk", "packages/sdk")], "name string, folder string")
    assert {(r["spec"], r["to"]) for r in M.resolve(imports, files, packages=packages).collect()} == {("@s/sdk", "packages/sdk/src/index.ts"), ("@s/sdk/deep", "packages/sdk/src/deep.ts"), ("./main", "packages/core/src/main.ts")}
    manifests = spark.createDataFrame([("package.json",), ("packages/sdk/package.json",), ("lib2/package.json",)], "path string")
    values = spark.createDataFrame([("package.json", "./a/b/dist/c.d.ts"), ("package.json", "../out.js"), ("lib2/package.json", "no.js")], "path string, value string")
    assert sorted(r["path"] for r in M.entry_points(files, manifests, values).collect()) == ["a/b/src/c.ts", "lib2/index.js", "packages/sdk/src/index.ts", "t/__tests__/u.ts", "x.config.ts"]


def scopes(spark, configs):
    folders, aliases = M.alias_scopes(spark.createDataFrame([(k, json.dumps(v)) for k, v in configs.items()], "path string, text string"))
    return sorted(tuple(r) for r in folders.collect()), sorted((r["folder"], r["pattern"], r["targets"]) for r in aliases.collect())


def test_configurations_extend_each_other(spark):
    paths = lambda *t: {"compilerOptions": {"paths": {"@app/*": list(t)}}}
    assert scopes(spark, {"tsconfig.base.json": paths("packages/*/src"), "apps/web/tsconfig.json": {"extends": "../../tsconfig.base"}}) == ([("apps/web", None)], [("apps/web", "@app/*", ["packages/*/src"])])
    assert scopes(spark, {"tsconfig.base.json": paths("packages/*"), "tsconfig.json": {"extends": "./tsconfig.base.json"} | paths("src/*")})[1] == [("", "@app/*", ["src/*"])]
    assert scopes(spark, {"tsconfig.json": {"compilerOptions": {"baseUrl": "./src"}}}) == ([("", "src")], [])
    assert scopes(spark, {"tsconfig.json": {"extends": "@tsconfig/node24/tsconfig.json"}, "api/tsconfig.build.json": paths("src/*")}) == ([], [])
    assert scopes(spark, {"tsconfig.json": {"extends": "./tsconfig.json"} | paths("src/*")})[1] == [("", "@app/*", ["src/*"])]
    # of several, the later one; what both extend counts where it is reached first
    many = {"tsconfig.json": {"extends": ["./a.json", "./b.json"]}, "a.json": {"extends": "./c.json"} | paths("a/*"), "b.json": {"extends": "./c.json"}, "c.json": paths("c/*")}
    many = {("tsconfig." + k if k != "tsconfig.json" else k): (v | {"extends": [x.replace("./", "./tsconfig.") for x in v["extends"]]} if isinstance(v.get("extends"), list) else v | ({"extends": v["extends"].replace("./", "./tsconfig.")} if "extends" in v else {})) for k, v in many.items()}
    assert scopes(spark, many)[1] == [("", "@app/*", ["a/*"])]
    files = spark.createDataFrame([("src/shared/user.ts",), ("src/page.ts",)], "path string")
    folders = spark.createDataFrame([("", "src")], "folder string, base string")
    aliases = spark.createDataFrame([], "folder string, pattern string, seq int, targets array<string>")
    got = M.resolve(spark.createDataFrame([("src/page.ts", "shared/user")], "path string, spec string"), files, aliases, scopes=folders)
    assert [tuple(r) for r in got.collect()] == [("src/page.ts", "shared/user", "src/shared/user.ts")]


EXPORTS = [
    (
        "export const a = 1;\nexport let b = 2;\nexport function c() {}\nexport async function* d() {}\nexport class E {}\nexport abstract class F {}\nexport interface G {}\nexport type H = string;\nexport enum I {}\nexport const enum J {}\nexport declare const k: number;",
        [(n, k + 1) for k, n in enumerate("abcdEFGHIJk")],
    ),
    ("export const a = 1,\n  b = 2;\nexport const { c, d: e, f = 3 } = obj;\nexport const [g, ...rest] = list;", [("a", 1), ("b", 2), ("c", 3), ("e", 3), ("f", 3), ("g", 4), ("rest", 4)]),
    ("export default function helper() {}", [("default", 1)]), ("export default { a: 1 };", [("default", 1)]), ("export {\n  local,\n  hidden as shown,\n};", [("local", 2), ("shown", 3)]),
    ("export { a, b as c } from './x.js';\nexport * as ns from './y.js';\nexport * from './z.js';\nexport type { T } from './t.js';", [("a", 1), ("c", 1), ("ns", 2), ("T", 4)]),
    ("export namespace Outer {\n  export const inner = 1;\n}", [("Outer", 1)]), ("const s = `\n${x}\n`;\nexport const open = () => import('./p');\nexport const m: Map<string, number> = new Map([[1, 2]]), n = f(a, b)", [("open", 4), ("m", 5), ("n", 5)]),
]


@pytest.mark.parametrize(("code", "want"), EXPORTS)
def test_exports(spark, code, want):
    got = spark.createDataFrame([(code,)], "c string").select(Z.exports(Z.blank_comments(F.col("c"))).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == want


def test_json_with_comments(spark):
    text = '{"a": "x,}", // c\n "b": [1, 2,], "q": "es\\"c,]", "c": {"d": 1 , }, }'
    got = spark.createDataFrame([(text,)], "c string").select(Z.strict_json(F.col("c")).alias("j")).first()["j"]
    assert json.loads(got) == {"a": "x,}", "b": [1, 2], "q": 'es"c,]', "c": {"d": 1}}


def test_formats(spark):
    numbers = {0: "0", 12.4: "12", 999: "999", 1240: "1.2k", 12_400: "12k", 3_400_000: "3.4M", 2_000_000_000: "2.0B", 1150: "1.1k", 1250: "1.3k", 12_500: "13k", -1250: "-1.3k"}
    df = spark.createDataFrame([(float(k), v) for k, v in numbers.items()] + [(float("nan"), "—"), (None, "—")], "x double, want string")
    assert [r for r in df.select("want", js.compact_number(F.col("x")).alias("got")).collect() if r["want"] != r["got"]] == []
    times = {0: "0 ms", 842.4: "842 ms", 1000: "1.0 s", 2440: "2.4 s", 64_000: "1 m 4 s", 120_000: "2 m", 119_600: "2 m", -1: "—"}
    df = spark.createDataFrame([(float(k), v) for k, v in times.items()] + [(float("nan"), "—")], "x double, want string")
    assert [r for r in df.select("want", js.duration(F.col("x")).alias("got")).collect() if r["want"] != r["got"]] == []
    now = F.lit("2026-08-15 12:00:00").cast("timestamp")
    ages = {0: "just now", 59: "just now", -20: "just now", 300: "5 min ago", 10_800: "3 h ago", 172_800: "2 d ago", 1_814_400: "3 w ago"}
    df = spark.createDataFrame([(k, v) for k, v in ages.items()], "s int, want string")
    assert [r for r in df.select("want", js.relative_age(F.timestamp_seconds(F.unix_seconds(now) - F.col("s")), now).alias("got")).collect() if r["want"] != r["got"]] == []
    assert spark.range(1).select(js.relative_age(F.lit(None).cast("timestamp"), now).alias("x"), js.dir_label(F.lit("a/b/c.ts")).alias("y"), js.dir_label(F.lit("c.ts")).alias("z")).first()[:] == ("—", "a/b/", "")


def test_blank_globs_and_odd_paths(spark):
    from loam.operators import scope as S

    df = spark.createDataFrame([("./src/a.ts",), ("docs/b.md",)], "p string")
    kept = lambda **k: [r["p"] for r in df.where(S.in_scope(F.col("p"), **k)).collect()]
    assert kept(paths=["", "  ", "/"]) == ["./src/a.ts", "docs/b.md"] == kept(ignore=[""])
    assert kept(paths=["src"]) == ["./src/a.ts"] and kept(ignore=["/docs/"]) == ["./src/a.ts"]


def test_back_edges_leave_no_cycle(spark):
    import random

    rng = random.Random(5)
    edges = spark.createDataFrame(sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)} - {(k, k) for k in range(40)}), "`from` long, `to` long")
    back = G.back_edges(edges)
    left = edges.join(back, ["from", "to"], "left_anti")
    assert back.count() > 0 and G.scc(left).count() == 0
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    rank = {r["id"]: r["rank"] for r in G.ranks(nodes, left).collect()}
    assert all(rank[r["from"]] < rank[r["to"]] for r in left.collect())
    with pytest.raises(ValueError):
        G.ranks(nodes, edges)


def test_merged_views_keep_cycles(spark):
    cycles = spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (1, "a", "b"), (1, "a", "a"), (1, "c", "c"), (1, "c", "d")], "seq int, component string, node string")
    assert sorted(tuple(r) for r in G.merge_cycles(cycles).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")]
    own = cycles.where("seq = 1").drop("seq")
    inside = spark.createDataFrame([("c", "f"), ("d", "f"), ("b", "g")], "node string, folder string")
    assert sorted(tuple(r) for r in G.collapse_cycles(own, inside).collect()) == [("a", "a"), ("a", "g")]
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("x", "c")], "`from` string, `to` string")
    shown = G.focused(nodes, edges, own, 3)
    assert [r["id"] for r in shown["nodes"].collect()] == ["c", "a", "b"]
    assert sorted(r["node"] for r in shown["cycles"].collect()) == ["a", "b"] and shown["hidden"].first()["hidden"] == 4


def test_quantiles_and_digest(spark):
    import hashlib

    import numpy as np

    values = [1, 1, 2, 5, 5, 5, 9, 100, 3.5]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    assert np.allclose(V.quantiles(df, "v", (0, 0.2, 0.5, 0.93, 1)).first()[:], np.quantile(values, [0, 0.2, 0.5, 0.93, 1]))
    assert tuple(V.heat_scale(df.limit(0), "v").first()) == (0,) * 6
    files = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "path string, blob string")
    assert X.files_digest(files).first() == X.files_digest(files.orderBy("path").coalesce(1)).first() != X.files_digest(files.limit(2)).first()
    buckets = {}
    for p, b in (("a", "1"), ("b", "2"), ("c", "3")):
        buckets.setdefault(hashlib.sha256(p.encode()).hexdigest()[:3], []).append(f"{p}\0{b}\n")
    own = "".join(k + hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in sorted(buckets.items()))
    assert X.files_digest(files).first()["digest"] == hashlib.sha256(own.encode()).hexdigest()


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("code"))
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    os.makedirs(f"{root}/src")
    for path, text in {"package.json": PACKAGE, "src/index.ts": "import { a } from './a'\nexport const main = a\n", "src/a.ts": "import { main } from './index'\nexport const a = 1, b = main\n", "src/c.ts": "export const c = 1\n"}.items():
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    git("add", ".")
    git("commit", "-m", "feat: all")
    return root


def test_analysis_of_a_repository_with_a_store(spark, repository, tmp_path):
    options = engine.Options(repository, store=f"file://{tmp_path}/store")
    report = engine.analyze(spark, options)
    assert dead({"dead_code": report["typescript.dead_code"]}) == [("package.json", "used", 5, "unused-dependency"), ("package.json", "unused", 6, "unused-dependency"), ("src/a.ts", "b", 2, "unreferenced-export"), ("src/c.ts", None, None, "unreachable-file")]
    assert [(r["nodes"], r["path"]) for r in report["cycles"].collect()] == [(["src/a.ts", "src/index.ts"], ["src/a.ts", "src/index.ts", "src/a.ts"])]
    assert tuple(report["summary"].first())[:4] == (3, 2, 1, 2)
    stored = spark.read.parquet(f"{options.store}/scans").count()
    with open(f"{repository}/src/c.ts", "w") as f:
        f.write("export const c = 2\n")
    subprocess.run(["git", "-C", repository, "-c", "user.name=Ann", "-c", "user.email=a@b", "commit", "-am", "fix: c"], check=True, capture_output=True)
    again = engine.analyze(spark, options)
    assert again["typescript.code_metrics"].count() == 3
    assert (stored, spark.read.parquet(f"{options.store}/scans").count()) == (3, 4)  # one changed file, one new scan
    from loam.sources import git

    assert git.show(repository, "HEAD", "src/c.ts") == "export const c = 2\n" and git.show(repository, "HEAD", "no") is None
