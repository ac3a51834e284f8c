"""The catalog against SQL at the smallest scale, the git source end to end, and small cases."""

import glob
import json
import os
import random
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from loam import engine
from loam.functions import js
from loam.operators import commits as C
from loam.operators import graph as G
from loam.operators import history as H
from loam.operators import modules as M
from loam.operators import registry as R
from loam.operators import scope as S
from loam.operators import text as X
from loam.operators.store import ResultStore
from loam.plans import catalog
from loam.streaming import weeks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, float) or type(v).__module__ == "decimal":
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if not isinstance(v, bool) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


# -- commits


def test_headers(spark):
    rows = [
        "feat(core): add registry", "feat!: drop node 18", "refactor: x\n\nBREAKING CHANGE: api moved", "fix: patch leak (#42)\n\ncloses #7", "just some words", "feat: x\r",
        "words\n\nBREAKING CHANGE: y", "feat:  two spaces", "fix: a\u0085b", "fix: z\nCo-authored-by:  Ann <a@b>  \nco-authored-by: Bo",
    ]
    df = C.parse_commits(spark.createDataFrame([(k, m) for k, m in enumerate(rows)], "k int, message string"))
    got = {r["k"]: (r["type"], r["scope"], r["breaking"], r["subject"], r["tags"], r["valid"]) for r in df.collect()}
    assert got[0] == ("feat", "core", False, "add registry", {}, True)
    assert got[1][:4] == ("feat", None, True, "drop node 18")
    assert got[2][2] is True
    assert got[3][4] == {"issues": ["42", "7"]}
    assert got[4] == (None, None, False, "just some words", {}, False)
    assert got[5][5] is False
    assert got[6][2] is False
    assert got[7][3] == " two spaces"
    assert got[8][3] == "a\u0085b"
    assert got[9][4] == {"coauthors": ["Ann <a@b>", "Bo"]}


def test_buckets_and_weeks(spark):
    parsed = spark.createDataFrame([("core", True), ("core", False), (None, False), (None, False), ("web", False)], "scope string, breaking boolean")
    assert [r["name"] for r in C.buckets(parsed, "scope").orderBy("position").collect()] == ["core", None, "web"]
    dates = ["2024-03-10T23:59:00Z", "2024-03-11T00:30:00+02:00", "2024-03-26T00:00:00Z", "", "never"]
    df = C.valid_dates(spark.createDataFrame([(d,) for d in dates], "date string"), "date")
    assert [(str(r["week"]), r["commits"]) for r in C.weekly(df).orderBy("week").collect()] == [("2024-03-04", 2), ("2024-03-11", 0), ("2024-03-18", 0), ("2024-03-25", 1)]
    assert C.weekly(df.limit(0)).count() == 0
    empty = C.totals(C.parse_commits(spark.createDataFrame([], "message string"))).first()
    assert (empty["total"], empty["valid_rate"]) == (0, 0.0)


def test_coupling_cases(spark):
    rows = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "c"), ("3", "a"), ("4", "x"), ("4", "x")]
    touches = spark.createDataFrame(rows, "sha string, path string")
    small = H.small_commits(touches, 30)
    assert {r["path"]: r["changes"] for r in H.changes(small).collect()} == {"a": 3, "b": 2, "c": 1, "x": 1}
    assert {(r["file_a"], r["file_b"]): r["shared_changes"] for r in H.shared(small).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {r["path"]: r["changes"] for r in H.churn(touches).collect()}["x"] == 2
    four = spark.createDataFrame([(f"{k}", p) for k in range(8) for p in (("barrel", "leaf") if k < 4 else ("barrel",))], "sha string, path string")
    assert [r["degree"] for r in H.coupling(four).collect()] == [66.7]


# -- text


def test_text(spark):
    df = spark.createDataFrame([("", ), ("a\n  b\n\tc\n\n",), ("x",)], "content string")
    assert [tuple(r) for r in df.select(X.loc(F.col("content")), X.indent_complexity(F.col("content"))).collect()] == [(1, 0), (5, 4), (1, 1)]
    lines = "\n".join(f"line {k}" for k in range(8))
    files = spark.createDataFrame([("a", lines), ("b", lines), ("c", "line 0\nline 1"), ("d", "")], "path string, content string")
    scans = X.fingerprints(files)
    assert {r["path"]: len(r["prints"]) for r in scans.collect()} == {"a": 3, "b": 3, "c": 0, "d": 0}
    assert {r["path"]: r["duplication"] for r in X.duplication(scans).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}


def test_js_functions(spark):
    df = spark.createDataFrame([("src/.env", " a﻿", 1500), ("a/b.test.ts", "x", 999), ("top", "", 125000)], "p string, s string, n long")
    got = df.select(js.extension(F.col("p")), js.dir_name(F.col("p")), js.trim(F.col("s")), js.compact_number(F.col("n")), js.duration(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("", "src", "a", "1.5k", "1.5 s"), (".ts", "a", "x", "999", "999 ms"), ("", "", "", "125k", "2 m 5 s")]


# -- scope


def test_globs():
    import re

    hits = lambda g, p: bool(re.search(S.glob_regex(g).replace(r"\z", r"\Z"), p))
    assert hits("src", "src/a/b.ts") and not hits("src", "src2/a")
    assert hits("./src/", "src/a") and hits("**/*.ts", "a.ts") and hits("**/*.ts", "x/y/a.ts")
    assert hits("a?c", "abc") and not hits("a?c", "a/c") and not hits("*.ts", "x/a.ts")
    assert hits("a(1).ts", "a(1).ts") and not hits("a.ts", "abts")


def test_names():
    assert S.allowed(["a", "b"], None) == ["a", "b"]
    assert S.allowed(["a", "b"], []) == []
    with pytest.raises(S.MissingNames):
        S.allowed(["a"], ["z"])
    assert S.convention(["x", "y"], None) == "x"


# -- graphs


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_scc_equals_tarjan(spark, seed):
    rng = random.Random(seed)
    edges = spark.createDataFrame([(rng.randrange(25), rng.randrange(25)) for _ in range(40)], "`from` long, `to` long")
    assert sorted(map(tuple, G.scc(edges, small_edges=0).collect())) == sorted(map(tuple, G.scc(edges).collect()))


def test_distributed_reachability_equals_one_walk(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(70)], "`from` long, `to` long")
    entries = spark.createDataFrame([(1,), (2,), (99,)], "node long")
    assert sorted(G.reachable(edges, entries, small_edges=0).collect()) == sorted(G.reachable(edges, entries).collect())


def test_cycle_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "x")], "`from` string, `to` string")
    got = [(r["nodes"], r["path"]) for r in G.ordered_cycles(G.scc(edges), edges).orderBy("position").collect()]
    assert got == [(["a", "b", "c"], ["a", "b", "c", "a"]), (["x", "y"], ["x", "y", "x"])]


def test_reachability_and_demand(spark):
    edges = spark.createDataFrame([("main", "a"), ("i", "j"), ("j", "i")], "`from` string, `to` string")
    files = spark.createDataFrame([(p,) for p in ("main", "a", "i", "j")], "path string")
    entries = spark.createDataFrame([("main",)], "node string")
    assert sorted(r["path"] for r in G.unreachable(files, edges, entries).collect()) == ["i", "j"]
    assert G.unreachable(files, edges, entries.where("node = 'none'")).count() == 0
    exports = spark.createDataFrame([("used", "kept", 1, 0), ("used", "dropped", 2, 1), ("barrel", "own", 1, 0)], "path string, name string, line int, pos int")
    uses = spark.createDataFrame([("barrel", "kept")], "to string, name string")
    stars = spark.createDataFrame([("barrel", "used"), ("used", "barrel")], "path string, to string")
    used = G.used_names(exports, uses, stars, spark.createDataFrame([], "path string"))
    assert sorted(tuple(r) for r in G.unreferenced(exports, used, spark.createDataFrame([], "path string")).collect()) == [("barrel", "own", 1), ("used", "dropped", 2)]


def test_resolve(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "lib/x.ts", "pkg/src/index.ts")], "path string")
    imports = spark.createDataFrame([("src/a.ts", s) for s in ("./b", "../lib/x.js", "@app/a", "mine", "react", "../../out")], "path string, spec string")
    aliases = spark.createDataFrame([("@app/*", 0, ["src/*"])], "pattern string, seq int, targets array<string>")
    packages = spark.createDataFrame([("mine", "pkg")], "name string, folder string")
    got = {r["spec"]: r["to"] for r in M.resolve(imports, files, aliases, packages).collect()}
    assert got == {"./b": "src/b/index.ts", "../lib/x.js": "lib/x.ts", "@app/a": "src/a.ts", "mine": "pkg/src/index.ts"}


# -- engine


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    for k in range(4):
        for name in ("a.ts", "a.test.ts"):
            with open(f"{root}/{name}", "w") as f:
                f.write(f"if (x) {{\n  y{k}\n}}\n")
        if k == 0:
            os.makedirs(f"{root}/docs")
            with open(f"{root}/docs/ü b.md", "w") as f:
                f.write("text")
        git("add", ".")
        git("commit", "-m", f"feat(core): step {k}" if k else "words", "--date", f"2024-03-0{k + 1}T10:00:00+02:00")
    return root


def test_analyze(spark, repository):
    report = engine.analyze(spark, engine.Options(repository, ignore=("docs",)))
    assert report.branch == "main"
    assert [tuple(r) for r in report["coupling"].collect()] == [("a.test.ts", "a.ts", 4, 4, 4, 100.0)]
    assert sorted(tuple(r)[:3] for r in report["hotspots"].collect()) == [("a.test.ts", 4, 4), ("a.ts", 4, 4)]
    totals = report["commit_totals"].first()
    assert (totals["total"], totals["valid"], totals["invalid"]) == (4, 3, 1)
    assert "coupling" in report.to_text()
    assert json.loads(report.to_json())["types"][0]["name"] == "feat"
    with pytest.raises(S.MissingNames):
        engine.analyze(spark, engine.Options(repository, metrics=("none",)))


def test_git_source(spark, repository):
    from loam.sources import git

    assert git.toplevel(f"{repository}/docs") == os.path.realpath(repository)
    assert git.toplevel("/") is None
    assert git.branch_at(repository, git.resolve_rev(repository)) is None
    assert sorted(r["path"] for r in git.tracked(spark, repository).collect()) == ["a.test.ts", "a.ts", "docs/ü b.md"]
    assert git.log(spark, repository, newest=2).count() == 2
    assert git.log(spark, repository, paths=("docs",)).count() == 1
    assert git.touches(spark, repository).count() == 9
    assert {r["content"] for r in git.contents(git.ls_tree(spark, repository).where("path LIKE 'docs%' OR path LIKE '%docs%'"), repository).collect()} == {"text"}


def test_registry():
    r = R.Registry()
    p = R.Plugin("x", "git-metric", "1", lambda t, o: None)
    assert r.add(p) and not r.add(p)
    assert not r.add(R.Plugin("y", "other", "1", print)) and not r.add(R.Plugin("z", "language", "1", print)) and not r.add(R.Plugin("w", "git-metric", "1", print, sdk=2))
    assert [i for i, _ in r.refused] == ["x", "y", "z", "w"]
    r.discover("no.such.package")


def test_manifests(tmp_path):
    good = {"id": "x", "name": "X", "kind": "language", "version": "1", "sdk": "1.4.0", "main": "src/main.py"}
    stage = {"consumes": ["graph"], "produces": "findings", "exclusive": "g", "filter": {"extensions": ["ts"], "globs": ["src/**"]}}
    assert R.manifest_fault(good) is None and R.manifest_fault(good | stage) is None and R.manifest_fault(good | {"filter": {"globs": ["a"]}}) is None
    for wrong in (
        [], {}, good | {"id": " "}, good | {"name": 1}, good | {"kind": "ai-provider"}, good | {"kind": "toString"}, good | {"sdk": "2.0"},
        good | {"consumes": "graph"}, good | {"consumes": ["graphs"]}, good | {"produces": None}, good | {"produces": ["graph"]}, good | {"exclusive": ""},
        good | {"filter": []}, good | {"filter": {}}, good | {"filter": {"extensions": []}}, good | {"filter": {"globs": [""]}}, good | {"filter": {"extensions": [".ts"]}},
    ):
        assert R.manifest_fault(wrong), wrong
    assert "no longer" in R.manifest_fault(good | {"kind": "ai-provider"})
    file = tmp_path / "p" / "plugin.json"
    file.parent.mkdir()
    for main, fine in (("src/main.py", True), ("..lib/main.py", True), ("../main.py", False), (".", False), ("/etc/main.py", False), ("a/../../main.py", False)):
        file.write_text(json.dumps(good | {"main": main}))
        if fine:
            assert R.read_manifest(str(file)) == (good | {"main": main}, str(file.parent.resolve() / main))
        else:
            with pytest.raises(ValueError, match="outside"):
                R.read_manifest(str(file))
    file.write_text("{")
    for path in (file, tmp_path / "none.json"):
        with pytest.raises(ValueError):
            R.read_manifest(str(path))


def test_store(spark, tmp_path):
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.select("key", F.length("content").alias("n"))

    files = spark.createDataFrame([("k1", "a"), ("k2", "bb"), ("k1", "a")], "blob string, content string")
    store = ResultStore(spark, f"file://{tmp_path}/store", "loc", "1")
    first = sorted(map(tuple, store.through(files, "blob", compute).collect()))
    more = files.union(spark.createDataFrame([("k3", "ccc")], "blob string, content string"))
    second = sorted(map(tuple, store.through(more, "blob", compute).collect()))
    assert (first, second, seen) == ([("k1", 1), ("k2", 2)], [("k1", 1), ("k2", 2), ("k3", 3)], [2, 1])


def test_stream_of_commits(spark, tmp_path):
    rows = [("a", "2024-03-10 23:59:00"), ("b", "2024-03-11 00:00:00"), ("b", "2024-03-11 00:00:00"), ("c", "2024-05-01 00:00:00")]
    spark.createDataFrame(rows, "sha string, t string").selectExpr("sha", "cast(t as timestamp) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sha string, ts timestamp").parquet(f"{tmp_path}/in")
    q = weeks.weekly(stream).writeStream.outputMode("complete").format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r["week"]), r["commits"]) for r in spark.sql("select * from weeks order by week").collect()] == [("2024-03-04", 1), ("2024-03-11", 1), ("2024-04-29", 1)]
