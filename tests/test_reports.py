"""Series of metrics, comparison of reports with gates, stages, and the knowledge map."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loam import engine
from loam.operators import commits as C
from loam.operators import gates
from loam.operators import registry as R
from loam.operators import series as E
from loam.operators import stages as G


def test_series_hold_what_only_one_metric_has(spark):
    hot = spark.createDataFrame([("a.ts", 3, 4, 12), ("b.ts", 1, None, None)], "path string, changes long, complexity long, score long")
    pair = spark.createDataFrame([("a.ts", "b.ts", 2, 3, 4, 57.1)], "file_a string, file_b string, shared_changes long, changes_a long, changes_b long, degree double")
    plain = E.series(hot, "own", F.col("path"), F.lit(1))
    rows = E.united([E.of_hotspots(hot), E.of_coupling(pair), plain])
    got = {(r["series"], r["subject"]): (r["value"], r["n"], r["b"], r["odd"]) for r in rows.select("series", "subject", "value", E.field("changes", "long").alias("n"), E.field("fileB", "string").alias("b"), E.field("fileB", "int").alias("odd")).collect()}
    assert got == {
        ("hotspots", "a.ts"): (12.0, 3, None, None), ("hotspots", "b.ts"): (None, 1, None, None), ("change-coupling", "a.ts ↔ b.ts"): (57.1, None, "b.ts", None),
        ("own", "a.ts"): (1.0, None, None, None), ("own", "b.ts"): (1.0, None, None, None),
    }
    assert E.has_form(rows) and not E.has_form(hot)


def commit(root, message, files):
    for name, text in files.items():
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("add", ".")
    git("commit", "-m", message)
    return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], check=True, capture_output=True).stdout.decode().strip()


@pytest.fixture(scope="module")
def two_reports(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    subprocess.run(["git", "-C", root, "init", "-b", "main"], check=True, capture_output=True)
    manifest = {"package.json": '{"main": "./index.js"}'}
    first = commit(root, "feat: a", manifest | {"index.ts": "import { a } from './a'\nexport const main = a\n", "a.ts": "export const a = 1\n", "calm.ts": "import './index'\nif (x) {\n  y\n}\n"})
    second = commit(root, "feat: b", {"index.ts": "import { a } from './a'\nexport const main = a\nif (z) {\n  main()\n}\n", "a.ts": "import { main } from './index'\nexport const a = () => main,\n  idle = 2\n"})
    extra = R.Plugin("third", "git-metric", "1", lambda t, o: E.series(t["touches"].groupBy("path").agg(F.count("*").alias("n")), "third", F.col("path"), F.col("n"), n="n"))
    out = []
    for rev in (first, second):
        registry = engine.builtin()
        registry.add(extra)
        out.append(engine.analyze(spark, engine.Options(root, rev=rev), registry))
    return out


def test_gates_between_two_revisions(two_reports):
    before, after = two_reports
    found = sorted(tuple(r) for r in after.findings(before).collect())
    assert ("new-cycle", "a.ts, index.ts", "cycle of 2 files", "error") in found
    assert ("new-dead-code", "a.ts#idle", "unreferenced-export", "warning") in found
    assert {r[1] for r in found if r[0] == "hotspot-regression"} == {"index.ts", "a.ts"}
    assert after.findings(after).count() == 0 and after.differences(after).count() == 0


def test_differences_of_whole_reports(two_reports):
    before, after = two_reports
    found = {(r["table"], r["key"]): r for r in after.differences(before).collect()}
    edge = found["edges", json.dumps({"from": "a.ts", "to": "index.ts", "kind": "import"}, separators=(",", ":"))]
    assert edge["change"] == "added" and edge["before"] is None
    assert found["hotspots", '{"path":"index.ts"}']["change"] == "changed"
    assert ("hotspots", '{"path":"calm.ts"}') not in found
    dead = {k: r["change"] for (t, k), r in found.items() if t == "typescript.dead_code"}
    assert dead == {'{"path":"a.ts","symbol":"idle","reason":"unreferenced-export"}': "added"}
    assert {json.loads(k)["series"] for (t, k) in found if t == "metrics"} >= {"hotspots", "third"}


def test_differences_of_small_tables(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3), ("z", None), ("t", 1), ("t", 2)], "path string, score long")
    b = spark.createDataFrame([(None, 1), ("x", 5), ("w", 3), ("z", None), ("t", 2), ("t", 3)], "path string, score long")
    got = {r["key"]: (r["change"], r["before"], r["after"]) for r in gates.differences({"hotspots": a, "odd": a}, {"hotspots": b}).collect()}
    assert got == {
        '{"path":"x"}': ("changed", '{"score":2}', '{"score":5}'), '{"path":"y"}': ("removed", '{"score":3}', None), '{"path":"w"}': ("added", None, '{"score":3}'),
        '{"path":"t"}': ("changed", '{"score":1},{"score":2}', '{"score":2},{"score":3}'),
    }
    assert gates.differences({"hotspots": a}, {}).count() == 5
    with pytest.raises(ValueError):
        gates.differences({"odd": a}, {})
    with pytest.raises(ValueError):
        gates.findings({"odd": a}, {"odd": a})


def test_stages_in_levels(spark):
    table = lambda n: lambda _: spark.range(n)
    broken = lambda _: spark.range(3).select(F.raise_error(F.lit("no luck")))
    stages = [
        G.Stage("late", "findings", lambda got: got["metrics"][0].union(got["graph"][0]), ("metrics", "graph")),
        G.Stage("count", "metrics", lambda got: got["graph"][0].selectExpr("id + 1 as id"), ("graph",)),
        G.Stage("parse", "graph", table(2)),
        G.Stage("faulty", "commits", broken), G.Stage("after", "aggregate", table(1), ("commits",)), G.Stage("other", "metrics", lambda _: 1 / 0),
        G.Stage("one", "x", table(1), exclusive="g"), G.Stage("two", "x", table(5), exclusive="g"), G.Stage("given", "y", lambda got: got["file"][0], ("file",)),
    ]
    assert [[s.name for s in level] for level in G.levels(stages)] == [["parse", "faulty", "other", "one", "two", "given"], ["count", "after"], ["late"]]
    run = G.run_stages(stages, {"file": [spark.range(4)]})
    assert {k: e.status for k, e in run.entries.items()} == {"late": "ok", "count": "ok", "parse": "ok", "faulty": "failed", "after": "skipped", "other": "failed", "one": "ok", "two": "skipped", "given": "ok"}
    assert sorted(r["id"] for r in run.entries["late"].output.collect()) == [0, 1, 1, 2]
    assert "no luck" in run.entries["faulty"].reason and "division" in run.entries["other"].reason and run.entries["after"].reason == "commits never arrived"
    assert run.entries["faulty"].output is None and len(run.outputs("x")) == 1
    with pytest.raises(G.CyclicStages, match="a, b"):
        G.levels([G.Stage("a", "x", table(1), ("y",)), G.Stage("b", "y", table(1), ("x",)), G.Stage("c", "z", table(1))])
    with pytest.raises(ValueError):
        G.levels([stages[0], stages[0]])
    assert G.levels([]) == []


def test_knowledge_map(spark):
    rows = [("a/x.ts", "ann")] * 3 + [("a/x.ts", "bo"), ("a/b/y.ts", "bo"), ("a/b/y.ts", "bo"), ("top", "cy")]
    got = {r["place"]: tuple(r)[1:] for r in C.knowledge_map(spark.createDataFrame(rows, "path string, author string")).collect()}
    assert got == {
        "a": (6, 2, "ann", 0.5, 0.5), "a/x.ts": (4, 2, "ann", 0.75, 0.625), "a/b": (2, 1, "bo", 1.0, 1.0), "a/b/y.ts": (2, 1, "bo", 1.0, 1.0), "top": (1, 1, "cy", 1.0, 1.0),
    }
