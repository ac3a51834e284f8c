"""Results that are kept by content and by run, their compaction, and the counters of a run."""

import glob
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loam import engine
from loam.operators import registry as R
from loam.operators import store as S


def sizes(seen):
    def compute(missing):
        seen.append(sorted(r["key"] for r in missing.collect()))
        return missing.select("key", F.length("content").alias("n"))

    return compute


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "blob string, content string")


def test_contents_are_counted_as_hits_and_misses(spark, tmp_path):
    seen, counters = [], S.Counters()
    store = S.ResultStore(spark, f"file://{tmp_path}/s", "loc", "1", counters)
    assert sorted(map(tuple, store.through(files(spark, ("a", "x"), ("b", "yy"), ("a", "x")), "blob", sizes(seen)).collect())) == [("a", 1), ("b", 2)]
    assert (counters.hits, counters.misses, counters.writes) == (1, 2, 2)
    assert sorted(map(tuple, store.through(files(spark, ("c", "zzz"), ("b", "yy")), "blob", sizes(seen)).collect())) == [("b", 2), ("c", 3)]
    assert (counters.hits, counters.misses, seen) == (2, 3, [["a", "b"], ["c"]])
    other = S.ResultStore(spark, f"file://{tmp_path}/s", "loc", "2")
    assert other.through(files(spark, ("a", "x")), "blob", sizes(seen)).count() == 1 and seen[-1] == ["a"]
    assert store.through(files(spark).limit(0), "blob", sizes(seen)).count() == 0


def test_many_runs_are_folded(spark, tmp_path):
    path, seen = f"file://{tmp_path}/s", []
    store = S.ResultStore(spark, path, "loc/ü", "1")
    store.through(files(spark, ("a", "x"), ("b", "yy")), "blob", sizes(seen))
    for _ in range(6):
        store.through(files(spark, ("a", "x"), ("b", "yy")), "blob", sizes(seen), renew_days=0)
    assert spark.read.parquet(path).count() <= 6 and len(seen) == 1
    for _ in range(3):
        store._write(store.rows())
    store.compact()
    assert spark.read.parquet(path).count() == 2
    assert sorted(map(tuple, store.rows().collect())) == [("a", 1), ("b", 2)]
    S.prune(spark, path, 1)
    assert store.rows().count() == 2
    S.prune(spark, path, 0)
    assert store.rows() is None or store.rows().count() == 0
    S.prune(spark, f"file://{tmp_path}/none", 0)


def test_runs(spark, tmp_path):
    counters, computed = S.Counters(), []
    runs = S.RunStore(spark, f"file://{tmp_path}/r", counters)

    def compute():
        computed.append(1)
        return {"rows": spark.range(3), "none": spark.range(0).selectExpr("id", "map('a', id) as m")}

    for _ in range(3):
        found = runs.through("p/q", "1", "k", compute)
        assert sorted(r["id"] for r in found["rows"].collect()) == [0, 1, 2] and found["none"].count() == 0 and found["none"].columns == ["id", "m"]
    assert (len(computed), counters.run_hits, counters.run_misses, counters.writes) == (1, 2, 1, 1)
    # a run that broke before its entry was written isn't found, and is written over
    runs.put("p/q", "1", "k2", {"rows": spark.range(9)})
    S.remove(spark, f"{runs._folder('p/q', '1')}/index/run_key=k2")
    assert runs.get("p/q", "1", "k2") is None
    assert runs.through("p/q", "1", "k2", compute)["rows"].count() == 3
    assert runs.get("p/q", "2", "k") is None
    runs.prune("p/q", "1", 1)
    assert runs.get("p/q", "1", "k") is not None
    runs.prune("p/q", "1", 0)
    assert runs.get("p/q", "1", "k") is None and not glob.glob(f"{tmp_path}/r/**/*.parquet", recursive=True)


def test_a_store_that_cannot_be_written_costs_a_warning(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    runs = S.RunStore(spark, f"file://{tmp_path}/file/r")
    with pytest.warns(UserWarning, match="going on without"):
        assert runs.through("p", "1", "k", lambda: {"rows": spark.range(2)})["rows"].count() == 2


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-b", "main")

    def commit(**contents):
        for name, text in contents.items():
            with open(f"{root}/{name}.ts", "w") as f:
                f.write(text)
        git("add", ".")
        git("commit", "-m", "feat: more")

    return root, commit


def test_analyses_share_a_store(spark, repository, tmp_path):
    root, commit = repository
    commit(a="export const a = 1\n", b="import { a } from './a'\n")
    ran = []
    registry = engine.builtin()
    plain = registry.plugins["typescript"]
    registry.plugins["typescript"] = R.Plugin("typescript", "language", plain.version, lambda t, o: (ran.append(1), plain.run(t, o))[1], extensions=plain.extensions)
    options = engine.Options(root, store=f"file://{tmp_path}/store", metrics=("hotspots",))
    first = engine.analyze(spark, options, registry)
    assert (first.cache["enabled"], first.cache["hits"], first.cache["misses"], first.cache["run_hits"], first.cache["run_misses"]) == (True, 0, 2, 0, 2)
    second = engine.analyze(spark, options, registry)
    assert (second.cache["hits"], second.cache["misses"], second.cache["run_hits"], second.cache["run_misses"]) == (0, 0, 2, 0) and len(ran) == 1
    for name in ("typescript.nodes", "typescript.edges", "typescript.dead_code", "hotspots", "summary"):
        assert sorted(map(str, first[name].collect())) == sorted(map(str, second[name].collect())), name
    assert [r["path"] for r in second["hotspots"].collect()] == [r["path"] for r in first["hotspots"].collect()]
    commit(b="import { a } from './a'\nexport const b = a\n")
    third = engine.analyze(spark, options, registry)
    assert (third.cache["hits"], third.cache["misses"], third.cache["run_hits"], len(ran)) == (1, 1, 0, 2)
    assert third.run["files"] == 2 and third.run["branch"] == "main" and third.run["duration_ms"] > 0
    without = engine.analyze(spark, engine.Options(root, metrics=("hotspots",)), registry)
    assert without.cache == {"enabled": False, "hits": 0, "misses": 0, "run_hits": 0, "run_misses": 0, "writes": 0}
    assert sorted(map(str, without["typescript.nodes"].collect())) == sorted(map(str, third["typescript.nodes"].collect()))
    assert os.listdir(f"{tmp_path}/store") == ["runs", "scans"] or sorted(os.listdir(f"{tmp_path}/store")) == ["runs", "scans"]
