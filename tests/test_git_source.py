"""Git as data sources, a stream of commits into incremental counts, and the root locale's order."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loam.functions import js
from loam.operators import commits as C
from loam.operators import graph as G
from loam.operators import history as H
from loam.operators import views as V
from loam.sources import git, git_source
from loam.streaming.history import HistoryTables


def make(root):
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    os.makedirs(root, exist_ok=True)
    run("init", "-b", "main")

    def commit(message, **contents):
        for name, text in contents.items():
            path = f"{root}/{name.replace('__', '/')}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text)
        run("add", ".")
        run("commit", "--allow-empty", "-m", message)

    return commit, run


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("git"))
    commit, run = make(root)
    for k in range(12):
        commit(f"feat: step {k}\n\nbody {k}", **{f"src__pkg{k % 5}__deep__a.ts": f"{k}", f"docs__ü {k % 3}.md": f"{k}", "top": f"{k}"})
    commit("empty")
    return root, commit, run


def git_says(root, *args):
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], check=True, capture_output=True).stdout.decode()


def test_log_in_ranges(spark, repository):
    root = repository[0]
    git_source.register(spark)
    rows = spark.read.format("git_log").options(root=root, range="5").load()
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(r["sha"].strip() for r in rows.collect()) == sorted(git_says(root, "log", "--format=%H").split())
    whole = git.log(spark, root)
    assert {r["message"] for r in whole.collect()} == {f"feat: step {k}\n\nbody {k}" for k in range(12)} | {"empty"}
    assert whole.where("ts is null").count() == 0 and git.log(spark, root, newest=4).count() == 4
    assert git.log(spark, root, paths=("docs/ü 1.md",)).count() == 4 and git.log(spark, root, paths=("none",)).count() == 0
    touches = spark.read.format("git_touches").options(root=root, range="4").load()
    want = sorted((block.split("\n")[0], p) for block in git_says(root, "log", "--name-only", "--format=\x1e%H").split("\x1e")[1:] for p in block.split("\n")[1:] if p)
    assert sorted(map(tuple, touches.collect())) == want and len(want) == 36
    with pytest.raises(git.GitError):
        git.log(spark, root, "nowhere")


def test_tree_in_folders(spark, repository):
    root = repository[0]
    want = sorted(tuple(line.split("\t")) for line in git_says(root, "ls-tree", "-r", "--format=%(objectname)%x09%(path)", "HEAD").splitlines())
    assert sorted(map(tuple, git.tracked(spark, root).collect())) == want
    for folders in ("1", "2", "3", "100"):
        rows = spark.read.format("git_tree").options(root=root, folders=folders).load()
        assert sorted(map(tuple, rows.select("blob", "path").collect())) == want
    assert rows.rdd.getNumPartitions() > 2
    assert any(r["path"].startswith('"docs/') for r in git.ls_tree(spark, root).collect())
    with pytest.warns(UserWarning, match="no tracked"):
        assert git.tracked(spark, root, "nowhere").count() == 0


def test_a_stream_of_commits_is_counted_once(spark, tmp_path):
    root = f"{tmp_path}/repo"
    commit, _ = make(root)
    for k in range(5):
        commit("x", a=f"{k}", b=f"{k}", **({"c": f"{k}"} if k % 2 else {}))
    tables = HistoryTables(spark, f"file://{tmp_path}/counts", H.CouplingLimits(max_files=3, min_degree=0, min_changes=1, min_shared=1), fold_every=2)
    assert tables.coupling() is None
    seen = []

    def follow():
        q = git.touches_stream(spark, root, "main").writeStream.foreachBatch(lambda df, k: (seen.append(k), tables.update(df, k))[1]).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    def same():
        want = H.coupling(git.touches(spark, root), tables.limits)
        assert sorted(map(tuple, tables.coupling().collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, tables.table("churn").collect())) == sorted(map(tuple, H.churn(git.touches(spark, root)).collect()))

    follow()
    same()
    follow()
    assert len(seen) == 1  # nothing new, no batch
    for k in range(3):
        commit("y", b=f"n{k}", c=f"n{k}", **({f"wide{j}": f"{k}" for j in range(9)} if k == 1 else {}))
        follow()
        same()
    assert len(seen) == 4 and tables._base() == 3
    # a batch that is run again after a fault
    tables.update(git.touches(spark, root), 3)
    same()
    extra = spark.createDataFrame([("s1", "p"), ("s1", "q")], "sha string, path string")
    tables.update(extra, 4)
    tables.update(extra, 4)
    assert {r["path"]: r["changes"] for r in tables.table("changes").where("path in ('p', 'q')").collect()} == {"p": 1, "q": 1}


NAMES = ["b", "B", "a", "A", "ä", "Z", "_x", "a-b", "ab", "é", "e", "f", "10", "9"]
IN_ORDER = ["_x", "10", "9", "a", "A", "ä", "a-b", "ab", "b", "B", "e", "é", "f", "Z"]


def test_locale_order(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = [r["name"] for r in names.orderBy(*js.in_locale_order(names, "name")).collect()]
    assert [n for n in got if n != "a-b"] == [n for n in IN_ORDER if n != "a-b"]
    parsed = spark.createDataFrame([(n, False) for n in ["b", "B", "a", "A", None]], "scope string, breaking boolean")
    assert [r["name"] for r in C.buckets(parsed, "scope").orderBy("position").collect()] == ["a", "A", "b", "B", None]
    cycles = spark.createDataFrame([(n, n + x) for n in ("b", "A", "a", "B") for x in ("", "1")], "component string, node string")
    assert [r["component"] for r in G.cycle_sizes(cycles).orderBy("position").collect()] == ["a", "A", "b", "B"]
    findings = spark.createDataFrame([("B", "x", 1), ("a", "y", 2), ("a", "X", 2), ("a", "x", 2), ("A", None, None), ("a", None, None)], "path string, symbol string, line int")
    assert [tuple(r)[:2] for r in V.sorted_findings(findings).collect()] == [("a", None), ("a", "x"), ("a", "X"), ("a", "y"), ("A", None), ("B", "x")]
    touches = spark.createDataFrame([(f"{k}", p) for k in range(4) for p in ("b", "A", "a", "B")], "sha string, path string")
    pairs = [(r["file_a"], r["file_b"]) for r in H.top_coupling(touches).collect()]
    assert pairs == [("A", "a"), ("a", "b"), ("A", "b"), ("A", "B"), ("B", "a"), ("B", "b")]
    numbers = spark.createDataFrame([(10,), (9,)], "name int")
    assert [r["name"] for r in numbers.orderBy(*js.in_locale_order(numbers, "name")).collect()] == [9, 10]
