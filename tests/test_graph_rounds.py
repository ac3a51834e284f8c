"""Loops over large graphs: few rounds for long ways, and tables that are made once."""

import random
import tracemalloc

import numpy as np
import pytest

from loam.operators import graph as G


@pytest.fixture
def writes(monkeypatch):
    """The names of the tables that graph loops write."""
    names = []
    plain = G.written
    monkeypatch.setattr(G, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "`from` string, `to` string")


def ring(n, mark=""):
    return [(f"{mark}{k:04d}", f"{mark}{(k + 1) % n:04d}") for k in range(n)]


def test_long_rings_take_few_rounds(spark, writes):
    """F1 to F4: a ring took two rounds for each of its nodes."""
    pairs = ring(80, "r") + [(f"r{k:04d}", "r0000") for k in range(0, 80, 5)] + ring(3, "s") + [("r0007", "s0002"), ("t", "r0001"), ("r0002", "u"), ("p", "q"), ("q", "p")]
    got = sorted(map(tuple, G.scc(graph(spark, pairs), small_edges=0).collect()))
    assert got == sorted([("r0000", f"r{k:04d}") for k in range(80)] + [("s0000", f"s{k:04d}") for k in range(3)] + [("p", "p"), ("p", "q")])
    assert len(writes) < 130


def test_long_chains_are_reached_in_few_rounds(spark, writes, monkeypatch):
    """F1 to F4: a chain took a round for each of its nodes."""
    monkeypatch.setattr(G, "REACH_PATIENCE", 3)
    pairs = ring(90, "r")[:-1] + [("x", "r0070"), ("y", "x"), ("r0050", "z"), ("z", "r0010")]
    entries = spark.createDataFrame([("r0000",), ("away",)], "node string")
    got = sorted(r["node"] for r in G.reachable(graph(spark, pairs), entries, small_edges=0).collect())
    assert got == sorted([f"r{k:04d}" for k in range(90)] + ["z", "away"])
    assert len(writes) < 85


@pytest.mark.parametrize("seed", range(1))
def test_contracted_graphs_equal_one_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(G, "REACH_PATIENCE", 1)
    monkeypatch.setattr(G, "PATIENCE", 2)
    rng = random.Random(seed)
    n = 30
    pairs = [(f"{rng.randrange(n):02d}", f"{rng.randrange(n):02d}") for _ in range(40)]
    edges = graph(spark, pairs).cache()
    assert sorted(map(tuple, G.scc(edges, small_edges=0).collect())) == sorted(map(tuple, G.scc(edges).collect())) == sorted(map(tuple, G.scc(edges, small_edges=12).collect()))
    entries = spark.createDataFrame([(f"{k:02d}",) for k in range(3)], "node string")
    whole = sorted(G.reachable(edges, entries).collect())
    assert sorted(G.reachable(edges, entries, small_edges=0).collect()) == whole == sorted(G.reachable(edges, entries, small_edges=12).collect())


def test_long_ways_that_are_no_chains_are_merged(spark, writes, monkeypatch):
    """F13, F16 to F23: what a loop had found was thrown away when it took too many rounds."""
    monkeypatch.setattr(G, "PATIENCE", 4)
    pairs = [p for k in range(23) for p in ((f"r{k:02d}", f"r{k + 1:02d}"), (f"r{k + 1:02d}", f"r{k:02d}"))] + [("r05", "s00"), ("s00", "s01"), ("s01", "s00")]
    got = sorted(map(tuple, G.scc(graph(spark, pairs), small_edges=0).collect()))
    assert got == sorted([("r00", f"r{k:02d}") for k in range(24)] + [("s00", "s00"), ("s00", "s01")])
    assert len(writes) < 90


def plain_way(pairs):
    after = {}
    for a, b in sorted(set(pairs)):
        after.setdefault(a, []).append(b)
    path = [min(after)]
    while step := next((b for b in after.get(path[-1], ()) if b not in path), None):
        path.append(step)
    origin, queue = {path[-1]: None}, [path[-1]]
    for node in queue:
        for b in after.get(node, ()):
            if b not in origin:
                origin[b] = node
                queue.append(b)
    back, node = [], path[0]
    while node is not None and node != path[-1]:
        back.append(node)
        node = origin.get(node)
    return sorted({x for p in pairs for x in p}), path + back[::-1]


def test_ways_round_equal_plain_python(spark):
    rng = random.Random(5)
    both, want = [], []
    for mark, n, m in (("a", 300, 420), ("b", 9, 14), ("c", 2, 2), ("d", 120, 900)):
        pairs = ring(n, mark) + [(f"{mark}{rng.randrange(n):04d}", f"{mark}{rng.randrange(n):04d}") for _ in range(m - n)]
        both += pairs
        want.append(plain_way([p for p in pairs if p[0] != p[1]]))
    edges = graph(spark, [p for p in both if p[0] != p[1]]).cache()
    got = [(r["nodes"], r["path"]) for r in G.ordered_cycles(G.scc(edges), edges).orderBy("position").collect()]
    assert got == sorted(want, key=lambda w: (-len(w[0]), w[0][0]))


def test_a_component_is_walked_in_little_memory():
    """a task held some 290 bytes an edge."""
    n = 200_000
    rng = np.random.default_rng(1)
    to = np.sort(np.stack([(np.arange(n) + 1) % n, rng.integers(0, n, n)], 1), 1).ravel()
    tracemalloc.start()
    nodes, path = G._way_round(np.arange(n), np.full(n, 2, np.int32), [to[k : k + 10_000].copy() for k in range(0, len(to), 10_000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == n and path[0] == path[-1] == 0
    assert peak < 60 * len(to)


def plain_used(exports, uses, stars, consumed):
    after, whole, asked = {}, set(consumed), set(uses)
    for a, b in stars:
        after.setdefault(a, []).append(b)
    queue = list(whole)
    for path in queue:
        queue += (fresh := set(after.get(path, ())) - whole)
        whole |= fresh
    queue = list(asked)
    for path, name in queue:
        if (path, name) not in exports:
            queue += (fresh := {(b, name) for b in after.get(path, ())} - asked)
            asked |= fresh
    return sorted(e for e in exports if e in asked or e[0] in whole)


def used(spark, exports, uses, stars, consumed):
    made = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    return sorted(map(tuple, G.used_names(made(exports, "path string, name string"), made(uses, "to string, name string"), made(stars, "path string, to string"), made([(c,) for c in consumed], "path string")).collect()))


def test_demand_equals_plain_python(spark):
    rng = random.Random(8)
    path, name = lambda: f"f{rng.randrange(40)}", lambda: f"n{rng.randrange(4)}"
    exports, uses, stars = {(path(), name()) for _ in range(60)}, {(path(), name()) for _ in range(25)}, {(path(), path()) for _ in range(45)}
    consumed = {"f3", "away"}
    assert used(spark, exports, uses, stars, consumed) == plain_used(exports, uses, stars, consumed)


def test_demand_rounds_keep_what_is_handed_on_only(spark, monkeypatch):
    """F15, and with it F12 and F19: each round moved all demands so far, also those of files that hand nothing on."""
    rows, plain = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: rows.append((name, (out := plain(df, name)).count())) or out)
    stars = {("top", "barrel")} | {("barrel", f"leaf{k}") for k in range(50)}
    uses = {("top", f"n{k}") for k in range(8)} | {(f"leaf{k}", "own") for k in range(50)}
    exports = {(f"leaf{k}", f"n{k % 10}") for k in range(50)} | {("barrel", "n0")}
    assert used(spark, exports, uses, stars, []) == plain_used(exports, uses, stars, [])
    loop = [n for k, n in rows if k in ("demand", "handed")]
    assert loop[0] == 58 and sum(loop[1:]) == 15  # at top eight names, at barrel seven


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_names_need_no_distinct_edges(spark):
    """edges were made distinct, and shuffled for it, before the least line of each name was taken."""
    from loam.plans import catalog as C

    assert plan_of(C.win_first_per_name(spark, "/root/testdata/sf0.001")).count("Aggregate(") == 2


def test_exports_of_different_edges_are_different(spark):
    """exports were made distinct, and shuffled for it, twice in a query."""
    from loam.plans import catalog as C

    edges = spark.range(60).selectExpr("id % 7 as `from`", "id % 10 as `to`").distinct().localCheckpoint()
    exports = C._exports(edges)
    assert "Aggregate(" not in plan_of(exports)
    assert exports.count() == exports.distinct().count() == edges.count()
