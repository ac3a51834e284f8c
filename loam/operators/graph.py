"""Dependency graphs: degrees, summaries, components, reachability and views of them.

Edges are (from, to) with an optional kind and weight.  Fixpoints are loops of one join and one
group-by a round over tables in the shared folder; a round's result is read back, so that lineage
stays short and survives lost executors.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js
from ..session import written

#: Graphs of up to so many edges (some MB) are walked in one task, with the same result; larger ones by distributed rounds.
SMALL_EDGES = 200_000


def import_edges(uses: DataFrame) -> DataFrame:
    """One `import` edge for each pair of files, self-imports included."""
    return uses.select("from", "to").distinct().withColumn("kind", F.lit("import"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node."""
    ends = edges.select(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def summary(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: nodes, edges, cycles, cycle_nodes, max_fan_in and max_fan_out with their counts.

    Edges are counted as rows.  Ids that occur in edges only can be the busiest; of equal ones the
    least wins, and none if there is no edge."""
    ends = edges.select(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))

    def busiest(n: str, name: str) -> list[Column]:
        some = F.col(n) > 0
        return [F.min_by("id", F.when(some, F.struct(-F.col(n), F.col("id")))).alias(name), F.max(F.when(some, F.col(n))).alias(f"{name}_count")]

    one = nodes.agg(F.count("*").alias("nodes"))
    of_cycles = cycles.agg(F.count_distinct("component").alias("cycles"), F.count_distinct("node").alias("cycle_nodes"))
    of_edges = counts.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("edges"), *busiest("i", "max_fan_in"), *busiest("o", "max_fan_out"))
    columns = ["nodes", "edges", "cycles", "cycle_nodes", "max_fan_in", "max_fan_in_count", "max_fan_out", "max_fan_out_count"]
    return one.crossJoin(of_cycles).crossJoin(of_edges).select(columns)  # one row each


# -- components


def scc(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(component, node) of strongly connected components of two nodes or more; component: the least node."""
    plain = written(edges.select("from", "to").where(F.col("from") != F.col("to")).distinct(), "scc-edges")
    return _scc_small(plain) if plain.count() <= small_edges else _scc_rounds(plain, small_edges)


def _tarjan(after: dict) -> list[list]:
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(after.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        out.append(group)
    return out


def _one_task(df: DataFrame, walk: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(F.lit("all")).applyInPandas(lambda rows: walk(rows), schema)


def _scc_small(edges: DataFrame) -> DataFrame:
    kind = edges.schema["from"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in zip(rows["from"].tolist(), rows["to"].tolist(), strict=True):
            after.setdefault(a, []).append(b)
        found = [(least, n) for g in _tarjan(after) for least in (min(g),) for n in g]
        return pd.DataFrame(found, columns=["component", "node"], dtype=object)

    return _one_task(edges, walk, f"component {kind}, node {kind}")


def _by(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges that stay dealt and sorted by keys, so that the rounds of a loop move their small side only."""
    return edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).persist()


def _coin(node: str, salt: int) -> Column:
    return F.xxhash64(F.col(node), F.lit(salt)) % 2 == 0


def _ends(edges: DataFrame) -> DataFrame:
    """(node, n_in, before, n_out, after): how many edges lead to and from each node, and the least ends of those."""
    only = lambda key, end: edges.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n"), F.min(end).alias("at"))
    way_in = only("to", "from").withColumnRenamed("n", "n_in").withColumnRenamed("at", "before")
    way_out = only("from", "to").withColumnRenamed("n", "n_out").withColumnRenamed("at", "after")
    return way_in.join(way_out, "node", "full")


def _contract(edges: DataFrame, salt: int, backward: bool = True, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges without a part of the nodes that have one way in or (backward) one way out, and (node, anchor, other) of those nodes.

    A node with the one way in (anchor, node) goes, and its edges (node, other) become (anchor, other); a node with the
    one way out (node, anchor) goes, and (other, node) becomes (other, anchor).  Only nodes whose coin falls on one side go, to
    anchors whose coin fell on the other, so that no anchor goes; of a long chain a quarter (backward: three eighths) goes in a
    round.  `other` is null in a row of its own for each node with one way in.  Backward, nodes without way in or out go too."""
    goes, one_in, one_out = _coin("node", salt), (F.col("n_in") == 1) & ~_coin("before", salt), (F.col("n_out") == 1) & ~_coin("after", salt)
    kind = F.when(goes & one_in, "in")
    if backward:
        kind = F.when(F.col("n_in").isNull() | F.col("n_out").isNull(), "end").when(goes & one_in, "in").when(goes & one_out, "out")
    gone = (_ends(edges) if ends is None else ends).select("node", kind.alias("kind"), F.when(F.col("kind") == "in", F.col("before")).when(F.col("kind") == "out", F.col("after")).alias("anchor")).where("kind is not null")
    gone = written(gone, "contracted")
    a = gone.select(F.col("node").alias("from"), F.col("kind").alias("_ka"), F.col("anchor").alias("_fa"))
    b = gone.select(F.col("node").alias("to"), F.col("kind").alias("_kb"), F.col("anchor").alias("_fb"))
    # what leads into a node with one way in, or out of one with one way out, is the edge that is left out
    stay = edges.join(a, "from", "left").join(b, "to", "left").where("coalesce(_ka, '') not in ('end', 'out') and coalesce(_kb, '') not in ('end', 'in')")
    moved = written(stay.select("from", "to", "_ka", "_kb", F.coalesce("_fa", "from").alias("a"), F.coalesce("_fb", "to").alias("b")), "moved")
    records = moved.where("_ka = 'in'").select(F.col("from").alias("node"), F.col("a").alias("anchor"), F.col("b").alias("other")).union(moved.where("_kb = 'out'").select("to", "b", "a"))
    records = records.union(gone.where("kind = 'in'").select("node", "anchor", F.lit(None).cast(moved.schema["a"].dataType)))
    return written(moved.where("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to")).distinct(), "scc-edges"), records


#: Rounds that a loop takes before what is left is contracted, and the part of the edges that a step must take off to be followed by another one at once.
PATIENCE, REACH_PATIENCE, WORTH = 24, 24, 0.15


def _scc_rounds(edges: DataFrame, small_edges: int = 0) -> DataFrame:
    """Steps that take nodes out of the graph until what is left is small, each by what is worth it: contraction of chains (see
    _contract()), the component of one pivot, or components by colours.  Then the nodes taken out come back, last step first.

    No step takes more than `patience` rounds.  What a search that is cut short has found in both directions is part of one
    component all the same: it becomes one node (merge), and the rest is left to later steps.  A search that came to its end
    has whole components (done)."""
    found, steps, left, size, patience, forced, by_pivot = None, [], edges, edges.count(), PATIENCE, 0, True
    while size > small_edges:
        before, ends = size, written(_ends(left), "ends")
        none, one_in, one_out = F.col("n_in").isNull() | F.col("n_out").isNull(), F.col("n_in") == 1, F.col("n_out") == 1
        worth = ends.agg(F.sum(F.when(none, 1.0).when(one_in & one_out, 0.375).when(one_in | one_out, 0.25).otherwise(0.0))).first()[0]
        if forced > 0 or worth >= WORTH * size:
            left, record = _contract(left, len(steps), ends=ends)
            steps.append(("chain", record))
            size, forced = left.count(), forced - 1
            continue
        if by_pivot:
            left, taken = _by_pivot(left, ends, patience)
        else:
            left, taken = _by_colours(left, ends, patience, len(steps))
        steps += taken
        size = left.count()
        if not by_pivot and size > (1 - WORTH) * before:  # some way is longer: it is made shorter
            patience, forced = patience * 2, 8
        by_pivot = not by_pivot or size <= 0.75 * before
    if size:
        found = _scc_small(left)
    if found is None:
        found = edges.select(F.col("from").alias("component"), F.col("to").alias("node")).limit(0)
    found = written(found, "scc")
    for kind, step in reversed(steps):
        found = _expanded(found, step) if kind == "chain" else _unmerged(found, step) if kind == "merge" else found.union(step)
    found = written(found, "scc")
    least = found.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    return found.join(least, "component").select(F.col("least").alias("component"), "node")


def _expanded(found: DataFrame, record: DataFrame) -> DataFrame:
    """found with the contracted nodes of one round: a node is in its anchor's component if another one it leads to, or that leads to it, is.

    A node that is in no component yet is one by itself."""
    at = lambda name, c: found.select(F.col("node").alias(name), F.col("component").alias(c))
    own = record.where("other is not null").join(at("anchor", "_c"), "anchor", "left").join(at("other", "_d"), "other", "left")
    more = own.select("node", "anchor", F.coalesce("_c", "anchor").alias("component"), F.coalesce("_d", "other").alias("_o"), F.col("_c").isNull().alias("new")).where("component = _o")
    more = written(more.select("node", "anchor", "component", "new"), "expanded")
    return written(found.union(more.select("component", "node").union(more.where("new").select("component", "anchor")).distinct()), "scc")


def _unmerged(found: DataFrame, group: DataFrame) -> DataFrame:
    """found with the nodes (component, node) that had become one node, `component`; that one is in no component yet or in one."""
    ones = group.select("component").distinct().join(found.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left")
    ones = written(ones, "merged")
    more = group.join(ones, "component").select(F.coalesce("_c", "component").alias("component"), "node")
    return found.union(more).union(ones.where("_c is null").select("component", F.col("component").alias("node")))


def _merged(edges: DataFrame, group: DataFrame) -> DataFrame:
    """edges with nodes replaced by their `component` in group."""
    a, b = group.select(F.col("node").alias("from"), F.col("component").alias("_a")), group.select(F.col("node").alias("to"), F.col("component").alias("_b"))
    moved = edges.join(a, "from", "left").join(b, "to", "left").select(F.coalesce("_a", "from").alias("from"), F.coalesce("_b", "to").alias("to"))
    return written(moved.where("`from` <> `to`").distinct(), "scc-edges")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which no end is one of the nodes."""
    return written(edges.join(nodes.select(F.col("node").alias("from")), "from", "left_anti").join(nodes.select(F.col("node").alias("to")), "to", "left_anti"), "scc-edges")


def _by_pivot(edges: DataFrame, ends: DataFrame, patience: int) -> tuple[DataFrame, list]:
    """What both is reached from the busiest node and reaches it: the edges that are left, and the steps taken."""
    busy = ends.where("n_in > 0 and n_out > 0").orderBy(F.desc(F.col("n_in") * F.col("n_out")), "node").limit(1)
    pivot = written(busy.select("node"), "pivot")
    ahead, whole_ahead = _reach_rounds(edges, pivot, patience)
    behind, whole_behind = _reach_rounds(edges.select(F.col("to").alias("from"), F.col("from").alias("to")), pivot, patience)
    both = written(ahead.join(behind, "node").crossJoin(pivot.select(F.col("node").alias("component"))).select("component", "node"), "scc-group")
    if whole_ahead and whole_behind:
        return _without(edges, both), [("done", both)]
    return _merged(edges, both.where("node <> component")), [("merge", both.where("node <> component"))]


def _by_colours(edges: DataFrame, ends: DataFrame, patience: int, salt: int) -> tuple[DataFrame, list]:
    """Components by colours: the edges that are left, and the steps taken.

    Each node has a number by chance; its colour is the least number of those nodes that lead to it within patience rounds.  The
    component of a node with its own number are those of its colour that lead to it.  Numbers by chance, and not the nodes' order,
    lest one component's colours flood all those after it.  A round carries on new colours only."""
    while True:
        number = F.xxhash64("node", F.lit(salt))
        colours = written(ends.select("node", number.alias("colour"), F.lit(True).alias("new")), "scc-colours")
        if colours.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # no two nodes have one number
            break
        salt += 1 << 32
    out, rounds = _by(edges, "from"), 0
    while (going := not colours.where("new").isEmpty()) and rounds < patience:
        rounds += 1
        told = out.join(colours.where("new").select(F.col("node").alias("from"), "colour"), "from").groupBy(F.col("to").alias("node")).agg(F.min("colour").alias("_told"))
        better = F.coalesce(F.col("_told") < F.col("colour"), F.lit(False))
        colours = written(colours.join(told, "node", "left").select("node", F.when(better, F.col("_told")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), "scc-colours")
    whole = not going
    out.unpersist()
    a, b = colours.select(F.col("node").alias("from"), F.col("colour")), colours.select(F.col("node").alias("to"), F.col("colour").alias("_c"))
    inside = written(edges.join(a, "from").join(b, "to").where("colour = _c").select("from", "to"), "scc-inside")
    own = written(colours.where(F.col("colour") == number).select("node", "colour"), "scc-own")
    group, whole_back = _reach_rounds(inside.select(F.col("to").alias("from"), F.col("from").alias("to")), own.select("node"), patience)
    both = group.join(colours.select("node", "colour"), "node").join(own.select("colour", F.col("node").alias("component")), "colour").select("component", "node")
    both = written(both, "scc-group")
    # what crosses colours is in no component, if all colours are known
    left = inside if whole else edges
    if whole and whole_back:
        return _without(left, both), [("done", both)]
    return _merged(left, both.where("node <> component")), [("merge", both.where("node <> component"))]


def cycle_sizes(cycles: DataFrame) -> DataFrame:
    """(component, size, position): cycles by size, then first node in the root locale's order.  One window over cycles, not over nodes."""
    sizes = cycles.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("position", F.row_number().over(Window.orderBy(F.desc("size"), *js.in_locale_order(sizes, "component"))))


def cycle_numbers(cycles: DataFrame) -> DataFrame:
    """(node, number): the position of each node's cycle."""
    return cycles.join(cycle_sizes(cycles), "component").select("node", F.col("position").alias("number"))


def _way_round(first: np.ndarray, counts: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, path) of one component: the nodes with edges in order, how many each has, and where these lead to, in order, in parts that are used up.

    Nodes are numbers of four bytes here, whatever they are, so that a component of tens of millions of edges takes some hundred MB."""
    nodes, most = first, np.iinfo(np.int32).max
    for part in parts:
        at = np.minimum(np.searchsorted(first, part), len(first) - 1)
        if (other := part[first[at] != part]).size:  # only led to
            nodes = np.union1d(nodes, other)
    n_out = np.zeros(len(nodes) + 1, np.int64)
    n_out[np.searchsorted(nodes, first) + 1] = counts
    begin = np.cumsum(n_out)
    after, filled = np.empty(begin[-1], np.int32 if len(nodes) <= most else np.int64), 0
    while parts:
        part = parts.pop()  # the last one, so that its memory is free at once
        after[len(after) - filled - len(part) : len(after) - filled] = np.searchsorted(nodes, part)
        filled += len(part)
    start = int(np.searchsorted(nodes, first[0]))
    begins, afters, seen, path, last = memoryview(begin), memoryview(after), bytearray(len(nodes)), array(after.dtype.char, [start]), start
    seen[start] = 1
    while True:
        for k in range(begins[last], begins[last + 1]):
            if not seen[afters[k]]:
                break
        else:
            break
        last = afters[k]
        path.append(last)
        seen[last] = 1
    # breadth first: a node's origin is the first one in the queue that leads to it
    origin = np.full(len(nodes), -1, after.dtype)
    origin[last] = last
    queue = np.array([last])
    while len(queue) and origin[start] < 0:
        found = []
        for piece in (queue[k : k + (1 << 16)] for k in range(0, len(queue), 1 << 16)):
            if len(piece) < 16:  # long ways have short queues
                fresh = []
                for node in piece.tolist():
                    for k in range(begins[node], begins[node + 1]):
                        if origin[afters[k]] < 0:
                            origin[afters[k]] = node
                            fresh.append(afters[k])
                found.append(np.array(fresh, np.int64))
                continue
            n = begin[piece + 1] - begin[piece]
            other, by = after[np.repeat(begin[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(piece, n)
            new = origin[other] < 0
            other, by = other[new], by[new]
            once = np.sort(np.unique(other, return_index=True)[1])
            origin[other[once]] = by[once]
            found.append(other[once].astype(np.int64))
        queue = np.concatenate(found)
    back, node = [], start
    while node >= 0 and node != last:
        back.append(node)
        node = int(origin[node])
    return nodes, nodes[np.concatenate([np.frombuffer(path, after.dtype), np.array(back[::-1], after.dtype)])]


def ordered_cycles(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, nodes, path): cycles by size, then first node, each with a way round it.

    The way goes from the least node, each time to the least neighbour not seen yet, and when stuck
    takes the shortest way back.  It is one sequence, so a component is walked in one task, which holds it as
    packed numbers; its edges come sorted, in batches."""
    kind = cycles.schema["node"].dataType.simpleString()
    inside = edges.select("from", "to").join(cycles.select("component", F.col("node").alias("from")), "from").join(cycles.select(F.col("component").alias("c2"), F.col("node").alias("to")), "to").where("component = c2")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, first, counts, parts, types = None, ("component", "size", "nodes", "path"), [], [], [], None

        def close() -> pa.RecordBatch:
            nodes, path = _way_round(np.concatenate(first), np.concatenate(counts), parts)
            first.clear(), counts.clear(), parts.clear()
            as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, types[1]))
            return pa.RecordBatch.from_arrays([pa.array([key], types[0]), pa.array([len(nodes)], pa.int32()), as_list(nodes), as_list(path)], names=names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("component", "from")]
            of, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("component", "from", "to"))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if key is not None and key != of[low]:
                    yield close()
                key, own = of[low], a[low:high]
                at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                node, n = own[at], np.diff(np.append(at, len(own)))
                if first and first[-1][-1] == node[0]:
                    counts[-1][-1] += n[0]
                    node, n = node[1:], n[1:]
                if len(node):
                    first.append(node.copy())
                    counts.append(n.astype(np.int32))
                parts.append(b[low:high].copy())
        if key is not None:
            yield close()

    dealt = inside.select("component", "from", "to").repartition("component").sortWithinPartitions("component", "from", "to")
    found = written(dealt.mapInArrow(ways, f"component {kind}, size int, nodes array<{kind}>, path array<{kind}>"), "ways")
    sizes = found.select("component", "size")  # one window over cycles, without their nodes
    position = sizes.select("component", F.row_number().over(Window.orderBy(F.desc("size"), *js.in_locale_order(sizes, "component"))).alias("position"))
    return found.join(position, "component").select("position", "nodes", "path")


# -- reachability


def _is_small(*tables: DataFrame, limit: int = SMALL_EDGES) -> bool:
    return all(t.limit(limit + 1).count() <= limit for t in tables)


def _reach_small(edges: DataFrame, entries: DataFrame) -> DataFrame:
    kind = edges.schema["from"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            if a:
                after.setdefault(a[0], []).append(b[0])
        seen = dict.fromkeys(b[0] for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True) if not a)
        queue = list(seen)
        for node in queue:
            for other in after.get(node, ()):
                if other not in seen:
                    seen[other] = None
                    queue.append(other)
        return pd.DataFrame({"node": pd.Series(queue, dtype=object)})

    # one-element arrays keep ids as they are where a side is missing
    both = edges.select(F.array("from").alias("a"), F.array("to").alias("b")).union(entries.select(F.lit(None).cast(f"array<{kind}>"), F.array("node")))
    return _one_task(both, lambda rows: walk(rows.assign(a=[list(x) if x is not None else None for x in rows["a"]])), f"node {kind}")


def reachable(edges: DataFrame, entries: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node): what can be reached from the entries, themselves included.

    Beyond small_edges, in rounds that carry only new nodes on; where these are many, chains are contracted first."""
    edges, found = written(edges.select("from", "to").where(~F.col("from").eqNullSafe(F.col("to"))).distinct(), "reach-edges"), written(entries.select("node").distinct(), "reach")
    if edges.count() <= small_edges and found.count() <= small_edges:
        return _reach_small(edges, found)
    records, patience, most = [], REACH_PATIENCE, 1
    while True:
        found, whole = _reach_rounds(edges, found, patience)
        if whole:
            break
        size = edges.count()
        for _ in range(most):
            before = size
            found = written(found.union(edges.join(found.withColumnRenamed("node", "from"), "from", "left_semi").select("to")).distinct(), "reach")
            edges = edges.join(found.withColumnRenamed("node", "to"), "to", "left_anti").select("from", "to")
            entered = edges.select(F.col("to").alias("from")).union(found).distinct()
            edges, record = _contract(written(edges.join(entered, "from", "left_semi"), "reach-edges"), len(records), backward=False)
            records.append(record)
            size = edges.count()
            if size <= small_edges:
                break
        if size <= small_edges:
            on = found.join(edges.select(F.col("from").alias("node")), "node", "left_semi")  # no more than there are edges
            found = written(found.union(_reach_small(edges, on)).distinct(), "reach")
            break
        if size > (1 - WORTH) * before:
            patience *= 2
        most = 8
    for record in reversed(records):
        more = record.where("other is null").join(found.withColumnRenamed("node", "anchor"), "anchor", "left_semi").select("node")
        found = written(found.union(more).distinct(), "reach")
    return found


def _reach_rounds(edges: DataFrame, entries: DataFrame, patience: int) -> tuple[DataFrame, bool]:
    """What up to patience rounds reach, and whether that is all."""
    out, seen, frontier = _by(edges, "from"), entries, entries
    for k in range(1, patience + 1):
        step = out.join(frontier.withColumnRenamed("node", "from"), "from").select(F.col("to").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            out.unpersist()
            return seen, True
        seen = seen.union(frontier)
        if k % 16 == 0:
            seen = written(seen, "reach")
    out.unpersist()
    return written(seen, "reach"), False


def unreachable(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no entry reaches; none at all if there is no entry among the files."""
    own = entries.join(files.select(F.col("path").alias("node")), "node", "left_semi")
    found = files.join(reachable(edges, own).withColumnRenamed("node", "path"), "path", "left_anti")
    return found.join(own.limit(1).select(F.lit(True).alias("_any")), how="cross").drop("_any")  # one row or none


def used_names(exports: DataFrame, uses: DataFrame, stars: DataFrame, consumed: DataFrame) -> DataFrame:
    """(path, name): exports that something asks for.

    uses: (to, name) demands.  consumed: (path) files all of whose names are taken, and with them all
    names of the files that they pass on.  stars: (path, to), a file that passes on another's names.  A
    demand for a name that a file doesn't declare goes on to what it passes on."""
    star_edges = written(stars.select(F.col("path").alias("from"), "to").distinct(), "stars")
    whole = reachable(star_edges, consumed.select(F.col("path").alias("node")).distinct())
    declared = written(exports.select("path", "name").distinct(), "declared")
    demands, keys = written(uses.select(F.col("to").alias("path"), "name").distinct(), "demand"), ["path", "name"]
    # only a file with stars hands on, and only names that it doesn't declare: rounds move and remember nothing else
    handing = star_edges.select(F.col("from").alias("path")).distinct()
    onward = _by(star_edges.join(handing.withColumnRenamed("path", "to"), "to", "left_semi").select("from", "to"), "from")
    own = _by(declared.join(handing, "path", "left_semi"), *keys)
    frontier, rounds = written(demands.join(handing, "path", "left_semi").join(own, keys, "left_anti"), "handed"), 0
    handed = frontier
    while not frontier.isEmpty():
        rounds += 1
        step = onward.join(frontier.withColumnRenamed("path", "from"), "from").select(F.col("to").alias("path"), "name").distinct()
        frontier = written(step.join(own, keys, "left_anti").join(handed, keys, "left_anti"), "handed")
        handed = handed.union(frontier)
        handed = written(handed, "handed") if rounds % 16 == 0 else handed
    onward.unpersist(), own.unpersist()
    asked = demands.union(handed.withColumnRenamed("path", "from").join(star_edges, "from").select("to", "name"))
    all_of = declared.join(whole.withColumnRenamed("node", "path"), "path", "left_semi")
    return declared.join(asked.union(all_of), keys, "left_semi")


def unreferenced(exports: DataFrame, used: DataFrame, skipped: DataFrame) -> DataFrame:
    """(path, name, line): the first export of each name that nothing uses, outside skipped files."""
    first = exports.groupBy("path", "name").agg(F.min_by("line", "pos").alias("line"))
    return first.join(used, ["path", "name"], "left_anti").join(skipped.select("path"), "path", "left_anti").select("path", "name", "line")


# -- merging


def merge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs with a `seq` (order of languages): of nodes with one id and of equal edges, the first row wins."""
    first_node = nodes.groupBy("id").agg(F.min_by(F.struct("label", "kind", "loc"), F.struct("seq", "label", "kind", "loc")).alias("n")).select("id", "n.label", "n.kind", "n.loc")
    first_edge = edges.groupBy("from", "to", "kind").agg(F.min_by("weight", F.struct("seq", "weight")).alias("weight"))
    return first_node, first_edge


def package_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, kind): ends of edges that are no nodes, as packages."""
    ends = edges.select(F.col("from").alias("id")).union(edges.select("to")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"), F.lit("package").alias("kind"))


# -- views


def focus(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, rows: int) -> DataFrame:
    """(id, in_cycle, degree): the nodes shown first: those in cycles, then by degree, then id."""
    d = degrees(nodes, edges).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    member = cycles.select(F.col("node").alias("id"), F.lit(True).alias("in_cycle")).distinct()
    return d.join(member, "id", "left").select("id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), "degree").orderBy(F.desc("in_cycle"), F.desc("degree"), "id").limit(rows)


def known_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    return edges.join(kept.select(F.col("id").alias("from")), "from", "left_semi").join(kept.select(F.col("id").alias("to")), "to", "left_semi").select(edges.columns)


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """(node): a node and its direct neighbours on both sides."""
    near = edges.where((F.col("from") == node) | (F.col("to") == node))
    return near.select(F.explode(F.array("from", "to")).alias("node")).distinct()


def edge_classes(edges: DataFrame, nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """edges with `class`: cycle if both ends are in one cycle, package if an end is one, else local."""
    a = cycles.select(F.col("node").alias("from"), F.col("component").alias("ca"))
    b = cycles.select(F.col("node").alias("to"), F.col("component").alias("cb"))
    packages = nodes.where("kind = 'package'").select("id")
    pa_, pb = packages.select(F.col("id").alias("from"), F.lit(True).alias("pa")), packages.select(F.col("id").alias("to"), F.lit(True).alias("pb"))
    joined = edges.join(a, "from", "left").join(b, "to", "left").join(pa_, "from", "left").join(pb, "to", "left")
    kind = F.when(F.col("ca") == F.col("cb"), "cycle").when(F.col("pa") | F.col("pb"), "package").otherwise("local")
    return joined.select(*edges.columns, kind.alias("class"))


def collapse(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(from, to, kind, weight) with nodes in folded folders replaced: inside is (node, folder).

    Parallel edges become one with the sum of weights (a missing one is 1), an edge that stays alone
    keeps its weight, and an edge inside one folder goes."""
    a = inside.select(F.col("node").alias("from"), F.col("folder").alias("fa"))
    b = inside.select(F.col("node").alias("to"), F.col("folder").alias("fb"))
    moved = edges.join(a, "from", "left").join(b, "to", "left").select(F.coalesce("fa", "from").alias("from"), F.coalesce("fb", "to").alias("to"), "kind", "weight")
    one = moved.where("`from` <> `to`").groupBy("from", "to", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(1))).alias("all"), F.first("weight").alias("own"))
    return one.select("from", "to", "kind", F.when(F.col("n") > 1, F.col("all")).otherwise(F.col("own")).alias("weight"))


def levels(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(component, node, level): within each component, how many edges the least way from its first node has.

    All components take their rounds together, and a round carries new nodes only."""
    a = cycles.select("component", F.col("node").alias("from"))
    b = cycles.select(F.col("component").alias("_c"), F.col("node").alias("to"))
    inside = written(edges.select("from", "to").join(a, "from").join(b, "to").where("component = _c").select("component", "from", "to").distinct(), "inside")
    out = _by(inside, "from")
    frontier, level = written(cycles.groupBy("component").agg(F.min("node").alias("node")), "levels"), 0
    seen = frontier.withColumn("level", F.lit(0))
    while not frontier.isEmpty():
        level += 1
        step = out.join(frontier.select(F.col("node").alias("from")), "from").select("component", F.col("to").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").select("component", "node"), "levels")
        seen = seen.union(frontier.withColumn("level", F.lit(level)))
        seen = written(seen, "levels") if level % 16 == 0 else seen
    out.unpersist()
    return seen


def back_edges(edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """(from, to): edges to set aside so that no cycle is left.

    Only edges inside a component can close a loop.  Of those, the ones that don't lead to a greater
    level (see levels()) are back edges: what is left rises in every component, so it has no cycle.
    A depth-first walk would set aside other ones, but is a single sequence; this takes rounds of joins."""
    cycles = scc(edges) if cycles is None else cycles
    at = written(levels(edges, cycles), "levels")
    a = at.select("component", F.col("node").alias("from"), F.col("level").alias("_a"))
    b = at.select(F.col("component").alias("_c"), F.col("node").alias("to"), F.col("level").alias("_b"))
    return edges.select("from", "to").distinct().join(a, "from").join(b, "to").where("component = _c and _b <= _a").select("from", "to")


def ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank) of an acyclic graph: the longest way from a node without an edge to it.

    A graph with a cycle is an error: take its back_edges() out before."""
    state = written(nodes.select("id", F.lit(0).alias("rank")), "ranks")
    frontier, most, rounds = state, state.count(), 0
    while not frontier.isEmpty():
        rounds += 1
        if rounds > most:
            raise ValueError("the graph has a cycle")
        step = edges.join(frontier.select(F.col("id").alias("from"), "rank"), "from").groupBy(F.col("to").alias("id")).agg((F.max("rank") + 1).alias("rank"))
        frontier = written(step.join(state.withColumnRenamed("rank", "old"), "id").where("rank > old").select("id", "rank"), "ranks")
        state = written(state.union(frontier).groupBy("id").agg(F.max("rank").alias("rank")), "ranks")
    return state


def focused(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, rows: int) -> dict[str, DataFrame]:
    """What of a graph is shown: nodes (see focus()), edges between them, cycles that are kept whole, and `hidden`, one row."""
    kept = written(focus(nodes, edges, cycles, rows), "focus")
    cut = cycles.join(kept.select(F.col("id").alias("node")), "node", "left_anti").select("component").distinct()
    hidden = nodes.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("hidden"))  # one row each
    return {"nodes": kept, "edges": known_edges(edges, kept), "cycles": cycles.join(cut, "component", "left_anti"), "hidden": hidden}


def merge_cycles(cycles: DataFrame) -> DataFrame:
    """(component, node) of several languages' cycles (seq, component, node): of equal node sets the first, whatever their order."""
    whole = cycles.groupBy("seq", "component").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    once = whole.groupBy("nodes").agg(F.min_by("component", "seq").alias("component"))
    return once.select("component", F.explode("nodes").alias("node"))


def collapse_cycles(cycles: DataFrame, inside: DataFrame) -> DataFrame:
    """(component, node) with nodes in folded folders replaced; a cycle of which one node is left goes."""
    moved = cycles.join(inside, "node", "left").select("component", F.coalesce("folder", "node").alias("node")).distinct()
    several = moved.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return moved.join(several, "component", "left_semi")


def cross_language(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> dict[str, DataFrame]:
    """The graphs of all languages as one: nodes with packages, edges, ordered cycles, and a summary of what was analysed.

    nodes, edges and cycles have a `seq`, the order of languages.  The summary counts no packages."""
    own, merged = merge(nodes, edges)
    both = merge_cycles(cycles)
    packages = package_nodes(own, merged).select("id", "label", "kind", F.lit(None).cast("long").alias("loc"))
    return {"nodes": own.unionByName(packages), "edges": merged, "cycles": ordered_cycles(both, merged), "summary": summary(own, merged, both)}
