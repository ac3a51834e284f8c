"""What the operators share: size-checked broadcasts and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


#: Bytes of rows that are sent to all tasks, at most.
BROADCAST_BYTES = 32 << 20


def sent_if_small(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """A written table, marked for a broadcast join if all its rows of row_bytes fit into the limit.

    The rows are counted, unless the number is known.  A larger table is left as it is, and is joined
    by a shuffle."""
    return F.broadcast(table) if (table.count() if rows is None else rows) * row_bytes <= limit else table


def told_apart(docs: DataFrame, doc_id: str, text: str, to: str) -> DataFrame | None:
    """docs with `to`, an integer for each different (id, text), in the order of ids; None if ids tell texts apart themselves.

    Texts of one id are in the order of their hashes; equal rows have one number, rows of null id none."""
    hashes = [F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(1), text).alias("_u")]
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_i"), *hashes)
    if own.groupBy("_i").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).where("a < b").isEmpty():
        return None
    in_order = own.distinct().repartitionByRange("_i", "_t", "_u").sortWithinPartitions("_i", "_t", "_u")
    numbers = written(in_order.withColumn(to, F.monotonically_increasing_id()), "numbers")
    return docs.withColumns({"_i": F.col(doc_id), "_t": hashes[0], "_u": hashes[1]}).join(numbers, ["_i", "_t", "_u"], "left").drop("_i", "_t", "_u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component: the least node of it.

    Randomised contraction: each node points at the neighbour (or itself) of least hash in this
    round, edges are relabelled by that pointer, and the loop goes on with what is left.  Every round
    shrinks the number of nodes by a constant factor in expectation whatever the ids' order, so
    there are O(log n) rounds of a pre-aggregated group-by and equi-joins.  Null ends are dropped.
    """
    edges = written(edges.where("a is not null and b is not null").selectExpr("a", "b"), f"{name}-edges")
    left = edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    nodes = edges.selectExpr("explode(array(a, b)) as node").distinct()
    labels = written(nodes.selectExpr("node", "node as label"), f"{name}-labels")
    left, salt = written(left, f"{name}-left"), 0
    while not left.isEmpty():
        both = left.union(left.selectExpr("b", "a"))
        rank = F.xxhash64("b", F.lit(salt))
        least = both.groupBy("a").agg(F.min_by("b", F.struct(rank, "b")).alias("b"))
        own = F.struct(F.xxhash64("a", F.lit(salt)), F.col("a"))
        point = written(least.select("a", F.when(own <= F.struct(rank, F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to")), f"{name}-point")
        hop = lambda df, col: df.join(point.selectExpr(f"a as {col}", "to"), col).drop(col).withColumnRenamed("to", col)
        rest = hop(hop(left, "a"), "b").where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
        rest = written(rest, f"{name}-left")
        moved = labels.join(point.selectExpr("a as label", "to"), "label", "left").selectExpr("node", "coalesce(to, label) as label")
        moved = written(moved, f"{name}-labels")
        discard(left, labels, point)
        left, labels = rest, moved
        salt += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
