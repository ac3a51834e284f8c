"""Audit of how filters interact: what every order of them keeps, removes and loses.

Each document has a failure flag for each filter.  Documents with the same flags in the same part are
counted together; a CUBE over the flags and the part then gives, in its rows whose chosen flags are all
false, the documents that survive each subset of filters.  A step of an order takes the filters from one
subset to the next larger one, so all figures of all orders come from joins of pairs of subsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import words as W
from .quality_rules import Stats

_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))


def failures(column: pa.Array) -> dict[str, np.ndarray]:
    """For each text: A under 100 words; B distinct words under 80 % of words; C over 10 % capitals; D a sign of `#$%&*|`."""
    s = Stats(column)
    order = W.sort_within(s.w.doc, s.w.hash)
    d, h = s.w.doc[order], s.w.hash[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])[: len(d)]
    distinct = np.bincount(d[new], minlength=len(column))
    chars = np.diff(np.concatenate([[0], np.cumsum((s.w.data & 0xC0) != 0x80)])[s.w.offsets])
    return {"A": s.n_words < 100, "B": 100 * distinct < 80 * s.n_words, "C": 100 * s.n_capitals > 10 * chars, "D": s._sum(_MARKS) > 0}


def add_failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of each row, without its text; null texts are empty, null parts the empty string."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, "text"):
            made = failures(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("doc_id", "part", "digest")), *map(pa.array, made.values())], names=["doc_id", "part", "digest", *made])

    schema = rows.select("doc_id", "part", "digest").schema
    for c in "ABCD":
        schema = schema.add(c, "boolean")
    return rows.mapInArrow(run, schema)


def profiles(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, toxic): documents of each part with the same flags; E: the text of a smaller doc_id too.

    Several label rows of one id: good or toxic if any is.  Rows of null id are never copies nor
    labelled.  The first row of a text is found from counts for each text, part and label, which are added up before
    they are dealt; no group holds a row for each copy.
    """
    flags = [c for c in failed.columns if c not in ("doc_id", "part", "digest")]
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed.groupBy("doc_id", "part", "digest", *flags).agg(F.count("*").alias("n")).join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    copies = rows.groupBy("digest", "part", *flags, "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id"), F.lit(0)).alias("n_least"),
    )
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("n_least")).otherwise(0) + F.col("n_null")
    two = copies.withColumn("first", first).select(
        "part", *flags, "good", "toxic",
        F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("first")).alias("n")))).alias("x"),
    )
    return two.where("x.n > 0").groupBy("part", *flags, F.col("x.E").alias("E")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic")
    )


def survivors(found: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, subset, kept, good, toxic): what each subset of filters keeps of each part, zeros included.

    found: rows of flags, part, n, good and toxic.  subset: a bit for each filter, the first one's least.  The cube's rows over
    all parts have a null part."""
    names = list(filters)
    cube = found.cube(*names, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), *(F.grouping(c).alias(f"no_{c}") for c in [*names, "part"]))
    none_fails = F.lit(True)
    for c in names:
        none_fails = none_fails & ((F.col(f"no_{c}") == 1) | ~F.col(c))
    subset: Column = F.lit(0)
    for k, c in enumerate(names):
        subset = subset + (1 - F.col(f"no_{c}")) * (1 << k)
    some = cube.where(none_fails).select("part", F.col("no_part").alias("whole"), subset.alias("subset"), F.col("n").alias("kept"), "good", "toxic")
    every = found.select("part").distinct().select("part", F.lit(0).alias("whole")).union(found.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(1)))
    every = every.select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    same = [every["whole"] == some["whole"], every["part"].eqNullSafe(some["part"]), every["subset"] == some["subset"]]
    return every.join(some, same, "left").select(every["part"], every["whole"], every["subset"], *(F.coalesce(some[c], F.lit(0)).alias(c) for c in ("kept", "good", "toxic")))


def audit(found: DataFrame, filters: str = "ABCDE", overall: bool = False) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of filters.

    found: rows of a boolean for each filter (one letter each, up to 7), part, n, good and toxic, such as
    `profiles` gives.  overall: rows of null part for all parts together too.  shapley: the filter's removed documents, summed over all orders.
    An empty table has no parts, and so no rows.  The orders and their steps are the only rows sent to all tasks.
    """
    k = len(filters)
    if not 1 <= k <= 7 or len(set(filters)) < k:
        raise ValueError("one to seven different filters")
    spark, bit = found.sparkSession, {c: 1 << i for i, c in enumerate(filters)}
    sets = survivors(found, filters)
    sets = written(sets if overall else sets.where("whole = 0"), "subsets")
    moves = [(before, c, before | b, math.factorial(before.bit_count()) * math.factorial(k - 1 - before.bit_count())) for c, b in bit.items() for before in range(1 << k) if not before & b]
    pair = spark.createDataFrame(moves, "subset int, filter string, larger int, orders long")
    small = sets.join(F.broadcast(pair), "subset")
    large = sets.select(F.col("part").alias("p"), F.col("whole").alias("w"), F.col("subset").alias("larger"), *(F.col(c).alias(f"{c}_after") for c in ("kept", "good", "toxic")))
    both = small.join(large, (small["part"].eqNullSafe(large["p"])) & (small["whole"] == large["w"]) & (small["larger"] == large["larger"]))
    gone = F.col("kept") - F.col("kept_after")
    both = both.select(
        "part", "whole", "subset", "filter", "orders", F.col("kept_after").alias("kept"), gone.alias("removed"),
        (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"),
    )
    last = F.col("subset") == (1 << k) - 1 - F.element_at(F.create_map(*(F.lit(x) for p in bit.items() for x in p)), F.col("filter"))
    each = both.groupBy("part", "whole", "filter").agg(
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    each = each.select(F.col("part").alias("p"), F.col("whole").alias("w"), F.col("filter").alias("f"), "fails", "unique_fails", "shapley")
    both = both.join(each, both["part"].eqNullSafe(each["p"]) & (both["whole"] == each["w"]) & (both["filter"] == each["f"]))
    steps = [("".join(o), i + 1, sum(bit[c] for c in o[:i]), o[i]) for o in permutations(filters) for i in range(k)]
    step = spark.createDataFrame(steps, "filter_order string, step int, subset int, filter string")
    return both.join(F.broadcast(step), ["subset", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame, overall: bool = False) -> DataFrame:
    """The audit of the filters A to E over documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    return audit(written(profiles(add_failures(docs), labels), "profiles"), overall=overall)
