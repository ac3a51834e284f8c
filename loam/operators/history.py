"""Change frequency, change coupling and hotspots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js


@dataclass(frozen=True)
class CouplingLimits:
    """max_files: larger commits are left out, for pairs and for counts."""

    max_files: int = 30
    min_shared: int = 2
    min_changes: int = 3
    min_degree: float = 30
    rows: int = 500


def churn(touches: DataFrame) -> DataFrame:
    """(path, changes): how often a path is listed, repeats in a commit included."""
    return touches.groupBy("path").agg(F.count("*").alias("changes"))


def small_commits(touches: DataFrame, max_files: int) -> DataFrame:
    """(sha, paths): the distinct paths of each commit that touches no more than max_files.

    One shuffle on sha gives the set, its size and, later, its pairs, so that the self-join of a
    commit's files never leaves its row.  The rank limit is applied before that shuffle too, so a
    commit of millions of files never becomes one row."""
    rank = F.dense_rank().over(Window.partitionBy("sha").orderBy("path"))
    few = touches.select("sha", "path").withColumn("_rank", rank).where(F.col("_rank") <= max_files + 1)
    sets = few.groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return sets.where(F.size("paths") <= max_files)


def changes(commits: DataFrame) -> DataFrame:
    """(path, changes): commits that touch a path, from small_commits()."""
    return commits.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("changes"))


def pairs(commits: DataFrame) -> DataFrame:
    """(file_a, file_b) for each unordered pair of a commit's paths, a before b.

    At most max_files ** 2 / 2 rows for a commit, made in its own row."""
    both = F.transform("paths", lambda a, k: F.transform(F.slice("paths", k + 2, F.size("paths")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b"))))
    return commits.select(F.explode(F.flatten(both)).alias("p")).select("p.file_a", "p.file_b")


def shared(commits: DataFrame, min_shared: int = 1) -> DataFrame:
    """(file_a, file_b, shared_changes)."""
    counts = pairs(commits).groupBy("file_a", "file_b").agg(F.count("*").alias("shared_changes"))
    return counts.where(F.col("shared_changes") >= min_shared)


def with_counts(pair_counts: DataFrame, change_counts: DataFrame, min_changes: int = 1) -> DataFrame:
    """Pairs with the changes of both ends; ends with fewer are dropped before the joins."""
    kept = change_counts.where(F.col("changes") >= min_changes)
    a = kept.select(F.col("path").alias("file_a"), F.col("changes").alias("changes_a"))
    b = kept.select(F.col("path").alias("file_b"), F.col("changes").alias("changes_b"))
    return pair_counts.join(a, "file_a").join(b, "file_b")


def present(pair_counts: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of which both ends are files at the revision."""
    a, b = files.select(F.col("path").alias("file_a")), files.select(F.col("path").alias("file_b"))
    return pair_counts.join(a, "file_a", "left_semi").join(b, "file_b", "left_semi")


def degree():
    """Shared changes as a percentage of the mean of both ends' changes, one decimal."""
    return js.round_half_up(F.lit(200.0) * F.col("shared_changes") / (F.col("changes_a") + F.col("changes_b")), 1)


def coupled(pair_counts: DataFrame, change_counts: DataFrame, limits: CouplingLimits = CouplingLimits(), files: DataFrame | None = None) -> DataFrame:
    """(file_a, file_b, shared_changes, changes_a, changes_b, degree) within the limits, from shared() and changes()."""
    counts = pair_counts.where(F.col("shared_changes") >= limits.min_shared)
    if files is not None:
        counts = present(counts, files)
    out = with_counts(counts, change_counts, limits.min_changes).withColumn("degree", degree())
    return out.where(F.col("degree") >= limits.min_degree).select("file_a", "file_b", "shared_changes", "changes_a", "changes_b", "degree")


def coupling(touches: DataFrame, limits: CouplingLimits = CouplingLimits(), files: DataFrame | None = None) -> DataFrame:
    """(file_a, file_b, shared_changes, changes_a, changes_b, degree) within the limits, unordered."""
    commits = small_commits(touches, limits.max_files)
    return coupled(shared(commits), changes(commits), limits, files)


#: Fixed value: what stands between the two paths of a pair in its name.
BETWEEN = " ↔ "


def top_coupling(touches: DataFrame, limits: CouplingLimits = CouplingLimits(), files: DataFrame | None = None) -> DataFrame:
    """The strongest pairs: by degree, then shared changes, then names in the root locale's order."""
    found = coupling(touches, limits, files)
    names = js.in_locale_order(found, "file_a", "file_b", between=BETWEEN)
    return found.orderBy(F.desc("degree"), F.desc("shared_changes"), *names).limit(limits.rows)


def hotspots(complexity: DataFrame, change_counts: DataFrame) -> DataFrame:
    """(path, changes, complexity, score): files that change, score = changes * complexity."""
    return complexity.join(change_counts, "path").withColumn("score", F.col("changes") * F.col("complexity")).select("path", "changes", "complexity", "score")


def with_loc(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Hotspots with lines of code where metrics have the path; the last row of a path counts (by `seq`)."""
    last = metrics.groupBy("path").agg(F.max_by("loc", "seq").alias("loc"))
    return rows.where("score > 0").join(last, "path", "left")
