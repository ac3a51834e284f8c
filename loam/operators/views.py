"""Scales, rankings and roll-ups over the other operators' results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js
from ..session import written


def ratio_to_max(rows: DataFrame, value: str, limit: int, *order) -> DataFrame:
    """The largest rows, each with its share of the largest value; 0 if that isn't positive.

    The limit comes first: the largest value is among the rows that are left."""
    top = rows.orderBy(F.desc(value), *order).limit(limit)
    most = F.max(value).over(Window.partitionBy())
    return top.withColumn("ratio", F.when(most > 0, F.col(value) / most).otherwise(0.0))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row with q0, q1, ..: interpolated quantiles of a column without nulls; nulls for no rows.

    Equal values are counted first; the counts are sorted by ranges, each range adds its own up, and
    only the sums of ranges meet in one task."""
    counts = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = counts.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = counts.join(F.broadcast(before), "part").select("v", "n", "all", end.alias("end"))  # one row for each range
    rank = lambda q: F.lit(float(q)) * (F.col("all") - 1)
    at = lambda r: F.max(F.when((F.col("end") - F.col("n") <= r) & (r < F.col("end")), F.col("v")))
    ends = placed.agg(*(at(f(rank(q))).alias(f"{c}{k}") for k, q in enumerate(shares) for c, f in (("lo", F.floor), ("hi", F.ceil))), *(F.max(rank(q) - F.floor(rank(q))).alias(f"f{k}") for k, q in enumerate(shares)))
    return ends.select(*((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"f{k}")).alias(f"q{k}") for k in range(len(shares))))


def heat_scale(rows: DataFrame, value: str) -> DataFrame:
    """One row: low, high and the quintiles q20 to q80, interpolated; zeros for no rows."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf"))).select(value)
    q = quantiles(finite, value, (0, 0.2, 0.4, 0.6, 0.8, 1))
    names = ("low", "q20", "q40", "q60", "q80", "high")
    scale = q.select(*(F.coalesce(f"q{k}", F.lit(0.0)).alias(c) for k, c in enumerate(names)))
    return scale.select("low", "high", *names[1:-1])


def heat_levels(rows: DataFrame, value: str, scale: DataFrame) -> DataFrame:
    """rows with `level` 1 to 5: the first quintile that the value doesn't exceed.  scale is one row."""
    level = F.lit(5)
    for k in (4, 3, 2, 1):
        level = F.when(F.col(value) <= F.col(f"q{20 * k}"), k).otherwise(level)
    return rows.crossJoin(F.broadcast(scale.limit(1))).withColumn("level", level).drop("low", "high", "q20", "q40", "q60", "q80")


def heat_bands(scale: DataFrame) -> DataFrame:
    """(level, low, high): the bounds of each level."""
    bounds = ["low", "q20", "q40", "q60", "q80", "high"]
    return scale.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("level"), F.col(a).alias("low"), F.col(b).alias("high")) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])).alias("b")).select("b.*")


def folder_sizes(files: DataFrame, weight: str) -> DataFrame:
    """(folder, size, files) over everything below each folder; partial sums are made before the shuffle."""
    return files.select(F.explode(js.ancestors(F.col("path"))).alias("folder"), weight).groupBy("folder").agg(F.sum(weight).alias("size"), F.count("*").alias("files"))


def knotted_folders(files: DataFrame, cycles: DataFrame) -> DataFrame:
    """(folder, knotted): whether a file below is in a cycle."""
    marked = files.select("path").join(cycles.select(F.col("node").alias("path"), F.lit(True).alias("k")).distinct(), "path", "left")
    return marked.select(F.explode(js.ancestors(F.col("path"))).alias("folder"), "k").groupBy("folder").agg(F.coalesce(F.bool_or("k"), F.lit(False)).alias("knotted"))


def folded_into(files: DataFrame, folded: DataFrame) -> DataFrame:
    """(node, folder): for files below folded folders, the shallowest such folder."""
    above = files.select(F.col("path").alias("node"), F.posexplode(js.ancestors(F.col("path"))).alias("depth", "folder"))
    return above.join(folded.select("folder"), "folder", "left_semi").groupBy("node").agg(F.min_by("folder", "depth").alias("folder"))


def dead_code_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))


def dead_code_by_reason(findings: DataFrame) -> DataFrame:
    return findings.groupBy("reason").agg(F.count("*").alias("findings"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By path, then line and symbol, absent ones first; strings in the root locale's order."""
    key = lambda c: js.locale_key(F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = js.in_locale_order(findings, "path")
    return findings.orderBy(path[0], F.coalesce("line", F.lit(0)), key("symbol"), *path[1:], "symbol")


def overview(
    files: DataFrame, languages: list[str], hotspots: DataFrame, summary: DataFrame, totals: DataFrame, findings: DataFrame, loaded: int | None, failures: int = 0
) -> DataFrame:
    """(position, key, value, hint, tone, title): the six cards that lead an overview.

    hotspots: (path, score); the top one is that of the highest score, then of the least path, and without scores above zero there is none.  summary and totals: one row each,
    of graph.summary() and commits.totals().  loaded: plug-ins that were loaded, None while that isn't known."""
    top = hotspots.where("score > 0").select("score", F.col("path").cast("string").alias("path")).orderBy(F.desc("score"), "path").limit(1)
    top = top.agg(F.first("path").alias("path"), F.first("score").alias("score"))
    one = files.agg(F.count("*").alias("files")).crossJoin(top).crossJoin(summary.select("cycles", "cycle_nodes")).crossJoin(totals.select("total", "valid", "breaking"))
    one = one.crossJoin(dead_code_count(findings).select("findings", F.col("files").alias("dead_files")))  # one row each
    said = "no language analysed" if not languages else languages[0] if len(languages) == 1 else f"{len(languages)} languages"
    plugins = "loading…" if loaded is None else f"{failures} skipped" if failures else "all loaded"
    n, text, plain, none = js.compact_number, lambda c: F.col(c).cast("string"), F.lit("plain"), F.lit(None).cast("string")
    tone = lambda c, name: F.when(F.col(c) > 0, name).otherwise("plain")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    cards = [
        ("files", n(F.col("files")), F.lit(said), plain, none),
        ("hotspot", F.coalesce(name, F.lit(js.NONE)), F.when(F.col("path").isNull(), "no scores").otherwise(F.concat(F.lit("score "), n(F.col("score")))), plain, F.col("path")),
        ("cycles", n(F.col("cycles")), F.when(F.col("cycles") > 0, F.concat(text("cycle_nodes"), F.lit(" files"))).otherwise("none"), tone("cycles", "danger"), none),
        ("commits", n(F.col("total")), F.when(F.col("breaking") > 0, F.concat(text("breaking"), F.lit(" breaking"))).otherwise(F.concat(text("valid"), F.lit(" conventional"))), tone("breaking", "warn"), none),
        ("dead-code", n(F.col("findings")), F.when(F.col("findings") > 0, F.concat(text("dead_files"), F.lit(" files"))).otherwise("none"), tone("findings", "warn"), none),
        ("plugins", F.lit(js.NONE) if loaded is None else n(F.lit(loaded)), F.lit(plugins), F.lit("warn" if failures else "plain"), none),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c[0]).alias("key"), *(v.alias(a) for v, a in zip(c[1:], ("value", "hint", "tone", "title"), strict=True))) for k, c in enumerate(cards, 1)])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def recent_runs(runs: DataFrame, rows: int = 8) -> DataFrame:
    """The latest runs, one for each finishing time."""
    return runs.groupBy("finished_at").agg(F.min("id").alias("id")).orderBy(F.desc("finished_at")).limit(rows)


def run_display(branch: Column, rev: Column) -> Column:
    """`branch @ revision`, with `detached` for no branch and 8 digits of the revision."""
    return F.concat(F.coalesce(branch, F.lit("detached")), F.lit(" @ "), F.substring(rev, 1, 8))


def cache_misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose content has no stored result: left anti on blob."""
    return files.join(cached.select("blob"), "blob", "left_anti")


def cache_delta(files: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: hits and misses of the files' contents."""
    marked = files.join(cached.select("blob", F.lit(1).alias("_hit")).distinct(), "blob", "left")
    return marked.agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def compressed_folders(files: DataFrame) -> DataFrame:
    """(folder, parent, name): folders with a file of their own or several subfolders; chains between them are joined in the name."""
    folders = files.select(F.explode(js.ancestors(F.col("path"))).alias("folder")).distinct()
    children = folders.groupBy(js.dir_name(F.col("folder")).alias("folder")).agg(F.count("*").alias("subfolders"))
    leaves = files.select(js.dir_name(F.col("path")).alias("folder")).distinct().withColumn("own", F.lit(True))
    kept = folders.join(children, "folder", "left").join(leaves, "folder", "left").where("own OR coalesce(subfolders, 0) <> 1").select("folder")
    above = kept.select("folder", F.explode(F.concat(F.array(F.lit("")), js.ancestors(F.col("folder")))).alias("parent"))
    near = above.join(kept.select(F.col("folder").alias("parent")).union(kept.sparkSession.createDataFrame([("",)], "parent string")), "parent", "left_semi").groupBy("folder").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    cut = F.when(F.col("parent") == "", 1).otherwise(F.length("parent") + 2)
    return near.select("folder", "parent", F.substring(F.col("folder"), cut, F.length("folder")).alias("name"))


def open_rows(files: DataFrame, opened: DataFrame) -> DataFrame:
    """(path, depth): files and folders that a tree shows with some folders open; sorted by path they are in its order."""
    items = files.select("path").union(files.select(F.explode(js.ancestors(F.col("path"))))).distinct()
    each = items.select("path", F.explode_outer(js.ancestors(F.col("path"))).alias("folder"))
    shown = each.join(opened.select("folder", F.lit(1).alias("_open")).distinct(), "folder", "left")
    return shown.groupBy("path").agg(F.count("folder").alias("depth"), F.count("_open").alias("_n")).where("depth = _n").select("path", "depth")
