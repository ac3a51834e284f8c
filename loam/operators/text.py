"""Metrics of file contents: lines, indentation, windows of lines and copies of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js
from ..session import written

#: Lines in a window that is compared.
WINDOW = 6


def loc(content: Column) -> Column:
    """Line feeds plus one."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def indent_complexity(content: Column) -> Column:
    """The sum over non-blank lines of 1 and half the leading white space, rounded down."""
    def weight(line: Column) -> Column:
        body = F.length(F.regexp_replace(line, rf"\A[{js.SPACE}]+", ""))
        return F.when(body > 0, 1 + F.floor((F.length(line) - body) / 2)).otherwise(0).cast("long")

    return F.aggregate(F.transform(js.lines(content), weight), F.lit(0).cast("long"), lambda a, b: a + b)


def significant_lines(content: Column) -> Column:
    """Lines with their white space collapsed that are longer than 3 characters.

    Runs of white space are collapsed on the whole text, around line feeds to nothing; lines are cut then."""
    inner = js.SPACE.replace(r"\n", "")
    flat = F.regexp_replace(content, rf"[{inner}]+", " ")
    bare = F.regexp_replace(F.regexp_replace(flat, " ?\n ?", "\n"), r"\A | \z", "")
    return F.filter(F.split(bare, "\n"), lambda s: F.length(s) > 3)


def prints(lines: Column, window: int = WINDOW) -> Column:
    """The first 16 hex digits of the SHA-1 of each window of lines."""

    def all_of(own: Column) -> Column:
        one = lambda k: F.substring(F.sha1(F.array_join(F.slice(own, k, window), "\n")), 1, 16)
        return F.when(F.size(own) >= window, F.transform(F.sequence(F.lit(1), F.size(own) - (window - 1)), one)).otherwise(F.array().cast("array<string>"))

    return js.let(lines, all_of)


def fingerprints(files: DataFrame, content: str = "content", window: int = WINDOW) -> DataFrame:
    """(path, fp_lines, prints)."""
    lined = files.withColumn("_lines", significant_lines(F.col(content)))
    return lined.select("path", F.size("_lines").alias("fp_lines"), prints(F.col("_lines"), window).alias("prints"))


def duplication(scans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(path, duplicated_lines, fp_lines, duplication) from (path, fp_lines, prints).

    A window that occurs twice or more over all files and places marks its lines.  The scans are written
    once, since they are read for the counts, the places and the shares; counts are pre-aggregated by
    print, and only prints that occur again are joined back."""
    scans = written(scans.select("path", "fp_lines", "prints"), "scans")
    each = scans.select("path", F.posexplode("prints").alias("at", "print"))
    again = each.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    hits = each.join(again, "print").groupBy("path").agg(F.collect_list("at").alias("ats"))
    marked = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (window - 1))))))
    counted = scans.select("path", "fp_lines").join(hits.select("path", marked.alias("marked")), "path", "left")
    n = F.coalesce("marked", F.lit(0))
    share = F.when(F.col("fp_lines") > 0, js.round_half_up(n / F.col("fp_lines"), 3)).otherwise(0.0)
    return counted.select("path", n.alias("duplicated_lines"), "fp_lines", share.alias("duplication"))


def files_digest(files: DataFrame) -> DataFrame:
    """One row: a SHA-256 of the files (path, blob), whatever the order of rows.

    `path NUL blob LF` entries are dealt to 4096 buckets by the path's hash; each bucket's sorted entries
    have a digest, and the result is that of the buckets' digests in order.  No task holds all entries."""
    entry = F.concat("path", F.lit("\0"), "blob", F.lit("\n"))
    bucket = F.substring(F.sha2("path", 256), 1, 3)
    each = files.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("d"))
    both = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], x["d"]))
    return each.agg(F.sha2(F.array_join(both, ""), 256).alias("digest"))
