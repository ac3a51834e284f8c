"""The commit log as a stream: commits by week, each commit counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly(commits: DataFrame, ts: str = "ts", sha: str = "sha", late: str = "14 days") -> DataFrame:
    """(week, commits) of a stream of commits.

    Weeks start on Monday: the epoch was a Thursday, so windows are shifted by four days.  Commits seen
    again within the watermark are dropped; later ones than that are not counted."""
    once = commits.withWatermark(ts, late).dropDuplicatesWithinWatermark([sha])
    return once.groupBy(F.window(ts, "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("commits")).select(F.to_date("w.start").alias("week"), "commits")


def churn(touches: DataFrame) -> DataFrame:
    """(path, changes) of a stream of touches, as a running count (update or complete mode)."""
    return touches.groupBy("path").agg(F.count("*").alias("changes"))
