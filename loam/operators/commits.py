"""Commit messages by convention, and what a log says as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js

#: `type(scope)!: subject` over the whole first line.
HEADER = rf"\A(\w+)(?:\(([^)]+)\))?(!)?:[{js.SPACE}]({js.DOT}+)\z"
FOOTER = "BREAKING CHANGE:"


def header_fields(message: Column) -> dict[str, Column]:
    """type, scope, bang and subject of the first line; null where the line has another form."""
    first = F.substring_index(message, "\n", 1)
    part = lambda k: F.nullif(F.regexp_extract(first, HEADER, k), F.lit(""))
    return {"type": part(1), "scope": part(2), "bang": part(3).isNotNull(), "subject": part(4)}


def tags(message: Column) -> Column:
    """Issue numbers and co-authors found anywhere in a message; a kind without any has no key."""
    issues = F.regexp_extract_all(message, F.lit(r"#(\d+)"), 1)
    authors = F.transform(F.regexp_extract_all(message, F.lit(rf"(?im)^Co-authored-by:[{js.SPACE}]*({js.DOT}+)$"), 1), js.trim)
    return F.map_filter(F.create_map(F.lit("issues"), issues, F.lit("coauthors"), authors), lambda _, v: F.size(v) > 0)


def parse_commits(commits: DataFrame, message: str = "message") -> DataFrame:
    """commits with type, scope, breaking, subject, tags and valid.

    An invalid header has no type and scope, isn't breaking whatever its footer says, and its subject
    is the whole first line."""
    fields = header_fields(F.col(message))
    valid = fields["type"].isNotNull()
    first = F.substring_index(F.col(message), "\n", 1)
    return commits.withColumns({
        "type": fields["type"], "scope": fields["scope"],
        "breaking": F.when(valid, fields["bang"] | F.col(message).contains(FOOTER)).otherwise(False),
        "subject": F.coalesce(fields["subject"], first), "tags": tags(F.col(message)), "valid": valid,
    })


def totals(parsed: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """One row: total, valid, invalid, valid_rate and breaking.  total counts the raw log if it is given."""
    one = parsed.agg(
        F.count("*").alias("parsed"), F.count_if("valid").alias("valid"), F.count_if("breaking").alias("breaking"),
    )
    counted = total.agg(F.count("*").alias("total")) if total is not None else None
    one = one.crossJoin(counted) if counted is not None else one.withColumn("total", F.col("parsed"))  # one row each
    rate = F.coalesce(F.try_divide(F.col("valid").cast("double"), F.col("parsed")), F.lit(0.0))
    return one.select("total", "valid", (F.col("parsed") - F.col("valid")).alias("invalid"), rate.alias("valid_rate"), "breaking")


def buckets(parsed: DataFrame, field: str) -> DataFrame:
    """(name, count, share, breaking, position) of each value of a field; null is a value.

    Ordered by count, then name in the root locale's order, null last among equal counts.  The window runs over the groups, not
    over the commits."""
    groups = parsed.groupBy(F.col(field).alias("name")).agg(F.count("*").alias("count"), F.count_if("breaking").alias("breaking"))
    order = Window.orderBy(F.desc("count"), F.col("name").isNull(), *js.in_locale_order(groups, "name"))
    return groups.select("name", "count", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"), "breaking", F.row_number().over(order).alias("position"))


def type_rows(parsed: DataFrame, other: str = "other") -> DataFrame:
    """Commits by type as an overview shows them: no type counts as `other`."""
    return buckets(parsed.withColumn("_name", F.coalesce("type", F.lit(other))), "_name")


def weekly(commits: DataFrame, ts: str = "ts") -> DataFrame:
    """(week, commits) for every Monday from the first to the last, zeros included; null times are left out."""
    counts = commits.where(F.col(ts).isNotNull()).groupBy(F.to_date(F.date_trunc("week", ts)).alias("week")).agg(F.count("*").alias("commits"))
    span = counts.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return every.join(counts, "week", "left").select("week", F.coalesce("commits", F.lit(0)).alias("commits"))


def valid_dates(commits: DataFrame, date: str) -> DataFrame:
    """commits whose date string is a time, with `ts`."""
    return commits.withColumn("ts", F.try_to_timestamp(F.col(date))).where("ts is not null")


def limit_history(commits: DataFrame, newest: int, ts: str = "ts", sha: str = "sha") -> DataFrame:
    """The newest commits; all of them for 0."""
    return commits.orderBy(F.desc(ts), F.desc(sha)).limit(newest) if newest else commits


def breaking_timeline(parsed: DataFrame, ts: str = "ts") -> DataFrame:
    """(week, breaking): breaking commits by week."""
    return weekly(parsed.where("breaking"), ts).withColumnRenamed("commits", "breaking")


def ownership(touches: DataFrame) -> DataFrame:
    """(path, owner, owner_commits, commits, authors, share) from (path, author): who changes a file most."""
    each = touches.groupBy("path", "author").agg(F.count("*").alias("n"))
    one = each.groupBy("path").agg(F.max_by("author", F.struct("n", -F.col("author"))).alias("owner"), F.max("n").alias("owner_commits"), F.sum("n").alias("commits"), F.count("*").alias("authors"))
    return one.withColumn("share", F.col("owner_commits") / F.col("commits"))


def bus_factor(touches: DataFrame, cover: float = 0.5) -> DataFrame:
    """(path, bus_factor): the fewest authors that made `cover` of a file's commits."""
    each = touches.groupBy("path", "author").agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "author")
    ranked = each.select("path", F.row_number().over(order).alias("k"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("n").over(Window.partitionBy("path")).alias("all"))
    return ranked.where(F.col("run") >= F.col("all") * cover).groupBy("path").agg(F.min("k").alias("bus_factor"))


def knowledge_map(touches: DataFrame) -> DataFrame:
    """(place, commits, authors, owner, share, concentration) of each file and each folder above, from (path, author).

    concentration: the sum of the authors' squared shares, 1 where one author made every change and 1 / n where n made as many each.  A
    folder's figures are those of all changes below it.  All levels come from one pass over counts for each file and author."""
    each = touches.groupBy("path", "author").agg(F.count("*").alias("n"))
    placed = each.select(F.explode(F.concat(F.array("path"), js.ancestors(F.col("path")))).alias("place"), "author", "n")
    sums = placed.groupBy("place", "author").agg(F.sum("n").alias("n"))
    one = sums.groupBy("place").agg(
        F.sum("n").alias("commits"), F.count("*").alias("authors"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner"),
        F.max("n").alias("_most"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_squares"),
    )
    total = F.col("commits").cast("double")
    return one.select("place", "commits", "authors", "owner", (F.col("_most") / total).alias("share"), (F.col("_squares") / (total * total)).alias("concentration"))


def code_age(touches: DataFrame, now: Column) -> DataFrame:
    """(path, last_change, age_days) from (path, ts)."""
    last = touches.groupBy("path").agg(F.max("ts").alias("last_change"))
    return last.withColumn("age_days", F.datediff(now, F.to_date("last_change")))
