"""The driver's tables as inputs: a commit log, changed files, source files and a graph.

Adapters are projections and at most an equi-join, so that column pruning reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: A commit message made from an order, in SQL that Spark and DuckDB share.
MESSAGE = """
CASE WHEN o_orderkey % 13 = 0 THEN 'update ' || cast(o_orderkey AS string)
ELSE (CASE o_orderkey % 7 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs' WHEN 3 THEN 'refactor' WHEN 4 THEN 'test' WHEN 5 THEN 'other' ELSE 'perf' END)
  || (CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '(core)' WHEN 2 THEN '(web)' WHEN 3 THEN '(cli)' ELSE '(api)' END)
  || (CASE WHEN o_orderkey % 11 = 0 THEN '!' ELSE '' END)
  || ': change ' || cast(o_orderkey AS string) || ' (#' || cast(o_custkey AS string) || ')' END
|| (CASE WHEN o_orderkey % 17 = 0 THEN chr(10) || chr(10) || 'BREAKING CHANGE: closes #' || cast(o_orderkey AS string) ELSE '' END)
|| (CASE WHEN o_orderkey % 19 = 0 THEN chr(10) || 'Co-authored-by: dev ' || cast(o_custkey AS string) ELSE '' END)
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author, ts, message), one commit for each order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.expr(MESSAGE).alias("message"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, path), one changed path for each line item; a path can be listed twice in a commit."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, blob, content), one source file for each document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".ts")))
    return docs.select(F.col("doc_id").alias("seq"), path.alias("path"), F.sha1("text").alias("blob"), F.col("text").alias("content"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to), a row for each event: its place and that of the next event, if it is another one; a place is a user and one of 50 keys in the event's props."""
    place = F.col("user_id") * 50 + F.regexp_extract("props", "[0-9]+", 0).cast("long") % 50
    events = table(spark, sf_dir, "events").select("event_id", place.alias("place"))
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("place").alias("to"))
    return events.withColumnRenamed("place", "from").join(following, "event_id").where("from <> to").select("from", "to")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to): the different moves()."""
    return moves(spark, sf_dir).distinct()
