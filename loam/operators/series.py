"""Metrics in one form: (series, subject, value, meta), where meta is a variant that holds what only that metric has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import BETWEEN

COLUMNS = ("series", "subject", "value", "meta")


def series(rows: DataFrame, name: str, subject: Column, value: Column, **meta: Column | str) -> DataFrame:
    """rows as points of a series; meta: fields by name, null ones included.  Without fields meta is an empty object."""
    fields = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in meta.items()]
    held = F.to_variant_object(F.struct(*fields)) if fields else F.parse_json(F.lit("{}"))
    return rows.select(F.lit(name).alias("series"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), held.alias("meta"))


def field(name: str, kind: str, meta: str = "meta") -> Column:
    """A field of meta as a column of a kind; null where a point has none, or one that isn't of that kind."""
    return F.try_variant_get(F.col(meta), f"$.{name}", kind)


def of_hotspots(rows: DataFrame) -> DataFrame:
    return series(rows, "hotspots", F.col("path"), F.col("score"), changes="changes", complexity="complexity")


def of_coupling(rows: DataFrame) -> DataFrame:
    return series(
        rows, "change-coupling", F.concat_ws(BETWEEN, "file_a", "file_b"), F.col("degree"),
        fileA="file_a", fileB="file_b", sharedChanges="shared_changes", changesA="changes_a", changesB="changes_b",
    )


def united(every: list[DataFrame]) -> DataFrame:
    """All points of several metrics; whatever their metas hold, the form is one."""
    return reduce(DataFrame.unionAll, [df.select(*COLUMNS) for df in every])


def has_form(df: DataFrame) -> bool:
    return list(df.columns) == list(COLUMNS)
