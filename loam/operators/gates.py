"""Architecture rules, gates and comparison of two runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scope import in_scope


@dataclass(frozen=True)
class ArchitectureRule:
    """Files that fit `source` must not import files that fit `target` (globs)."""

    source: str
    target: str
    enforced: bool = True


def violations(edges: DataFrame, rules: Sequence[ArchitectureRule]) -> DataFrame:
    """(rule, path, message, severity) for each edge that breaks a rule; rules are a handful, edges are read once."""
    broken = F.filter(
        F.array(*[
            F.when(in_scope(F.col("from"), [r.source]) & in_scope(F.col("to"), [r.target]), F.struct(F.lit(f"{r.source} -> {r.target}").alias("rule"), F.lit("error" if r.enforced else "warning").alias("severity")))
            for r in rules
        ]),
        lambda x: x.isNotNull(),
    )
    each = edges.select("from", "to", F.explode(broken).alias("b"))
    return each.select("b.rule", F.col("from").alias("path"), F.concat(F.lit("imports "), F.col("to")).alias("message"), "b.severity")


def new_cycles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Components of `after` whose set of nodes isn't one of `before`."""
    whole = lambda c: c.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return whole(after).join(whole(before).select("nodes"), "nodes", "left_anti")


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): a full outer join of two series; what is missing counts as 0."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("change", F.col("after") - F.col("before"))


def regressions(compared: DataFrame, percent: float) -> DataFrame:
    """Rows that grew by more than so many percent; new ones always."""
    return compared.where((F.col("change") > 0) & ((F.col("before") == 0) | (100 * F.col("change") > percent * F.col("before"))))


#: What tells the rows of a report's table apart; a language's tables have its id and a dot in front, and its cycles a row for each node.
KEYS = {
    "nodes": ("id",), "edges": ("from", "to", "kind"), "cycles": ("nodes",), "typescript.cycles": ("component", "node"), "dead_code": ("path", "symbol", "reason"), "code_metrics": ("path",),
    "hotspots": ("path",), "coupling": ("file_a", "file_b"), "types": ("name",), "scopes": ("name",), "weeks": ("week",), "metrics": ("series", "subject"),
}


def differences(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(table, key, change, before, after) of two reports' tables: rows that were added, removed or changed, as JSON.

    One grouping over all tables: each row is its table, its key and its other columns, nulls included, so that null keys meet.  A
    key that several rows have is compared by all of them together.  Tables without known keys, or without them among their columns, are left out; a table
    that only one report has counts as empty in the other."""
    keys, sides = keys or KEYS, []
    for side, tables in (("before", before), ("after", after)):
        for name, df in tables.items():
            own = keys.get(name) or keys.get(name.rpartition(".")[2])
            if own is None or not set(own) <= set(df.columns):
                continue
            rest = [c for c in df.columns if c not in own]
            as_json = lambda cols: F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
            sides.append(df.select(F.lit(name).alias("table"), as_json(list(own)).alias("key"), F.lit(side).alias("side"), as_json(rest).alias("value")))
    if not sides:
        raise ValueError("no table with known keys")
    rows = sides[0]
    for other in sides[1:]:
        rows = rows.unionAll(other)
    all_of = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("value")))), ",")
    both = rows.groupBy("table", "key").agg(all_of("before").alias("before"), all_of("after").alias("after"))
    change = F.when(F.col("before") == "", "added").when(F.col("after") == "", "removed").otherwise("changed")
    found = both.where("before <> after").select("table", "key", change.alias("change"), F.nullif("before", F.lit("")).alias("before"), F.nullif("after", F.lit("")).alias("after"))
    return found


def findings(before: dict[str, DataFrame], after: dict[str, DataFrame], percent: float = 10.0) -> DataFrame:
    """(gate, subject, message, severity): new cycles, hotspots that grew by more than so many percent, and new dead code of two reports.

    Gates whose tables either report lacks say nothing.  A cycle is new if no cycle before had its very nodes."""
    out = []
    if "cycles" in before and "cycles" in after:
        # a report's cycles are ordered ways, a row each; those of scc() have a row for each node
        by_node = [c.select(F.col("position").alias("component"), F.explode("nodes").alias("node")) if "nodes" in c.columns else c for c in (before["cycles"], after["cycles"])]
        new = new_cycles(*by_node)
        out.append(new.select(F.lit("new-cycle").alias("gate"), F.array_join("nodes", ", ").alias("subject"), F.format_string("cycle of %d files", F.size("nodes")).alias("message"), F.lit("error").alias("severity")))
    if "hotspots" in before and "hotspots" in after:
        grown = regressions(compare(before["hotspots"], after["hotspots"], "path", "score"), percent)
        said = F.concat(F.lit("score "), F.col("before").cast("string"), F.lit(" -> "), F.col("after").cast("string"))
        out.append(grown.select(F.lit("hotspot-regression").alias("gate"), F.col("path").cast("string").alias("subject"), said.alias("message"), F.lit("warning").alias("severity")))
    dead = [t for t in after if t.rpartition(".")[2] == "dead_code" and t in before]
    for t in dead:
        # lines move: a finding is the same wherever it stands in its file
        cols = ("path", "symbol", "reason")
        met = [after[t][c].eqNullSafe(before[t][c]) for c in cols]
        new = after[t].join(before[t].select(*cols), met, "left_anti")
        out.append(new.select(F.lit("new-dead-code").alias("gate"), F.concat_ws("#", "path", "symbol").alias("subject"), F.col("reason").alias("message"), F.lit("warning").alias("severity")))
    if not out:
        raise ValueError("no table that a gate looks at")
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionAll(other)
    return rows
