"""The static half of an analysis: import graph, cycles, dead code and code metrics of TypeScript and JavaScript files.

Facts of one file are read lexically (`source`), once for each content if a result store is given; what
depends on the whole set of files (resolution, reachability, demand, copies) are joins over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import graph as G
from . import modules as M
from . import source as Z
from . import text as X
from .store import ResultStore

EXTENSIONS = M.EXTENSIONS
#: Of the form of stored scans: raised whenever scan_files() gives other results.
VERSION = "1"


def scan_files(files: DataFrame, content: str = "content") -> DataFrame:
    """files without contents, with loc, complexity, imports, exports, stars, fp_lines and prints."""
    own = [c for c in files.columns if c != content]
    lined = files.withColumn("_lines", X.significant_lines(F.col(content)))
    facts = Z.scan(lined.select(*own, content, F.size("_lines").alias("fp_lines"), X.prints(F.col("_lines")).alias("prints")), content)
    return facts.select(*own, "loc", "complexity", "imports", "exports", "stars", "fp_lines", "prints")


def scans_of(files: DataFrame, read: Callable[[DataFrame], DataFrame], store: ResultStore | None = None) -> DataFrame:
    """(path, and facts) of files (path, blob).  read: rows with a `blob` to the same with their `content`."""
    if store is None:
        return scan_files(read(files.select("path", "blob")))
    found = store.through(files, "blob", lambda missing: scan_files(read(missing.select(F.col("key").alias("blob")))).withColumnRenamed("blob", "key"))
    return files.select("path", F.col("blob").alias("key")).join(found, "key").drop("key")


def findings(scans: DataFrame, sites: DataFrame, edges: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, symbol, line, reason): unreachable files, exports that nothing takes, dependencies that nothing imports.

    sites: (path, spec, names, namespace, star, to), `to` null where a specifier means no file.  Without an entry
    point among the files only the dependencies are judged."""
    files = scans.select("path")
    entries = written(M.entry_points(files, manifests.select("path"), Z.entry_values(manifests)), "entries")
    found = sites.where("to is not null")
    gone = written(G.unreachable(files, edges, entries.select(F.col("path").alias("node"))), "unreachable")
    exported = scans.select("path", F.posexplode("exports").alias("pos", "e")).select("path", "e.name", "e.line", "pos")
    demands = found.where("not namespace and not star").select("to", F.explode("names").alias("name"))
    consumed = entries.union(found.where("namespace").select("to")).distinct()
    used = G.used_names(exported, demands, found.where("star").select("path", "to"), consumed)
    unused = G.unreferenced(exported, used, gone)
    any_entry = entries.limit(1).select(F.lit(1).alias("_any"))
    unused = unused.join(any_entry, how="cross").select("path", F.col("name").alias("symbol"), "line", F.lit("unreferenced-export").alias("reason"))  # one row or none
    # without a manifest above it, a file's imports are of no package
    folders = manifests.select(F.regexp_extract("path", r"\A(?:([\s\S]*)/)?[^/]*\z", 1).alias("folder"), F.col("path").alias("manifest"))
    near = M.nearest_folder(files, folders)
    imports = sites.where("not star").select("path", "spec").join(near, "path").select("folder", "spec")
    listed = Z.dependencies(manifests).join(folders.withColumnRenamed("manifest", "path"), "path")
    idle = M.unused_dependencies(listed, imports).select("path", F.col("name").alias("symbol"), F.col("line").cast("int").alias("line"), F.lit("unused-dependency").alias("reason"))
    whole = gone.select("path", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("line"), F.lit("unreachable-file").alias("reason"))
    return whole.unionByName(unused.withColumn("line", F.col("line").cast("int"))).unionByName(idle)


def import_graph(scans: DataFrame, manifests: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, spec, names, namespace, star, to) of all import sites, the edges between files, and the manifests as plain JSON; see analyze()."""
    manifests = written(manifests.select("path", Z.strict_json(F.col("text")).alias("text")).where(F.get_json_object("text", "$").startswith("{")), "manifests")
    imported = scans.select("path", F.explode("imports").alias("i")).select("path", "i.spec", "i.names", "i.namespace", F.lit(False).alias("star"))
    starred = scans.select("path", F.explode("stars").alias("spec")).select("path", "spec", F.array().cast("array<string>").alias("names"), F.lit(False).alias("namespace"), F.lit(True).alias("star"))
    sites = written(imported.unionByName(starred), "sites")
    named = manifests.select(F.get_json_object("text", "$.name").alias("name"), F.regexp_extract("path", r"\A(?:([\s\S]*)/)?[^/]*\z", 1).alias("folder")).where("name <> ''")
    packages = named.groupBy("name").agg(F.min("folder").alias("folder"))
    scopes, aliases = M.alias_scopes(configs.select("path", Z.strict_json(F.col("text")).alias("text")))
    resolved = M.resolve(sites.select("path", "spec"), scans.select("path"), aliases, packages, scopes)
    sites = written(sites.join(resolved, ["path", "spec"], "left"), "resolved")
    edges = written(G.import_edges(sites.where("to is not null").select(F.col("path").alias("from"), "to")).withColumn("weight", F.lit(None).cast("long")), "edges")
    return sites, edges, manifests


def code_metrics(scans: DataFrame) -> DataFrame:
    """(path, loc, complexity, duplication) of scanned files."""
    return scans.select("path", "loc", "complexity").join(X.duplication(scans).select("path", "duplication"), "path")


def analyze(scans: DataFrame, manifests: DataFrame, configs: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, cycles, summary, dead_code and code_metrics of scanned files.

    scans: see scan_files(), with a `path`.  manifests and configs: (path, text) of the tracked package.json files and
    of configurations that can hold aliases."""
    scans = written(scans, "scans")
    sites, edges, manifests = import_graph(scans, manifests, configs)
    nodes = scans.select(F.col("path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("kind"), "loc")
    cycles = written(G.scc(edges), "cycles")
    return {
        "nodes": nodes, "edges": edges, "cycles": cycles, "summary": G.summary(nodes, edges, cycles),
        "dead_code": findings(scans, sites, edges, manifests), "code_metrics": code_metrics(scans),
    }
