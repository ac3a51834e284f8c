"""One analysis of a repository: options in, a report of lazy tables out."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import js
from .operators import commits as C
from .operators import gates
from .operators import graph as G
from .operators import history as H
from .operators import language as L
from .operators import scope as S
from .operators import series as E
from .operators import text as X
from .operators.registry import Plugin, Registry
from .operators.store import Counters, ResultStore, RunStore, run_key
from .session import ship
from .sources import git


@dataclass(frozen=True)
class Options:
    """rev and history: what is read; paths and ignore: globs; None for metrics or languages means all of them.

    store: a folder where scans of contents and whole results of plug-ins are kept from run to run."""

    root: str
    rev: str = "HEAD"
    history: int = 500
    paths: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    metrics: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    store: str | None = None
    convention: str | None = None
    coupling: H.CouplingLimits = field(default_factory=H.CouplingLimits)


@dataclass
class Report:
    """The tables of a run by name.  Without a store metrics and commit tables aren't computed before they are used; languages
    write tables of their own on the way, and with a store what plug-ins give is stored at once.

    run: branch, files, duration_ms and finished_at.  cache: whether there is a store, its path, and its counters in this run."""

    rev: str
    branch: str | None
    tables: dict[str, DataFrame]
    run: dict = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")

    def to_json(self, rows: int | None = None) -> str:
        """The report as one JSON object, as the driver holds it; rows: no more than so many of each table.  write() is for tables of any size."""
        head = {"rev": self.rev, "branch": self.branch, "run": self.run, "cache": self.cache}
        return json.dumps(head | {name: [json.loads(r) for r in (df if rows is None else df.limit(rows)).toJSON().collect()] for name, df in self.tables.items()})

    def differences(self, before: Report) -> DataFrame:
        """What changed since another report: see gates.differences()."""
        return gates.differences(before.tables, self.tables)

    def findings(self, before: Report, percent: float = 10.0) -> DataFrame:
        """What the gates say of this report after another one: see gates.findings()."""
        return gates.findings(before.tables, self.tables, percent)

    def to_text(self, rows: int = 15) -> str:
        """The first rows of each table as a terminal shows them."""
        parts = [f"{self.branch or 'detached'} @ {self.rev[:8]}"]
        for name, df in self.tables.items():
            parts.append(f"\n{name}\n" + "\n".join("  " + "  ".join(str(x) for x in r) for r in df.limit(rows).collect()))
        return "\n".join(parts)


def _hotspots(tables: dict[str, DataFrame], options: Options) -> DataFrame:
    # paths are joined before contents are read: only changed files are
    changed = H.churn(tables["touches"].select(js.trim(F.col("path")).alias("path")))
    read = git.contents(tables["files"].join(changed, "path"), options.root)
    scored = read.select("path", "changes", X.indent_complexity(F.col("content")).alias("complexity"))
    return scored.withColumn("score", F.col("changes") * F.col("complexity")).orderBy(F.desc("score"), "path")


def _coupling(tables: dict[str, DataFrame], options: Options) -> DataFrame:
    return H.top_coupling(tables["touches"], options.coupling, tables["files"])


def _typescript(tables: dict[str, DataFrame], options: Options) -> dict[str, DataFrame]:
    """The tables of language.analyze() for the files in scope; manifests and configurations are those tracked."""
    tracked, read = tables["tracked"], lambda df, to: git.contents(df, options.root, to)
    store = ResultStore(tracked.sparkSession, f"{options.store}/scans", "typescript", L.VERSION, tables.get("counters")) if options.store else None
    scans = L.scans_of(tables["files"].select("path", "blob"), lambda df: read(df, "content"), store)
    text = lambda keep: read(tracked.where(keep).select("path", "blob"), "text").select("path", "text")
    return L.analyze(scans, text(S.is_manifest(F.col("path"))), text(S.is_config(F.col("path"))))


def builtin() -> Registry:
    """The plug-ins that come with the package."""
    r = Registry()
    r.add(Plugin("conventional", "commit-convention", "1", C.parse_commits))
    r.add(Plugin("hotspots", "git-metric", "1", _hotspots, series=E.of_hotspots))
    r.add(Plugin("coupling", "git-metric", "1", _coupling, series=E.of_coupling))
    r.add(Plugin("typescript", "language", L.VERSION, _typescript, extensions=L.EXTENSIONS))
    return r


def analyze(spark: SparkSession, options: Options, registry: Registry | None = None) -> Report:
    """A report on a repository.  Unknown names of plug-ins are errors before anything is read.

    Every metric's own table is there under its id, and all that have a series form together as `metrics`.  Each language that has files gives `<id>.dead_code`, `<id>.code_metrics` and so on; the graphs of all are
    merged into nodes, edges, cycles and summary.  With a store, a plug-in whose run has the same files and options as a stored one isn't started."""
    began = time.perf_counter()
    registry = registry or builtin()
    metrics = S.allowed([p.id for p in registry.of_kind("git-metric")], list(options.metrics) if options.metrics is not None else None)
    languages = S.allowed([p.id for p in registry.of_kind("language")], list(options.languages) if options.languages is not None else None)
    convention = S.convention([p.id for p in registry.of_kind("commit-convention")], options.convention)
    ship(spark)
    rev = git.resolve_rev(options.root, options.rev)
    tracked = git.tracked(spark, options.root, rev)
    files = git.ls_tree(spark, options.root, rev).where(S.in_scope(F.col("path"), options.paths, options.ignore))
    commits = git.log(spark, options.root, rev, options.history)
    counters = Counters()
    runs = RunStore(spark, f"{options.store}/runs", counters) if options.store else None
    tables = {"files": files, "tracked": tracked, "touches": git.touches(spark, options.root, rev, options.history), "counters": counters}

    def stored(plugin: Plugin, depends: tuple, compute) -> dict[str, DataFrame]:
        return compute() if runs is None else runs.through(plugin.id, plugin.version, run_key(plugin.kind, *depends), compute)

    digest = lambda df: X.files_digest(df.select("path", "blob")).first()["digest"]
    out = {}
    if metrics:
        # the same revision of a shallow clone has another history
        depends = (options.root, rev, options.history, repr(options.coupling), commits.count(), digest(files)) if runs else ()
        for m in metrics:
            out[m] = stored(registry.plugins[m], depends, lambda m=m: {"series": registry.plugins[m].run(tables, options)})["series"]
    points = [p.series(out[m]) if (p := registry.plugins[m]).series else out[m] for m in metrics]
    points = [df for df in points if E.has_form(df)]
    if points:
        out["metrics"] = E.united(points)
    graphs = []
    context = None
    for name in languages:
        plugin = registry.plugins[name]
        own = files.where(S.has_extension(F.col("path"), plugin.extensions))
        if own.isEmpty():  # a language without files is no part of the run
            continue
        if runs and context is None:  # manifests and configurations are read wherever they are
            context = digest(tracked.where(S.is_manifest(F.col("path")) | S.is_config(F.col("path"))))
        made = stored(plugin, (digest(own), context) if runs else (), lambda plugin=plugin, own=own: _with_summary(plugin.run(tables | {"files": own}, options)))
        made = _with_summary(made)
        out |= {f"{name}.{k}": df for k, df in made.items()}
        graphs.append([made[k].withColumn("seq", F.lit(len(graphs))) for k in ("nodes", "edges", "cycles")])
    if graphs:
        every = graphs[0]
        for other in graphs[1:]:
            every = [a.unionByName(b) for a, b in zip(every, other, strict=True)]
        out |= G.cross_language(*every)
    if convention:
        parsed = registry.plugins[convention].run(commits)
        out |= {"commit_totals": C.totals(parsed, commits), "types": C.buckets(parsed, "type"), "scopes": C.buckets(parsed, "scope"), "weeks": C.weekly(commits)}
    branch = git.branch_at(options.root, options.rev)
    cache = {"enabled": runs is not None, **({"path": options.store} if runs else {}), **asdict(counters)}
    run = {"branch": branch, "files": files.count(), "duration_ms": round(1000 * (time.perf_counter() - began)), "finished_at": datetime.now(UTC).isoformat()}
    return Report(rev, branch, out, run, cache)


def _with_summary(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return made if "summary" in made else made | {"summary": G.summary(made["nodes"], made["edges"], made["cycles"])}
