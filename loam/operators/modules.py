"""Import resolution and dependency findings, as equi-joins.

Prefix and first-match lookups are turned into equi-joins: the few prefixes or candidates of a row are
exploded with their rank, joined by value, and the best rank is kept by min_by or max_by, which Spark
pre-aggregates.  No nested loops over startswith.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js
from ..session import written

# The extensions that an import may leave out, in order, and the sources of built ones.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
SOURCE_OF = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
BUILD_FOLDERS = ("dist", "build", "lib", "out")
# Modules of the runtime itself.
BUILT_IN = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel",
    "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process",
    "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url",
    "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def package_name(spec: Column) -> Column:
    """The package of a specifier; null for relative ones, `#` imports and the runtime's modules."""
    parts = F.split(spec, "/")
    name = F.when(spec.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    outside = (spec != "") & ~F.substring(spec, 1, 1).isin(".", "/", "#") & ~spec.startswith("node:")
    return F.when(outside & ~name.isin(*BUILT_IN), name)


def nearest_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder): the deepest of the folders that encloses a file; `` encloses all."""
    each = files.select("path", F.explode(F.concat(F.array(F.lit("")), js.ancestors(F.col("path")))).alias("folder"))
    return each.join(folders.select("folder"), "folder", "left_semi").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def longest_name(specs: DataFrame, packages: DataFrame) -> DataFrame:
    """(spec, name): the longest package name that is a specifier or its beginning up to a slash."""
    own = F.concat(js.ancestors(F.col("spec")), F.array("spec"))
    each = specs.select("spec").distinct().withColumn("name", F.explode(own))
    return each.join(packages.select("name"), "name", "left_semi").groupBy("spec").agg(F.max_by("name", F.length("name")).alias("name"))


def alias_target(specs: DataFrame, aliases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(spec, pattern, target, rank): targets of the best pattern, in order.

    aliases: (pattern, seq, targets), with at most one `*` in a pattern.  The longest beginning wins,
    then the smaller seq.  Patterns are a small table: a specifier meets them by its beginnings.
    by: further columns of both, such as a configuration's folder, that must be equal."""
    by = list(by)
    star = aliases.withColumns({"prefix": F.substring_index("pattern", "*", 1), "suffix": F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise(""), "wild": F.col("pattern").contains("*")})
    begins = F.transform(F.sequence(F.lit(0), F.length("spec")), lambda k: F.substring(F.col("spec"), F.lit(1), k))
    each = specs.select(*by, "spec").distinct().withColumn("prefix", F.explode(begins)).join(star, [*by, "prefix"])
    rest = F.substring(F.col("spec"), F.length("prefix") + 1, F.length("spec"))
    fits = F.when(F.col("wild"), rest.endswith(F.col("suffix")) & (F.length("spec") >= F.length("prefix") + F.length("suffix"))).otherwise(rest == "")
    best = each.where(fits).groupBy(*by, "spec").agg(F.min_by(F.struct("pattern", "targets", "prefix", "suffix"), F.struct(-F.length("prefix"), "seq")).alias("b"))
    middle = F.substring(F.col("spec"), F.length("b.prefix") + 1, F.length("spec") - F.length("b.prefix") - F.length("b.suffix"))
    first = F.substring_index("t", "*", 1)
    target = F.when(F.col("t").contains("*"), F.concat(first, F.col("_m"), F.substring(F.col("t"), F.length(first) + 2, F.length("t")))).otherwise(F.col("t"))
    return best.select(*by, "spec", "b.pattern", middle.alias("_m"), F.posexplode("b.targets").alias("rank", "t")).select(*by, "spec", "pattern", target.alias("target"), "rank")


def candidate_paths(path: Column) -> Column:
    """The files that an extensionless or built path may mean, best first."""
    plain = F.array(*[F.concat(path, F.lit(f".{e}")) for e in EXTENSIONS], *[F.concat(path, F.lit(f"/index.{e}")) for e in EXTENSIONS])
    ext = js.extension(path)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    known = F.array(path)
    for e, sources in SOURCE_OF.items():
        known = F.when(ext == e, F.array(path, *[F.concat(stem, F.lit(s)) for s in sources])).otherwise(known)
    return F.when(ext == "", plain).otherwise(known)


def first_match(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): of the candidates of (id, rank, base), the first that is a file."""
    each = bases.select("id", "rank", F.posexplode(candidate_paths(F.col("base"))).alias("pos", "path"))
    return each.join(files.select("path"), "path", "left_semi").groupBy("id").agg(F.min_by("path", F.struct("rank", "pos")).alias("path"))


def join_path(folder: Column, spec: Column) -> Column:
    """A relative specifier from a folder, with `.` and `..` taken out; null if it leaves the top."""
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: ~p.isin("", "."))
    out = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")),
        lambda s, p: F.when(p != "..", F.struct(F.array_append(s["p"], p).alias("p"), s["ok"].alias("ok"))).otherwise(
            F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), (s["ok"] & (F.size(s["p"]) > 0)).alias("ok"))
        ),
    )
    return F.when(out["ok"], F.array_join(out["p"], "/"))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """(path, spec, to) for imports (path, spec) that mean a file: relative ones, else aliases, else workspace packages.

    aliases: see alias_target(); with scopes (folder, base), the configurations' folders and base folders, aliases
    have a `folder` too, and those of the deepest folder that encloses a file hold for it, then its base.
    packages: (name, folder), a workspace package and its folder."""
    own = imports.select("path", "spec").distinct()
    inner = F.col("spec").startswith(".")
    relative = own.where(inner).withColumn("base", join_path(js.dir_name(F.col("path")), F.col("spec")))
    rows = lambda df, rank, base: df.select(F.struct("path", "spec").alias("id"), rank.alias("rank"), base.alias("base"))
    bases = [rows(relative.where("base is not null"), F.lit(0), F.col("base"))]
    outer, by = own.where(~inner), []
    if scopes is not None:
        by = ["folder"]
        outer = outer.join(nearest_folder(outer.select("path").distinct(), scopes), "path", "left")
        bases.append(rows(outer.join(scopes, "folder").where("base is not null"), F.lit(900), join_path(F.col("base"), F.col("spec"))))
    if aliases is not None:
        bases.append(rows(outer.join(alias_target(outer, aliases, by), [*by, "spec"]), F.col("rank") + 1, F.col("target")))
    if packages is not None:
        named = longest_name(outer, packages).join(packages.select("name", F.col("folder").alias("_home")), "name")
        rest = F.regexp_replace(F.substring(F.col("spec"), F.length("name") + 1, F.length("spec")), "^/", "")
        stem, home = F.when(rest == "", "index").otherwise(rest), F.nullif("_home", F.lit(""))
        tried = F.array(F.concat_ws("/", home, F.lit("src"), stem), F.concat_ws("/", home, stem), F.concat_ws("/", home, F.lit("src"), F.nullif(rest, F.lit("")), F.lit("index")))
        each = outer.select("path", "spec").join(named.select("spec", F.posexplode(tried).alias("_k", "_base")), "spec")
        bases.append(rows(each, F.col("_k") + 1000, F.col("_base")))
    every = bases[0]
    for b in bases[1:]:
        every = every.unionByName(b)
    return first_match(every.where("base is not null"), files).select("id.path", "id.spec", F.col("path").alias("to"))


def entry_candidates(values: DataFrame) -> DataFrame:
    """(id, rank, base) of manifest values (id, folder, value): as written, then with the first build folder in it as `src`."""
    clean = F.regexp_replace(F.col("value"), r"\A\./", "")
    folder = rf"\A(|[\s\S]*?/)(?:{'|'.join(BUILD_FOLDERS)})/([\s\S]*)\z"
    source = F.when(clean.rlike(folder), F.regexp_replace(clean, folder, "$1src/$2"))
    tried = F.filter(F.array(clean, source), lambda c: c.isNotNull() & ~c.startswith(".."))
    each = values.select("id", "folder", F.posexplode(tried).alias("rank", "v"))
    return each.select("id", "rank", join_path(F.col("folder"), F.regexp_replace("v", r"\.d\.ts\z", "")).alias("base")).where("base is not null")


def entry_points(files: DataFrame, manifests: DataFrame, values: DataFrame) -> DataFrame:
    """(path): test files, tool configurations, and what manifests publish.

    manifests: (path) of package.json files; values: (path, value), what one of them names.  A manifest of which
    no value is a file has the first of `src/index` and `index` beside it."""
    from .scope import TEST_FILE, TOOL_CONFIG

    folder = js.dir_name(F.col("path"))
    found = first_match(entry_candidates(values.select(F.struct("path", "value").alias("id"), folder.alias("folder"), "value")), files).select(F.col("id.path").alias("manifest"), "path")
    silent = manifests.join(found.select(F.col("manifest").alias("path")), "path", "left_anti")
    usual = silent.select(F.struct("path").alias("id"), folder.alias("folder"), F.posexplode(F.array(F.lit("src/index"), F.lit("index"))).alias("rank", "v"))
    first = first_match(usual.select("id", "rank", F.concat_ws("/", F.nullif("folder", F.lit("")), "v").alias("base")), files)
    by_name = files.select("path").where(F.col("path").rlike(TEST_FILE) | F.col("path").rlike(TOOL_CONFIG))
    return by_name.union(found.select("path")).union(first.select("path")).distinct()


def alias_scopes(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folder, base) and (folder, pattern, seq, targets) from configurations (path, text) in plain JSON, with what they extend.

    Only tsconfig.json and jsconfig.json rule a folder; the others can be extended.  A configuration's own
    options go before inherited ones, later `extends` before earlier ones, and what is reached on two
    ways counts on the first.  Each option is read from the folder of the configuration that has it."""
    option = lambda x: F.get_json_object("text", f"$.compilerOptions.{x}")
    listed = F.get_json_object("text", "$.extends")
    refs = F.when(listed.startswith("["), F.from_json(listed, "array<string>")).when(listed.isNotNull(), F.array(listed)).otherwise(F.array().cast("array<string>"))
    home = js.dir_name(F.col("path"))
    own = written(configs.select("path", home.alias("home"), option("baseUrl").alias("base_url"), option("paths").alias("paths"), refs.alias("refs")), "configs")
    ref = own.select("path", "home", F.posexplode("refs").alias("k", "ref")).where(F.col("ref").startswith(".")).withColumn("b", join_path(F.col("home"), F.col("ref")))
    tried = F.when(F.col("ref").endswith(".json"), F.array("b")).otherwise(F.array(F.concat("b", F.lit(".json")), F.concat_ws("/", F.nullif("b", F.lit("")), F.lit("tsconfig.json"))))
    parent = ref.where("b is not null").select("path", "k", F.posexplode(tried).alias("n", "parent")).join(own.select(F.col("path").alias("parent")), "parent", "left_semi")
    parent = written(parent.groupBy("path", "k").agg(F.min_by("parent", "n").alias("parent")), "extends")
    rules = own.where(F.col("path").rlike(r"(^|/)(ts|js)config\.json\z"))
    ways = written(rules.select(F.col("path").alias("root"), F.col("path").alias("at"), F.array().cast("array<int>").alias("way"), F.array("path").alias("seen")), "ways")
    every = ways
    while not ways.isEmpty():  # as many rounds as the longest chain of configurations; a way never comes back to its own
        step = ways.join(parent.withColumnRenamed("path", "at"), "at").where(~F.array_contains("seen", F.col("parent")))
        ways = written(step.select("root", F.col("parent").alias("at"), F.array_append("way", F.col("k")).alias("way"), F.array_append("seen", F.col("parent")).alias("seen")), "ways")
        every = every.union(ways)
    reached = every.groupBy("root", "at").agg(F.min("way").alias("way")).join(own.withColumnRenamed("path", "at"), "at")
    order = F.transform("way", lambda k: -k)
    has = lambda c: F.min_by(F.struct("home", c), F.when(F.col(c).isNotNull(), order))
    best = reached.groupBy("root").agg(has("base_url").alias("b"), has("paths").alias("p"))
    folder = js.dir_name(F.col("root"))
    base = F.when(F.col("b.base_url") != "", join_path(F.col("b.home"), F.col("b.base_url")))
    each = best.select(folder.alias("folder"), base.alias("base"), F.coalesce(base, "p.home", folder).alias("from"), F.from_json("p.paths", "map<string,array<string>>").alias("paths"))
    each = written(each.where("base is not null or size(paths) > 0"), "scopes")
    patterns = each.select("folder", "from", F.posexplode("paths").alias("seq", "pattern", "t"))
    targets = F.transform("t", lambda t: join_path(F.col("from"), t))
    return each.select("folder", "base"), patterns.select("folder", "pattern", "seq", targets.alias("targets"))


def unused_dependencies(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """Dependencies (folder, name, line) that no file below their manifest imports; type packages aside.

    imports: (folder, spec), by nearest manifest."""
    used = imports.select("folder", package_name(F.col("spec")).alias("name")).where("name is not null").distinct()
    return dependencies.where(~F.col("name").startswith("@types/")).join(used, ["folder", "name"], "left_anti")


def entries(files: DataFrame, published: DataFrame) -> DataFrame:
    """(path): test files, tool configurations and published files; if nothing is published, the first of src/index and index."""
    from .scope import TEST_FILE, TOOL_CONFIG

    own = files.select("path").where(F.col("path").rlike(TEST_FILE) | F.col("path").rlike(TOOL_CONFIG))
    fallback = files.select("path", F.regexp_extract("path", rf"\A(src/index|index)\.(?:{'|'.join(EXTENSIONS)})\z", 1).alias("k")).where("k <> ''")
    first = fallback.withColumn("r", F.row_number().over(Window.orderBy(F.col("k") != "src/index", "path"))).where("r = 1").select("path")  # a handful of names
    none = published.limit(1).agg(F.count("*").alias("n")).where("n = 0").drop("n")
    return own.union(published.select("path")).union(first.join(none, how="cross")).distinct()
