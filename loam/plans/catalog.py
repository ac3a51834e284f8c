"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js
from ..operators import commits as C
from ..operators import graph as G
from ..operators import history as H
from ..operators import modules as M
from ..operators import scope as S
from ..operators import text as X
from ..operators import views as V
from ..session import table, written
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
#: Line items make weak pairs: a degree at which some are left.
LIMITS = H.CouplingLimits(min_degree=5)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# -- history

_CF = "cf AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem), small AS (SELECT cf.* FROM cf JOIN (SELECT sha FROM cf GROUP BY sha HAVING count(*) <= 30) USING (sha))"
_SHARED = f"{_CF}, ch AS (SELECT path, count(*) AS changes FROM small GROUP BY path), sh AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS shared_changes FROM small a JOIN small b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2)"
_DEGREE = "floor(200.0 * shared_changes / (a.changes + b.changes) * 10 + 0.5) / 10"
_COUPLED = f"{_SHARED}, cp AS (SELECT file_a, file_b, shared_changes, a.changes AS changes_a, b.changes AS changes_b, CAST({_DEGREE} AS DOUBLE) AS degree FROM sh JOIN ch a ON a.path = file_a JOIN ch b ON b.path = file_b WHERE shared_changes >= 2 AND a.changes >= 3 AND b.changes >= 3)"


@query("SELECT l_partkey AS path, count(*) AS changes FROM lineitem GROUP BY 1")
def agg_churn(spark, sf):
    return H.churn(T.commit_files(spark, sf))


@query("SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem")
def set_distinct_paths(spark, sf):
    return T.commit_files(spark, sf).distinct()


@query(f"WITH {_CF} SELECT sha, count(*) AS n_files FROM small GROUP BY sha")
def flt_commit_size(spark, sf):
    return H.small_commits(T.commit_files(spark, sf), LIMITS.max_files).select("sha", F.size("paths").cast("long").alias("n_files"))


@query(f"WITH {_SHARED} SELECT * FROM ch")
def agg_changes(spark, sf):
    return H.changes(H.small_commits(T.commit_files(spark, sf), LIMITS.max_files))


@query(f"WITH {_SHARED} SELECT * FROM sh WHERE shared_changes >= 2")
def agg_shared(spark, sf):
    return H.shared(H.small_commits(T.commit_files(spark, sf), LIMITS.max_files), 2)


@query(f"WITH {_CF} SELECT a.path AS file_a, b.path AS file_b, count(*) AS commits FROM small a JOIN small b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2")
def join_coupling_self(spark, sf):
    return H.pairs(H.small_commits(T.commit_files(spark, sf), LIMITS.max_files)).groupBy("file_a", "file_b").agg(F.count("*").alias("commits"))


@query(f"WITH {_SHARED} SELECT sh.*, a.changes AS changes_a, b.changes AS changes_b FROM sh JOIN ch a ON a.path = file_a JOIN ch b ON b.path = file_b WHERE shared_changes >= 2")
def join_coupling_counts(spark, sf):
    small = H.small_commits(T.commit_files(spark, sf), LIMITS.max_files)
    return H.with_counts(H.shared(small, 2), H.changes(small)).select("file_a", "file_b", "shared_changes", "changes_a", "changes_b")


@query(f"WITH {_COUPLED} SELECT * FROM cp WHERE degree >= 5")
def agg_coupling(spark, sf):
    return H.coupling(T.commit_files(spark, sf), LIMITS)


@query(f"WITH {_COUPLED} SELECT * FROM cp WHERE degree >= 5")
def agg_coupling_incremental(spark, sf):
    """As agg_coupling, from a history that came in three batches by date, folded after the second."""
    from ..session import shared_dir
    from ..streaming.history import HistoryTables

    dated = T.commit_files(spark, sf).join(T.commits(spark, sf).select("sha", "ts"), "sha")
    tables = HistoryTables(spark, f"{shared_dir(spark)}/loam-history-{uuid.uuid4().hex}", LIMITS, fold_every=2)
    for batch, when in enumerate(("ts < '1994-06-01'", "ts >= '1994-06-01' AND ts < '1996-10-01'", "ts >= '1996-10-01'")):
        tables.update(dated.where(when), batch)
    return tables.coupling()


@query(f"WITH {_COUPLED} SELECT * FROM cp WHERE degree >= 10")
def flt_thresholds(spark, sf):
    return H.coupling(T.commit_files(spark, sf), H.CouplingLimits(min_degree=10))


@query(f"WITH {_COUPLED} SELECT * FROM cp WHERE degree >= 5 AND file_a IN (SELECT p_partkey FROM part WHERE p_size > 25) AND file_b IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def semi_present(spark, sf):
    files = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("path"))
    return H.coupling(T.commit_files(spark, sf), LIMITS, files)


@query(f"WITH {_COUPLED} SELECT * FROM cp WHERE degree >= 5 ORDER BY degree DESC, shared_changes DESC, file_a, file_b LIMIT 500")
def topk_coupling(spark, sf):
    return H.top_coupling(T.commit_files(spark, sf), LIMITS)


# -- text metrics

_FILES = "f AS (SELECT doc_id AS seq, source || '/' || lang || '/' || doc_id || '.ts' AS path, sha1(text) AS blob, text AS content FROM documents)"
_PADDED = "p AS (SELECT doc_id AS path, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, n_chars FROM documents) x, LATERAL (SELECT repeat(' ', CAST(n_chars % 9 AS INT)) || t AS l) y)"


def _padded(spark, sf):
    """Documents have no indented lines: a number of blanks is put before each."""
    docs = table(spark, sf, "documents")
    pad = F.repeat(F.lit(" "), (F.col("n_chars") % 9).cast("int"))
    return docs.select(F.col("doc_id").alias("path"), F.array_join(F.transform(js.lines(F.col("text")), lambda s: F.concat(pad, s)), "\n").alias("content"))


_INDENT = f"{_PADDED}, ic AS (SELECT path, CAST(sum(CASE WHEN length(ltrim(line)) > 0 THEN 1 + (length(line) - length(ltrim(line))) // 2 ELSE 0 END) AS BIGINT) AS complexity FROM p GROUP BY path)"


@query(f"WITH {_INDENT} SELECT * FROM ic")
def prj_indent_complexity(spark, sf):
    return _padded(spark, sf).select("path", X.indent_complexity(F.col("content")).alias("complexity"))


@query(f"WITH {_FILES} SELECT path, len(string_split(content, chr(10))) AS loc FROM f")
def prj_loc(spark, sf):
    return T.files(spark, sf).select("path", X.loc(F.col("content")).cast("long").alias("loc"))


_LINES = f"{_FILES}, l AS (SELECT path, k, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS k, unnest(string_split(content, chr(10))) AS line FROM f)), sig AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) AS i, line FROM l WHERE length(line) > 3)"
_PRINTS = f"{_LINES}, w AS (SELECT path, i, count(*) OVER fr AS n, string_agg(line, chr(10)) OVER fr AS joined FROM sig WINDOW fr AS (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), pr AS (SELECT path, i, substr(sha1(joined), 1, 16) AS print FROM w WHERE n = 6)"


@query(f"WITH {_LINES} SELECT path, count(*) AS n_lines FROM sig GROUP BY path")
def flt_significant_line(spark, sf):
    return T.files(spark, sf).select("path", F.size(X.significant_lines(F.col("content"))).cast("long").alias("n_lines")).where("n_lines > 0")


@query(f"WITH {_PRINTS} SELECT path, i - 1 AS at, print FROM pr")
def prj_fingerprint(spark, sf):
    return X.fingerprints(T.files(spark, sf)).select("path", F.posexplode("prints").alias("at", "print")).withColumn("at", F.col("at").cast("long"))


@query(f"WITH {_PRINTS} SELECT path, count(*) AS windows FROM pr GROUP BY path")
def win_clone_frame(spark, sf):
    return X.fingerprints(T.files(spark, sf)).select("path", F.size("prints").cast("long").alias("windows")).where("windows > 0")


@query(f"""WITH {_PRINTS}, again AS (SELECT print FROM pr GROUP BY print HAVING count(*) > 1), hit AS (SELECT path, i FROM pr WHERE print IN (SELECT print FROM again)),
m AS (SELECT path, count(DISTINCT i + o) AS n FROM hit, range(6) r(o) GROUP BY path), t AS (SELECT f.path, count(sig.i) AS lines FROM f LEFT JOIN sig ON sig.path = f.path GROUP BY f.path)
SELECT t.path, coalesce(m.n, 0) AS duplicated_lines, lines AS fp_lines, CAST(CASE WHEN lines > 0 THEN floor(coalesce(m.n, 0) / lines * 1000 + 0.5) / 1000 ELSE 0 END AS DOUBLE) AS duplication FROM t LEFT JOIN m ON m.path = t.path""")
def agg_duplication(spark, sf):
    d = X.duplication(X.fingerprints(T.files(spark, sf)))
    return d.select("path", F.col("duplicated_lines").cast("long").alias("duplicated_lines"), F.col("fp_lines").cast("long").alias("fp_lines"), "duplication")


@query(f"""WITH {_FILES}, b AS (SELECT substr(sha256(path), 1, 3) AS b, sha256(string_agg(path || chr(0) || blob || chr(10), '' ORDER BY path || chr(0) || blob || chr(10))) AS d FROM f GROUP BY 1)
SELECT sha256(string_agg(b || d, '' ORDER BY b)) AS digest FROM b""")
def agg_files_digest(spark, sf):
    return X.files_digest(T.files(spark, sf))


_HOT = f"{_INDENT}, cn AS (SELECT l_partkey AS path, count(*) AS changes FROM lineitem GROUP BY 1), h AS (SELECT ic.path, changes, complexity, changes * complexity AS score FROM ic JOIN cn ON cn.path = ic.path)"


def _hotspots(spark, sf):
    complexity = _padded(spark, sf).select("path", X.indent_complexity(F.col("content")).alias("complexity"))
    return H.hotspots(complexity, H.churn(T.commit_files(spark, sf)))


@query(f"WITH {_HOT} SELECT * FROM h")
def join_hotspots(spark, sf):
    return _hotspots(spark, sf)


@query(f"WITH {_HOT} SELECT * FROM h ORDER BY score DESC, path LIMIT 48")
def topk_hotspots(spark, sf):
    return _hotspots(spark, sf).orderBy(F.desc("score"), "path").limit(48)


@query(f"WITH {_HOT} SELECT path, score FROM h", name="agg_hotspots")
def agg_hotspots(spark, sf):
    return _hotspots(spark, sf).select("path", "score")


@query(f"WITH {_HOT} SELECT * FROM h WHERE score > 0")
def flt_positive_score(spark, sf):
    return _hotspots(spark, sf).where("score > 0")


@query(f"WITH {_HOT} SELECT h.*, d.loc FROM h LEFT JOIN (SELECT doc_id AS path, len(string_split(text, chr(10))) AS loc FROM documents) d ON d.path = h.path WHERE score > 0")
def join_hotspot_loc(spark, sf):
    docs = table(spark, sf, "documents")
    metrics = docs.select(F.col("doc_id").alias("path"), F.col("doc_id").alias("seq"), X.loc(F.col("text")).cast("long").alias("loc"))
    return H.with_loc(_hotspots(spark, sf), metrics)


_SCALE = f"{_HOT}, q AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q, min(score) AS lo, max(score) AS hi FROM h), s AS (SELECT CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, round(q[1], 6) AS q20, round(q[2], 6) AS q40, round(q[3], 6) AS q60, round(q[4], 6) AS q80 FROM q)"


def _scale(spark, sf):
    s = V.heat_scale(_hotspots(spark, sf), "score")
    return s.select("low", "high", *(F.round(c, 6).alias(c) for c in ("q20", "q40", "q60", "q80")))


@query(f"WITH {_SCALE} SELECT * FROM s")
def agg_heat_scale(spark, sf):
    return _scale(spark, sf)


@query(f"WITH {_SCALE} SELECT h.*, CASE WHEN score <= q20 THEN 1 WHEN score <= q40 THEN 2 WHEN score <= q60 THEN 3 WHEN score <= q80 THEN 4 ELSE 5 END AS level FROM h, s")
def win_heat_level(spark, sf):
    return V.heat_levels(_hotspots(spark, sf), "score", _scale(spark, sf))


@query(f"WITH {_SCALE} SELECT 1 AS level, low, q20 AS high FROM s UNION ALL SELECT 2, q20, q40 FROM s UNION ALL SELECT 3, q40, q60 FROM s UNION ALL SELECT 4, q60, q80 FROM s UNION ALL SELECT 5, q80, high FROM s")
def win_heat_bands(spark, sf):
    return V.heat_bands(_scale(spark, sf))


@query(f"WITH {_HOT} SELECT path, score, CASE WHEN m > 0 THEN CAST(score AS DOUBLE) / m ELSE 0 END AS ratio FROM (SELECT path, score, max(score) OVER () AS m FROM h) ORDER BY score DESC, path LIMIT 8")
def win_ratio_to_max(spark, sf):
    return V.ratio_to_max(_hotspots(spark, sf).select("path", "score"), "score", 8, "path")


# -- commits

_MSG = f"c AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, {T.MESSAGE} AS message FROM orders)"
_HDR = r"^(\w+)(?:\(([^)]+)\))?(!)?:\s([^\n\r]+)$"
_PARSED = f"""{_MSG}, hd AS (SELECT *, split_part(message, chr(10), 1) AS first FROM c),
pc AS (SELECT sha, author, ts, message, nullif(regexp_extract(first, '{_HDR}', 1), '') AS type, nullif(regexp_extract(first, '{_HDR}', 2), '') AS scope,
 CASE WHEN regexp_matches(first, '{_HDR}') THEN regexp_extract(first, '{_HDR}', 3) = '!' OR contains(message, 'BREAKING CHANGE:') ELSE false END AS breaking,
 CASE WHEN regexp_matches(first, '{_HDR}') THEN regexp_extract(first, '{_HDR}', 4) ELSE first END AS subject, regexp_matches(first, '{_HDR}') AS valid FROM hd)"""


def _parsed(spark, sf):
    return C.parse_commits(T.commits(spark, sf))


@query(f"WITH {_PARSED} SELECT sha, type, scope, breaking, subject, valid FROM pc")
def prj_parse_commit(spark, sf):
    return _parsed(spark, sf).select("sha", "type", "scope", "breaking", "subject", "valid")


@query(f"WITH {_PARSED} SELECT sha, type, scope, CASE WHEN valid THEN subject END AS subject FROM pc")
def prj_header(spark, sf):
    fields = C.header_fields(F.col("message"))
    return T.commits(spark, sf).select("sha", *(fields[k].alias(k) for k in ("type", "scope", "subject")))


@query(f"WITH {_MSG} SELECT sha, array_to_string(regexp_extract_all(message, '#(\\d+)', 1), ',') AS issues, CASE WHEN contains(message, 'Co-authored-by:') THEN 'dev ' || author END AS coauthors FROM c")
def prj_tags(spark, sf):
    t = T.commits(spark, sf).select("sha", C.tags(F.col("message")).alias("t"))
    return t.select("sha", F.coalesce(F.array_join(F.col("t")["issues"], ","), F.lit("")).alias("issues"), F.array_join(F.col("t")["coauthors"], ",").alias("coauthors"))


@query(f"WITH {_PARSED} SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid) / count(*) AS valid_rate, count(*) FILTER (breaking) AS breaking FROM pc")
def agg_commit_totals(spark, sf):
    return C.totals(_parsed(spark, sf))


def _bucket_sql(field: str) -> str:
    return f"""WITH {_PARSED}, g AS (SELECT {field} AS name, count(*) AS count, count(*) FILTER (breaking) AS breaking FROM pc GROUP BY 1)
SELECT name, count, count / sum(count) OVER () AS share, breaking, CAST(row_number() OVER (ORDER BY count DESC, name IS NULL, name) AS INTEGER) AS position FROM g"""


@query(_bucket_sql("type"))
def agg_type_buckets(spark, sf):
    return C.buckets(_parsed(spark, sf), "type")


@query(_bucket_sql("scope"))
def agg_scope_buckets(spark, sf):
    return C.buckets(_parsed(spark, sf), "scope")


@query(_bucket_sql("coalesce(type, 'other')"))
def agg_type_rows_web(spark, sf):
    return C.type_rows(_parsed(spark, sf))


@query(_bucket_sql("scope").replace("name, count, count / sum(count) OVER () AS share, breaking, CAST", "name, CAST"), name="sort_buckets")
def sort_buckets(spark, sf):
    return C.buckets(_parsed(spark, sf), "scope").select("name", "position")


_FIRST_WORD = r"regexp_extract(text, '[^\x20\x09-\x0D]+')"


@query(f"""SELECT name, count, share, breaking, CAST(row_number() OVER (ORDER BY count DESC, name IS NULL, icu_sort_key(name, 'root'), name) AS INTEGER) AS position
FROM (SELECT nullif({_FIRST_WORD}, '') AS name, count(*) AS count, count(*) / sum(count(*)) OVER () AS share, count(*) FILTER (lang = 'en') AS breaking FROM documents GROUP BY 1) g""")
def sort_buckets_locale(spark, sf):
    """Buckets whose names, the texts' first words, differ in case and accents."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    return C.buckets(table(spark, sf, "documents").select(F.nullif(word, F.lit("")).alias("scope"), (F.col("lang") == "en").alias("breaking")), "scope")


@query(f"""SELECT w AS component, 2 AS size, CAST(row_number() OVER (ORDER BY icu_sort_key(w, 'root'), w) AS INTEGER) AS position FROM (SELECT DISTINCT {_FIRST_WORD} AS w FROM documents WHERE {_FIRST_WORD} <> '') x""")
def sort_cycles_locale(spark, sf):
    """Cycles of two nodes, named by the texts' first words."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    there = table(spark, sf, "documents").select(word.alias("from")).where("`from` <> ''").distinct().withColumn("to", F.concat("from", F.lit(" >")))
    return G.cycle_sizes(G.scc(there.union(there.select("to", "from"))))


@query(f"WITH {_PARSED}, g AS (SELECT type AS name, count(*) AS n FROM pc GROUP BY 1) SELECT name, n / sum(n) OVER () AS share FROM g")
def win_share_of_total(spark, sf):
    return C.buckets(_parsed(spark, sf), "type").select("name", "share")


_WEEKS = "w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders WHERE {0} GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w)"


@query(f"WITH {_WEEKS.format('o_orderkey IS NOT NULL')} SELECT CAST(s.week AS VARCHAR) AS week, coalesce(w.n, 0) AS commits FROM s LEFT JOIN w ON w.week = s.week")
def agg_weekly(spark, sf):
    return C.weekly(T.commits(spark, sf)).withColumn("week", F.col("week").cast("string"))


@query(f"WITH {_WEEKS.format('true')} SELECT CAST(s.week AS VARCHAR) AS week, coalesce(w.n, 0) AS commits FROM s LEFT JOIN w ON w.week = s.week", name="agg_weekly_all")
def agg_weekly_all(spark, sf):
    return C.weekly(T.commits(spark, sf)).withColumn("week", F.col("week").cast("string"))


@query("SELECT o_orderkey AS sha FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def limit_history(spark, sf):
    return C.limit_history(T.commits(spark, sf), 500).select("sha")


@query("SELECT o_orderkey AS sha, o_orderdate AS ts FROM orders WHERE o_orderkey % 5 > 0")
def flt_valid_date(spark, sf):
    date = F.when(F.col("sha") % 5 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return C.valid_dates(T.commits(spark, sf).select("sha", date.alias("date")), "date").select("sha", "ts")


@query(f"WITH {_PARSED}, b AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM pc WHERE breaking GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM b) SELECT CAST(s.week AS VARCHAR) AS week, coalesce(n, 0) AS breaking FROM s LEFT JOIN b ON b.week = s.week")
def ext_breaking_timeline(spark, sf):
    return C.breaking_timeline(_parsed(spark, sf)).withColumn("week", F.col("week").cast("string"))


_TOUCH = "t AS (SELECT l_partkey AS path, o_custkey % 50 AS author, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _touches(spark, sf):
    commits = T.commits(spark, sf).select("sha", (F.col("author") % 50).alias("author"), "ts")
    return T.commit_files(spark, sf).join(commits, "sha")


@query(f"WITH {_TOUCH}, e AS (SELECT path, author, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS k, sum(n) OVER (PARTITION BY path) AS total, count(*) OVER (PARTITION BY path) AS authors FROM e) SELECT path, author AS owner, n AS owner_commits, CAST(total AS BIGINT) AS commits, authors, n / total AS share FROM r WHERE k = 1")
def ext_ownership(spark, sf):
    return C.ownership(_touches(spark, sf))


@query(f"WITH {_TOUCH}, e AS (SELECT path, author, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT path, row_number() OVER w AS k, sum(n) OVER (PARTITION BY path ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY path) AS total FROM e WINDOW w AS (PARTITION BY path ORDER BY n DESC, author)) SELECT path, CAST(min(k) AS INTEGER) AS bus_factor FROM r WHERE run >= total * 0.5 GROUP BY path")
def ext_bus_factor(spark, sf):
    return C.bus_factor(_touches(spark, sf))


@query(f"WITH {_TOUCH} SELECT path, max(ts) AS last_change, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2002-01-01') AS INTEGER) AS age_days FROM t GROUP BY path")
def ext_code_age(spark, sf):
    return C.code_age(_touches(spark, sf), F.lit("2002-01-01").cast("date"))


# -- graphs

_EDGES = "pl AS (SELECT event_id, user_id * 50 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 50 AS place FROM events), e AS (SELECT DISTINCT x.place AS a, y.place AS b FROM pl x JOIN pl y ON y.event_id = x.event_id + 1 WHERE x.place <> y.place), n AS (SELECT DISTINCT c_custkey AS id FROM customer)"
_CYCLES = f"{_EDGES}, tc AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a), sc AS (SELECT x.a AS node, min(x.b) AS component FROM tc x JOIN tc y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1)"


def _edges(spark, sf):
    """The edges, written once: several steps of a query read them."""
    return written(T.edges(spark, sf), "edges")


def _nodes(spark, sf):
    """Customers are nodes; other places are only ends of edges."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).distinct()


def _cycles(spark, sf, edges=None):
    """The components, written once, of edges that were made before or are made here."""
    return written(G.scc(T.edges(spark, sf) if edges is None else edges), "cycles")


@query(f'WITH {_EDGES} SELECT a AS "from", b AS "to", \'import\' AS kind FROM e')
def graph_edges(spark, sf):
    return G.import_edges(T.edges(spark, sf))


@query(f"WITH RECURSIVE {_CYCLES} SELECT component, node FROM sc")
def graph_scc(spark, sf):
    return _cycles(spark, sf)


@query(f"WITH RECURSIVE {_CYCLES} SELECT component, node FROM sc")
def graph_scc_rounds(spark, sf):
    """The same by the distributed rounds that larger graphs take."""
    return G.scc(T.edges(spark, sf), small_edges=0)


@query(f"WITH RECURSIVE {_CYCLES}, g AS (SELECT component, count(*) AS size FROM sc GROUP BY 1) SELECT component, size, CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS position FROM g")
def sort_cycles(spark, sf):
    return G.cycle_sizes(_cycles(spark, sf))


@query(f"WITH RECURSIVE {_CYCLES}, g AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS number FROM sc GROUP BY 1) SELECT node, CAST(number AS INTEGER) AS number FROM sc JOIN g USING (component)")
def win_cycle_number(spark, sf):
    return G.cycle_numbers(_cycles(spark, sf))


@query()
def graph_cycle_path(spark, sf):
    edges = _edges(spark, sf)
    return G.ordered_cycles(_cycles(spark, sf, edges), edges)


@query(f"WITH {_EDGES} SELECT n.id, (SELECT count(*) FROM e WHERE b = n.id) AS fan_in, (SELECT count(*) FROM e WHERE a = n.id) AS fan_out FROM n")
def agg_degrees(spark, sf):
    return G.degrees(_nodes(spark, sf), _edges(spark, sf))


@query(f"""WITH RECURSIVE {_CYCLES}, i AS (SELECT b AS id, count(*) AS c FROM e GROUP BY 1 ORDER BY c DESC, id LIMIT 1), o AS (SELECT a AS id, count(*) AS c FROM e GROUP BY 1 ORDER BY c DESC, id LIMIT 1)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT component) FROM sc) AS cycles, (SELECT count(DISTINCT node) FROM sc) AS cycle_nodes,
 (SELECT id FROM i) AS max_fan_in, (SELECT c FROM i) AS max_fan_in_count, (SELECT id FROM o) AS max_fan_out, (SELECT c FROM o) AS max_fan_out_count""")
def agg_graph_summary(spark, sf):
    edges = _edges(spark, sf)
    return G.summary(_nodes(spark, sf), edges, _cycles(spark, sf, edges))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT id AS node FROM n WHERE id < 40 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def graph_reachable(spark, sf):
    return G.reachable(T.edges(spark, sf), _nodes(spark, sf).where("id < 40").select(F.col("id").alias("node")))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT id AS node FROM n WHERE id < 40 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def graph_reachable_rounds(spark, sf):
    """The same by the distributed rounds that larger graphs take."""
    return G.reachable(T.edges(spark, sf), _nodes(spark, sf).where("id < 40").select(F.col("id").alias("node")), small_edges=0)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT id AS node FROM n WHERE id < 40 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT id AS path FROM n WHERE id NOT IN (SELECT node FROM r)")
def anti_unreachable(spark, sf):
    nodes = _nodes(spark, sf)
    return G.unreachable(nodes.select(F.col("id").alias("path")), T.edges(spark, sf), nodes.where("id < 40").select(F.col("id").alias("node")))


@query(f"WITH {_EDGES}, ends AS (SELECT a AS id FROM e UNION SELECT b FROM e) SELECT id, id AS label, 'package' AS kind FROM ends WHERE id NOT IN (SELECT id FROM n)")
def anti_package_nodes(spark, sf):
    return G.package_nodes(_nodes(spark, sf), _edges(spark, sf))


@query(f"WITH {_EDGES} SELECT DISTINCT x AS node FROM (SELECT a AS x FROM e WHERE a = 7 OR b = 7 UNION SELECT b FROM e WHERE a = 7 OR b = 7)")
def graph_neighbourhood(spark, sf):
    return G.neighbourhood(T.edges(spark, sf), 7)


_FOCUS = f"{_CYCLES}, d AS (SELECT n.id, (SELECT count(*) FROM e WHERE b = n.id OR a = n.id) AS degree, n.id IN (SELECT node FROM sc) AS in_cycle FROM n), fo AS (SELECT * FROM d ORDER BY in_cycle DESC, degree DESC, id LIMIT 40)"


@query(f"WITH RECURSIVE {_FOCUS} SELECT id, in_cycle, degree FROM fo")
def topk_focus(spark, sf):
    edges = _edges(spark, sf)
    return G.focus(_nodes(spark, sf), edges, _cycles(spark, sf, edges), 40)


@query(f'WITH RECURSIVE {_FOCUS} SELECT a AS "from", b AS "to" FROM e WHERE a IN (SELECT id FROM fo) AND b IN (SELECT id FROM fo)')
def semi_known_edges(spark, sf):
    edges = _edges(spark, sf)
    return G.known_edges(edges, G.focus(_nodes(spark, sf), edges, _cycles(spark, sf, edges), 40))


@query(f"""WITH RECURSIVE {_CYCLES} SELECT a AS "from", b AS "to", CASE WHEN x.component = y.component THEN 'cycle' WHEN a NOT IN (SELECT id FROM n) OR b NOT IN (SELECT id FROM n) THEN 'package' ELSE 'local' END AS class
FROM e LEFT JOIN sc x ON x.node = a LEFT JOIN sc y ON y.node = b""")
def join_cycle_membership(spark, sf):
    edges, nodes = _edges(spark, sf), _nodes(spark, sf)
    return G.edge_classes(edges, G.package_nodes(nodes, edges), _cycles(spark, sf, edges))


_COLLAPSED = f"{_EDGES}, m AS (SELECT CASE WHEN a % 10 < 3 THEN -1 - a // 50 ELSE a END AS x, CASE WHEN b % 10 < 3 THEN -1 - b // 50 ELSE b END AS y, CASE WHEN a % 2 = 0 THEN 1 ELSE a % 5 END AS w, a % 2 = 0 AS bare FROM e)"


@query(f"""WITH {_COLLAPSED} SELECT x AS "from", y AS "to", 'import' AS kind, CASE WHEN count(*) > 1 THEN CAST(sum(w) AS BIGINT) WHEN bool_or(bare) THEN NULL ELSE CAST(max(w) AS BIGINT) END AS weight FROM m WHERE x <> y GROUP BY 1, 2""")
def agg_collapse_edges(spark, sf):
    edges = _edges(spark, sf).withColumns({"kind": F.lit("import"), "weight": F.when(F.col("from") % 2 == 1, F.col("from") % 5)})
    ids = edges.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    inside = ids.where("node % 10 < 3").select("node", (-1 - F.floor(F.col("node") / 50)).alias("folder"))
    return G.collapse(edges, inside)


@query(f"WITH {_COLLAPSED} SELECT x AS \"from\", y AS \"to\", count(*) AS n FROM m WHERE x <> y GROUP BY 1, 2")
def graph_collapse(spark, sf):
    edges = _edges(spark, sf).withColumns({"kind": F.lit("import"), "weight": F.lit(None).cast("long")})
    ids = edges.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    inside = ids.where("node % 10 < 3").select("node", (-1 - F.floor(F.col("node") / 50)).alias("folder"))
    return G.collapse(edges, inside).select("from", "to", F.coalesce("weight", F.lit(1)).cast("long").alias("n"))


_DAG = f"{_EDGES}, dag AS (SELECT a, b FROM e WHERE a < b), rk AS (SELECT id, 0 AS rank FROM (SELECT a AS id FROM dag UNION SELECT b FROM dag) UNION SELECT dag.b, rk.rank + 1 FROM rk JOIN dag ON dag.a = rk.id)"


@query(f"WITH RECURSIVE {_DAG} SELECT id, CAST(max(rank) AS INTEGER) AS rank FROM rk GROUP BY id")
def graph_longest_path_rank(spark, sf):
    edges = _edges(spark, sf).where("`from` < `to`")
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    return G.ranks(nodes, edges)


_BACK = f"{_CYCLES}, ie AS (SELECT x.component, a, b FROM e JOIN sc x ON x.node = a JOIN sc y ON y.node = b AND y.component = x.component), bf AS (SELECT DISTINCT component, component AS node, 0 AS level FROM sc UNION SELECT ie.component, ie.b, level + 1 FROM bf JOIN ie ON ie.component = bf.component AND ie.a = bf.node WHERE level < 60), lv AS (SELECT component, node, min(level) AS level FROM bf GROUP BY 1, 2)"


@query(f'WITH RECURSIVE {_BACK} SELECT a AS "from", b AS "to" FROM ie JOIN lv x ON x.node = a JOIN lv y ON y.node = b WHERE y.level <= x.level')
def graph_back_edges(spark, sf):
    edges = _edges(spark, sf)
    return G.back_edges(edges, _cycles(spark, sf, edges))


_TWO = f"{_EDGES}, g1 AS (SELECT 0 AS seq, a, b, 'import' AS kind FROM e UNION ALL SELECT 1, b, a, 'import' FROM e), gn AS (SELECT 0 AS seq, id, 'l' || id AS label FROM n UNION ALL SELECT 1, s_suppkey, 'r' || s_suppkey FROM supplier UNION ALL SELECT 1, p_partkey, 'r' || p_partkey FROM part)"


def _two(spark, sf):
    """The graph of customers, and of suppliers and parts with all edges turned round, as two languages."""
    edges, kind, none = _edges(spark, sf), F.lit("import").alias("kind"), F.lit(None).cast("long")
    side = lambda seq, a, b: edges.select(F.lit(seq).alias("seq"), F.col(a).alias("from"), F.col(b).alias("to"), kind, none.alias("weight"))
    node = lambda df, seq, mark: df.select(F.lit(seq).alias("seq"), "id", F.concat(F.lit(mark), F.col("id").cast("string")).alias("label"), F.lit("file").alias("kind"), none.alias("loc"))
    others = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).union(table(spark, sf, "part").select("p_partkey"))
    return G.merge(node(_nodes(spark, sf), 0, "l").unionByName(node(others, 1, "r")), side(0, "from", "to").unionByName(side(1, "to", "from")))


@query(f"WITH {_TWO} SELECT id, min_by(label, seq) AS label FROM gn GROUP BY id")
def set_merge_graphs(spark, sf):
    return _two(spark, sf)[0].select("id", "label")


@query(f"WITH {_TWO}, me AS (SELECT DISTINCT a, b FROM g1), mn AS (SELECT DISTINCT id FROM gn) SELECT (SELECT count(*) FROM mn) AS nodes, (SELECT count(*) FROM me) AS edges, (SELECT count(*) FROM (SELECT a AS id FROM me UNION SELECT b FROM me) x WHERE id NOT IN (SELECT id FROM mn)) AS packages")
def set_cross_language(spark, sf):
    nodes, edges = _two(spark, sf)
    packages = G.package_nodes(nodes, edges)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(packages.agg(F.count("*").alias("packages")))


_NAMES = f"{_EDGES}, ex AS (SELECT DISTINCT b AS path, 'n' || (a % 6) AS name, a AS line FROM e), st AS (SELECT a AS path, b AS t FROM e WHERE a % 4 = 0), us AS (SELECT DISTINCT b AS path, 'n' || (a % 4) AS name FROM e WHERE a % 3 = 0), co AS (SELECT DISTINCT a AS path FROM e WHERE a % 17 = 0)"
_USED = f"{_NAMES}, wh AS (SELECT path FROM co UNION SELECT st.t FROM wh JOIN st ON st.path = wh.path), dm AS (SELECT path, name FROM us UNION SELECT st.t, dm.name FROM dm JOIN st ON st.path = dm.path WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.path = dm.path AND ex.name = dm.name)), used AS (SELECT DISTINCT path, name FROM ex WHERE (path, name) IN (SELECT path, name FROM dm) OR path IN (SELECT path FROM wh))"


def _exports(e):
    """A name for each edge, offered by the file that it leads to: different edges give different rows."""
    return e.select(F.col("to").alias("path"), F.concat(F.lit("n"), (F.col("from") % 6).cast("string")).alias("name"), F.col("from").alias("line"), F.col("from").alias("pos"))


def _names(spark, sf, edges=None):
    e = _edges(spark, sf) if edges is None else edges
    name = lambda k: F.concat(F.lit("n"), (F.col("from") % k).cast("string")).alias("name")
    stars = e.where(F.col("from") % 4 == 0).select(F.col("from").alias("path"), "to")
    uses = e.where(F.col("from") % 3 == 0).select("to", name(4))
    consumed = e.where(F.col("from") % 17 == 0).select(F.col("from").alias("path")).distinct()
    exports = _exports(e)
    return exports, G.used_names(exports, uses, stars, consumed)


@query(f"WITH RECURSIVE {_USED} SELECT path, name FROM used")
def graph_name_demand(spark, sf):
    return _names(spark, sf)[1]


@query(f"WITH RECURSIVE {_USED} SELECT path, name, min(line) AS line FROM ex WHERE (path, name) NOT IN (SELECT path, name FROM used) AND path % 10 > 0 GROUP BY 1, 2")
def anti_unreferenced(spark, sf):
    exports, used = _names(spark, sf)
    skipped = exports.where("path % 10 = 0").select("path").distinct()
    return G.unreferenced(exports, used, skipped)


@query(f"WITH {_NAMES} SELECT path, name, min(line) AS line FROM ex GROUP BY 1, 2")
def win_first_per_name(spark, sf):
    # an edge that comes twice has the same least line: edges aren't made distinct before
    return _exports(T.moves(spark, sf)).groupBy("path", "name").agg(F.min_by("line", "pos").alias("line"))


_DEAD = f"{_USED}, dead AS (SELECT path, name AS symbol, min(line) AS line, 'unreferenced-export' AS reason FROM ex WHERE (path, name) NOT IN (SELECT path, name FROM used) GROUP BY 1, 2 UNION ALL SELECT id, NULL, NULL, 'unreachable-file' FROM n WHERE id > 130)"


def _dead(spark, sf, edges=None):
    exports, used = _names(spark, sf, edges)
    names = G.unreferenced(exports, used, exports.select("path").limit(0)).select("path", F.col("name").alias("symbol"), "line", F.lit("unreferenced-export").alias("reason"))
    gone = _nodes(spark, sf).where("id > 130").select(F.col("id").alias("path"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("line"), F.lit("unreachable-file").alias("reason"))
    return names.unionByName(gone)


@query(f"WITH RECURSIVE {_DEAD} SELECT count(*) AS findings, count(DISTINCT path) AS files FROM dead")
def agg_dead_code_count(spark, sf):
    return V.dead_code_count(_dead(spark, sf))


@query(f"WITH RECURSIVE {_DEAD} SELECT reason, count(*) AS findings FROM dead GROUP BY 1")
def agg_dead_code_by_reason(spark, sf):
    return V.dead_code_by_reason(_dead(spark, sf))


@query(f"WITH RECURSIVE {_DEAD} SELECT path, coalesce(symbol, '') AS symbol, coalesce(line, 0) AS line, reason FROM dead ORDER BY path, coalesce(line, 0), coalesce(symbol, '')")
def sort_dead_code(spark, sf):
    return V.sorted_findings(_dead(spark, sf)).select("path", F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("line", F.lit(0)).alias("line"), "reason")


@query(f"WITH RECURSIVE {_CYCLES} SELECT id FROM n WHERE id NOT IN (SELECT node FROM sc)")
def set_except(spark, sf):
    return _nodes(spark, sf).exceptAll(_cycles(spark, sf).select("node").distinct())


# -- scope and paths


@query(f"WITH {_FILES} SELECT path FROM f WHERE regexp_matches(path, '^src1[^/]*/(en|fr)/[^/]*7[^/]*(/.*)?$')")
def flt_glob(spark, sf):
    return T.files(spark, sf).where(S.matches_any(F.col("path"), ["src1*/en/*7*", "./src1*/fr/*7*/"])).select("path")


@query(f"WITH {_FILES} SELECT path FROM f WHERE (starts_with(path, 'src2/') OR regexp_matches(path, '/de/')) AND NOT regexp_matches(path, '[^/]*3\\.ts$')")
def flt_scope(spark, sf):
    return T.files(spark, sf).where(S.in_scope(F.col("path"), ["src2", "**/de/**"], ["**/*3.ts"])).select("path")


_ODD_PATHS = "o AS (SELECT doc_id, source || '/' || CASE doc_id % 6 WHEN 0 THEN lang || '.test.ts' WHEN 1 THEN '__tests__/' || lang || '.tsx' WHEN 2 THEN 'vite.config.mjs' WHEN 3 THEN '.' || lang WHEN 4 THEN 'package.json' ELSE lang || '.d.ts' END AS path FROM documents)"


def _odd_paths(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.expr("CASE doc_id % 6 WHEN 0 THEN lang || '.test.ts' WHEN 1 THEN '__tests__/' || lang || '.tsx' WHEN 2 THEN 'vite.config.mjs' WHEN 3 THEN '.' || lang WHEN 4 THEN 'package.json' ELSE lang || '.d.ts' END")
    return docs.select("doc_id", F.concat_ws("/", "source", name).alias("path"))


@query(f"WITH {_ODD_PATHS} SELECT doc_id FROM o WHERE doc_id % 6 IN (0, 1, 5)")
def flt_extension(spark, sf):
    return _odd_paths(spark, sf).where(S.has_extension(F.col("path"), ["ts", "tsx"])).select("doc_id")


@query(f"WITH {_ODD_PATHS} SELECT doc_id FROM o WHERE doc_id % 6 IN (0, 1, 2)")
def flt_entry_regex(spark, sf):
    return _odd_paths(spark, sf).where(F.col("path").rlike(S.TEST_FILE) | F.col("path").rlike(S.TOOL_CONFIG)).select("doc_id")


@query(f"WITH {_ODD_PATHS} SELECT doc_id FROM o WHERE doc_id % 6 = 4")
def flt_manifest_path(spark, sf):
    return _odd_paths(spark, sf).where(S.is_manifest(F.col("path"))).select("doc_id")


@query(f"WITH {_FILES} SELECT path FROM f WHERE starts_with(path, 'src1/') OR starts_with(path, 'src3/en/')")
def flt_within_roots(spark, sf):
    return T.files(spark, sf).where(S.within(F.col("path"), ["src1", "src3/en"])).select("path")


@query("SELECT DISTINCT lang AS name FROM documents WHERE lang IN ('en', 'fr')")
def flt_allowlist(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("name")).where(F.col("lang").isin(*S.allowed(["de", "en", "fr"], ["fr", "en"]))).distinct()


@query("SELECT DISTINCT lang AS name FROM documents WHERE lang NOT IN ('en', 'fr')")
def anti_missing_plugins(spark, sf):
    named = table(spark, sf, "documents").select(F.col("lang").alias("name")).distinct()
    return S.missing_names(named, named.where("name IN ('en', 'fr')"))


@query(f"WITH {_FILES} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$') AS name FROM f")
def prj_container(spark, sf):
    return T.files(spark, sf).select("path", js.dir_name(F.col("path")).alias("folder"), js.file_name(F.col("path")).alias("name"))


@query(f"WITH {_FILES} SELECT path, split_part(path, '/', 1) AS folder FROM f UNION ALL SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f")
def prj_ancestors(spark, sf):
    return T.files(spark, sf).select("path", F.explode(js.ancestors(F.col("path"))).alias("folder"))


_FOLDERS = f"{_FILES}, an AS (SELECT path, length(content) AS w, seq, split_part(path, '/', 1) AS folder FROM f UNION ALL SELECT path, length(content), seq, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f)"


def _sized(spark, sf):
    return T.files(spark, sf).select("path", "seq", F.length("content").cast("long").alias("w"))


@query(f"WITH {_FOLDERS} SELECT folder, CAST(sum(w) AS BIGINT) AS size, count(*) AS files FROM an GROUP BY 1")
def agg_folder_sizes(spark, sf):
    return V.folder_sizes(_sized(spark, sf), "w")


@query(f"WITH {_FOLDERS} SELECT folder, CAST(sum(w) AS BIGINT) AS size FROM an GROUP BY 1 ORDER BY size DESC, folder LIMIT 20")
def sort_folders(spark, sf):
    return V.folder_sizes(_sized(spark, sf), "w").select("folder", "size").orderBy(F.desc("size"), "folder").limit(20)


@query(f"WITH {_FOLDERS} SELECT folder, bool_or(seq % 40 = 0) AS knotted FROM an GROUP BY 1")
def agg_folder_knotted(spark, sf):
    files = _sized(spark, sf)
    return V.knotted_folders(files, files.where("seq % 40 = 0").select(F.col("path").alias("node")))


@query(f"WITH {_FILES} SELECT path AS node, CASE WHEN starts_with(path, 'src1/') THEN 'src1' ELSE split_part(path, '/', 1) || '/en' END AS folder FROM f WHERE starts_with(path, 'src1/') OR contains(path, '/en/')")
def join_collapse(spark, sf):
    files = T.files(spark, sf)
    folded = files.select(F.explode(js.ancestors(F.col("path"))).alias("folder")).where("folder = 'src1' OR folder LIKE '%/en'").distinct()
    return V.folded_into(files, folded)


@query(f"WITH {_FILES} SELECT path, CASE WHEN contains(path, '/en/') THEN split_part(path, '/', 1) || '/en' WHEN starts_with(path, 'src1/') THEN 'src1' ELSE '' END AS folder FROM f")
def join_nearest_prefix(spark, sf):
    files = T.files(spark, sf)
    own = files.select(F.explode(F.concat(F.array(F.lit("")), js.ancestors(F.col("path")))).alias("folder")).where("folder = '' OR folder = 'src1' OR folder LIKE '%/en'").distinct()
    return M.nearest_folder(files, own)


_SPECS = "sp AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN '@' || lang || '/' || source || '/x' WHEN 1 THEN lang || '/sub/' || source WHEN 2 THEN './' || source WHEN 3 THEN 'node:fs' ELSE 'path' END AS spec FROM documents)"


def _specs(spark, sf):
    spec = F.expr("CASE doc_id % 5 WHEN 0 THEN '@' || lang || '/' || source || '/x' WHEN 1 THEN lang || '/sub/' || source WHEN 2 THEN './' || source WHEN 3 THEN 'node:fs' ELSE 'path' END")
    return table(spark, sf, "documents").select(spec.alias("spec")).distinct()


@query(f"WITH {_SPECS} SELECT spec, CASE WHEN starts_with(spec, '@') THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) WHEN starts_with(spec, '.') OR spec IN ('node:fs', 'path') THEN NULL ELSE split_part(spec, '/', 1) END AS package FROM sp")
def prj_package_name(spark, sf):
    return _specs(spark, sf).select("spec", M.package_name(F.col("spec")).alias("package"))


@query(f"WITH {_SPECS}, pk AS (SELECT DISTINCT lang AS name FROM documents UNION SELECT 'en/sub' UNION SELECT '@fr/src1') SELECT spec, max_by(name, length(name)) AS name FROM sp JOIN pk ON spec = name OR starts_with(spec, name || '/') GROUP BY spec")
def join_longest_name(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.select(F.col("lang").alias("name")).distinct().union(spark.createDataFrame([("en/sub",), ("@fr/src1",)], "name string"))
    return M.longest_name(_specs(spark, sf), names)


@query(f"WITH {_FILES}, b AS (SELECT seq, source || '/' || lang || '/' || CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) ELSE seq || '.js' END AS base FROM f JOIN documents ON doc_id = seq) SELECT b.seq AS id, f.path FROM b JOIN f ON f.path = base || '.ts' OR f.path = replace(base, '.js', '.ts')")
def join_first_match(spark, sf):
    docs = table(spark, sf, "documents")
    base = F.concat_ws("/", "source", "lang", F.expr("CASE WHEN doc_id % 2 = 0 THEN cast(doc_id AS string) ELSE cast(doc_id AS string) || '.js' END"))
    return M.first_match(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("rank"), base.alias("base")), T.files(spark, sf))


@query(f"WITH {_FILES} SELECT f.path, '../' || d.lang || '/' || d.doc_id AS spec, d.source || '/' || d.lang || '/' || d.doc_id || '.ts' AS \"to\" FROM f JOIN documents d ON d.doc_id = f.seq")
def join_resolve(spark, sf):
    docs = table(spark, sf, "documents")
    imports = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".ts"))).alias("path"), F.concat(F.lit("../"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("spec"))
    return M.resolve(imports, T.files(spark, sf))


@query(f"WITH {_SPECS} SELECT spec, '@en/*' AS pattern, 'src/' || substr(spec, 5) AS target, 0 AS rank FROM sp WHERE starts_with(spec, '@en/') AND NOT starts_with(spec, '@en/src1') UNION ALL SELECT spec, '@en/src1*', 'one/' || substr(spec, 9), 0 FROM sp WHERE starts_with(spec, '@en/src1') UNION ALL SELECT spec, '@en/src1*', 'two/' || substr(spec, 9) || '/y', 1 FROM sp WHERE starts_with(spec, '@en/src1')")
def join_alias_pattern(spark, sf):
    aliases = spark.createDataFrame([("@en/*", 0, ["src/*"]), ("@en/src1*", 1, ["one/*", "two/*/y"])], "pattern string, seq int, targets array<string>")
    return M.alias_target(_specs(spark, sf), aliases)


_CANDIDATES = "unnest(generate_series(1, 16)) AS pos FROM (SELECT path, seq, regexp_replace(path, '\\.ts$', '') AS stem FROM f) x"


@query(f"""WITH {_FILES}, k AS (SELECT path, seq, stem, {_CANDIDATES} WHERE seq % 2 = 0) SELECT path, pos, stem || CASE WHEN pos > 8 THEN '/index.' ELSE '.' END || (['ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs'])[(pos - 1) % 8 + 1] AS candidate FROM k
UNION ALL SELECT path, pos, stem || (['.js', '.ts', '.tsx'])[pos] FROM (SELECT path, seq, stem, {_CANDIDATES}) y WHERE seq % 2 = 1 AND pos < 4""")
def prj_candidate_paths(spark, sf):
    """Of every other path without its extension, of the rest as what it is built to."""
    base = F.when(F.col("seq") % 2 == 0, F.regexp_replace("path", r"\.ts\z", "")).otherwise(F.regexp_replace("path", r"\.ts\z", ".js"))
    each = T.files(spark, sf).select("path", F.posexplode(M.candidate_paths(base)).alias("pos", "candidate"))
    return each.withColumn("pos", (F.col("pos") + 1).cast("long"))


_DEPS = "dp AS (SELECT DISTINCT source AS folder, CASE doc_id % 3 WHEN 0 THEN '@types/' || lang WHEN 1 THEN lang ELSE source END AS name FROM documents), im AS (SELECT DISTINCT source AS folder, lang AS name FROM documents WHERE doc_id % 4 = 1)"


@query(f"WITH {_DEPS} SELECT folder, name FROM dp WHERE NOT starts_with(name, '@types/') AND (folder, name) NOT IN (SELECT folder, name FROM im)")
def anti_unused_dep(spark, sf):
    docs = table(spark, sf, "documents")
    dependencies = docs.select(F.col("source").alias("folder"), F.expr("CASE doc_id % 3 WHEN 0 THEN '@types/' || lang WHEN 1 THEN lang ELSE source END").alias("name")).distinct()
    imports = docs.where("doc_id % 4 = 1").select(F.col("source").alias("folder"), F.concat("lang", F.lit("/deep")).alias("spec"))
    return M.unused_dependencies(dependencies, imports)


@query(f"WITH {_ODD_PATHS} SELECT DISTINCT path FROM o WHERE doc_id % 6 IN (0, 1, 2) OR doc_id % 30 = 3")
def set_entries_union(spark, sf):
    own = _odd_paths(spark, sf)
    return M.entries(own, own.where("doc_id % 30 = 3").select("path").distinct())


# -- cache and display


@query("SELECT doc_id AS seq FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def join_cache(spark, sf):
    files = T.files(spark, sf)
    return V.cache_misses(files, files.where("seq % 2 = 0").select("blob").distinct()).select("seq")


@query("SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses FROM (SELECT sha1(text) IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0) AS h FROM documents)")
def agg_cache_delta(spark, sf):
    files = T.files(spark, sf)
    return V.cache_delta(files, files.where("seq % 2 = 0").select("blob").distinct())


@query("SELECT min(o_orderkey) AS id, CAST(o_orderdate AS VARCHAR) AS finished_at FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 8")
def topk_recent_runs(spark, sf):
    runs = T.commits(spark, sf).select(F.col("sha").alias("id"), F.col("ts").alias("finished_at"))
    return V.recent_runs(runs).select("id", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'detached' ELSE lang END || ' @ ' || substr(sha1(text), 1, 8) AS shown FROM documents")
def prj_run_display(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), V.run_display(F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.sha1("text")).alias("shown"))


def _fixed_sql(x: str, digits: int) -> str:
    """A tie, which only a multiple of a power of 1/2 is, goes up; else the exact value is rounded."""
    tie = f"({x}) * {10**digits} - floor(({x}) * {10**digits}) = 0.5 AND ({x}) * {2 ** (digits + 1)} = floor(({x}) * {2 ** (digits + 1)})"
    return f"CASE WHEN {tie} THEN printf('%.{digits}f', floor(({x}) * {10**digits} + 0.5) / {10**digits}) ELSE printf('%.{digits}f', {x}) END"


def _compact_sql(n: str) -> str:
    unit = lambda d, u: f"CASE WHEN {n} / {d}.0::DOUBLE < 10 THEN {_fixed_sql(f'{n} / {d}.0::DOUBLE', 1)} ELSE {_fixed_sql(f'{n} / {d}.0::DOUBLE', 0)} END || '{u}'"
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} < 1000000 THEN {unit(1000, 'k')} WHEN {n} < 1000000000 THEN {unit(1000000, 'M')} ELSE {unit(1000000000, 'B')} END"


@query(f"WITH v AS (SELECT doc_id AS id, n_chars AS n, n_chars * 997 AS m, n_chars * 1000003 AS b FROM documents) SELECT id, {_compact_sql('n')} AS chars, {_compact_sql('m')} AS more, {_compact_sql('b')} AS most FROM v")
def prj_format_number(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), *(js.compact_number(x).alias(c) for c, x in (("chars", n), ("more", n * 997), ("most", n * 1000003))))


@query(f"""WITH v AS (SELECT doc_id AS id, n_chars * 13 AS ms FROM documents), s AS (SELECT *, floor(ms / 1000.0::DOUBLE + 0.5)::BIGINT AS whole FROM v)
SELECT id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN {_fixed_sql('ms / 1000.0::DOUBLE', 1)} || ' s' WHEN whole % 60 = 0 THEN whole // 60 || ' m' ELSE whole // 60 || ' m ' || whole % 60 || ' s' END AS shown FROM s""")
def prj_format_duration(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), js.duration(F.col("n_chars") * 13).alias("shown"))


@query("""WITH v AS (SELECT o_orderkey AS id, date_diff('millisecond', o_orderdate::TIMESTAMP, TIMESTAMP '1998-08-03 12:00:00') AS ms FROM orders)
SELECT id, CASE WHEN ms < 60000 THEN 'just now' WHEN ms < 3600000 THEN ms // 60000 || ' min ago' WHEN ms < 86400000 THEN ms // 3600000 || ' h ago' WHEN ms < 604800000 THEN ms // 86400000 || ' d ago' ELSE ms // 604800000 || ' w ago' END AS age FROM v""")
def prj_format_age(spark, sf):
    return T.commits(spark, sf).select(F.col("sha").alias("id"), js.relative_age(F.col("ts"), F.lit("1998-08-03 12:00:00").cast("timestamp")).alias("age"))


@query(f"WITH {_FILES} SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM f")
def prj_dir_label(spark, sf):
    return T.files(spark, sf).select("path", js.dir_label(F.col("path")).alias("folder"))


_CARDS = f"""dc AS (SELECT count(*) AS findings, count(DISTINCT path) AS files FROM dead), top AS (SELECT path, score FROM h WHERE score > 0 ORDER BY score DESC, CAST(path AS VARCHAR) LIMIT 1),
cy AS (SELECT count(DISTINCT component) AS cycles, count(DISTINCT node) AS nodes FROM sc), ct AS (SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (breaking) AS breaking FROM pc), fi AS (SELECT count(*) AS n FROM documents)"""


@query(f"""WITH RECURSIVE {_DEAD.replace(_EDGES, _CYCLES) if _EDGES in _DEAD else f"{_CYCLES}, {_DEAD}"}, {_HOT}, {_PARSED}, {_CARDS}
SELECT 1 AS position, 'files' AS key, {_compact_sql('n')} AS value, '2 languages' AS hint, 'plain' AS tone, NULL AS title FROM fi
UNION ALL SELECT 2, 'hotspot', CAST(path AS VARCHAR), 'score ' || {_compact_sql('score')}, 'plain', CAST(path AS VARCHAR) FROM top
UNION ALL SELECT 3, 'cycles', {_compact_sql('cycles')}, CASE WHEN cycles > 0 THEN nodes || ' files' ELSE 'none' END, CASE WHEN cycles > 0 THEN 'danger' ELSE 'plain' END, NULL FROM cy
UNION ALL SELECT 4, 'commits', {_compact_sql('total')}, CASE WHEN breaking > 0 THEN breaking || ' breaking' ELSE valid || ' conventional' END, CASE WHEN breaking > 0 THEN 'warn' ELSE 'plain' END, NULL FROM ct
UNION ALL SELECT 5, 'dead-code', {_compact_sql('findings')}, CASE WHEN findings > 0 THEN files || ' files' ELSE 'none' END, CASE WHEN findings > 0 THEN 'warn' ELSE 'plain' END, NULL FROM dc
UNION ALL SELECT 6, 'plugins', '4', '1 skipped', 'warn', NULL""")
def agg_overview_cards(spark, sf):
    """All six cards, from the whole tables."""
    edges = _edges(spark, sf)
    graph = G.summary(_nodes(spark, sf), edges, _cycles(spark, sf, edges))
    return V.overview(T.files(spark, sf), ["ts", "py"], _hotspots(spark, sf), graph, C.totals(_parsed(spark, sf)), _dead(spark, sf, edges), 4, 1)


# -- sources, trees and gates


def _code(spark, sf):
    """A small module made from each document's columns."""
    docs = table(spark, sf, "documents")
    text = F.concat(
        F.lit("import d, { "), "lang", F.lit(", type T as U } from './"), "source", F.lit("'\n/* import x from 'no'\n*/ export const "), "source", F.lit(" = a && b ? 1 : 2 // if\nif (x?.y) { f('|| && ?') }\n"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("export * from './all'\n")).otherwise("const z = require(\"z\")\n"),
    )
    return docs.select("doc_id", text.alias("content"))


def _module(spark, sf, kinds):
    """(doc_id, content): a line of code for every four words of a document's whole text; kinds: SQL of the line of each kind in turn, over the words w1 to w4."""
    words = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[a-z]+"), 0).alias("w"))
    at = lambda k: f"'w_' || get(w, 4 * i + {k})"
    cases = " ".join(f"WHEN {k} THEN {line}" for k, line in enumerate(kinds))
    for k in range(4):
        cases = cases.replace(f"w{k + 1}", at(k))
    lines = f"transform(sequence(0, greatest(size(w) div 4 - 1, 0)), i -> CASE WHEN size(w) < 4 THEN '' ELSE CASE i % {len(kinds)} {cases} END END)"
    return words.select("doc_id", F.expr(f"array_join({lines}, '\\n')").alias("content"))


_MODULE = "g AS (SELECT doc_id, i, 'w_' || w[4 * i + 1] AS w1, 'w_' || w[4 * i + 2] AS w2, 'w_' || w[4 * i + 3] AS w3 FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) // 4 - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents) x WHERE len(w) >= 4) y)"


@query(f"""WITH {_MODULE} SELECT d.doc_id, CAST(1 + coalesce(sum(CASE i % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS complexity
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def prj_cyclomatic(spark, sf):
    """Branch points among words that comments, strings and regular expressions only seem to have."""
    from ..operators import source as Z

    kinds = [
        "'if (' || w1 || ' && ' || w2 || ') {'", "'x = /' || w1 || '||[/?:&]*\"/.test(' || w2 || ') ? 1 : 2'", "'// if (' || w1 || ') /* ' || w2", "'s = \"if (' || w1 || ') && //\" + `a || ${' || w2 || '}`'",
        "w1 || '?.' || w2 || ' ?? ' || w3", "'} while (' || w1 || ' / 2 / ' || w2 || ')'",
    ]
    return _module(spark, sf, kinds).where("content is not null").select("doc_id", Z.cyclomatic(F.col("content")).alias("complexity"))


@query(f"""WITH {_MODULE} SELECT doc_id, CASE i % 5 WHEN 0 THEN './' || w3 WHEN 1 THEN './' || w2 WHEN 2 THEN './' || w1 ELSE './' || w3 END AS spec,
  CASE i % 5 WHEN 0 THEN w1 || ',' || w2 WHEN 1 THEN w1 WHEN 2 THEN '' ELSE 'default' END AS names, i % 5 IN (2, 4) AS namespace FROM g WHERE i % 5 <> 3""")
def prj_imports(spark, sf):
    """Imports of every form among ones that comments, strings and regular expressions only seem to have."""
    from ..operators import source as Z

    kinds = [
        "'import { ' || w1 || ', ' || w2 || \" as x } from './\" || w3 || \"'\"", "'export { ' || w1 || ' as y } from \"./' || w2 || \"\\\" // import no from 'no'\"", "'const q = require(`./' || w1 || \"`) /* import z from 'z' */\"",
        "'const r = s.replace(/\\\\/*' || w1 || \"['/]/, 'import a from ')\"", "'import ' || w1 || ', * as ' || w2 || \" from './\" || w3 || \"'\"",
    ]
    each = _module(spark, sf, kinds).select("doc_id", F.explode(Z.imports(F.col("content"))).alias("i"))
    return each.select("doc_id", "i.spec", F.array_join("i.names", ",").alias("names"), "i.namespace")


@query("SELECT doc_id, './all' AS spec FROM documents WHERE doc_id % 2 = 0")
def prj_stars(spark, sf):
    from ..operators import source as Z

    return _code(spark, sf).select("doc_id", F.explode(Z.stars(Z.blank_comments(F.col("content")))).alias("spec"))


@query("""SELECT doc_id, source || k AS name, CAST(line AS INTEGER) AS line FROM documents, (VALUES ('', 4), ('_b', 5), ('_x', 6), ('_z', 6), ('_l', 9), ('_shown', 10), ('_f', 12)) v(k, line)
UNION ALL SELECT doc_id, 'default', 13 FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, lang, 13 FROM documents WHERE doc_id % 2 = 0""")
def prj_exports(spark, sf):
    """A module of several lines made from each document's columns: lists, patterns and declarations over line ends."""
    from ..operators import source as Z

    name = lambda k: F.concat("source", F.lit(k))
    code = F.concat(
        F.lit("import x from 'y'\n/* export const no = 1\n*/\nexport const "), name(""), F.lit(" = f(1, { a, b }),\n  "), name("_b"), F.lit(" = 2;\nexport const { "), name("_x"), F.lit(", y: "), name("_z"), F.lit(" = `\n` } = o\nexport {\n  "),
        name("_l"), F.lit(",\n  hidden as "), name("_shown"), F.lit(",\n} from './p'\nexport async function "), name("_f"), F.lit("() {}\n"), F.when(F.col("doc_id") % 2 == 1, F.lit("export default class K {}")).otherwise(F.concat(F.lit("export * as "), "lang", F.lit(" from './q'"))),
    )
    each = table(spark, sf, "documents").select("doc_id", F.explode(Z.exports(Z.blank_comments(code))).alias("e"))
    return each.select("doc_id", "e.name", "e.line")


#: The same pieces in a pattern language without look-behind: an operator goes with the regular expression behind it.
_BODY = r"(?:{0}|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])"
_LITERAL = rf"[ \t\n\x0B\f\r]*/{_BODY.format(r'[^*/\\\[\n]')}{_BODY.format(r'[^/\\\[\n]')}*/[a-z]*"
_PIECES = "|".join((
    rf"(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await){_LITERAL}", r"[\w$)\]]!", r"[<>]=|\+\+|--", rf"(?:=>|[(\[{{,;:?&|^~*%=!+\-]){_LITERAL}", rf"\}}[ \t\x0B\f\r]*\n{_LITERAL}",
    r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'", r"`(?:[^`\\]|\\(?s:.))*`", r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", r"[\w$.]+", r"(?s:.)",
)).replace("'", "''")


@query(rf"""WITH c AS (SELECT doc_id, 'const r = s.replace(/\/*$/, "")' || chr(10) || coalesce(text, '') AS content FROM documents),
p AS (SELECT doc_id, content, array_to_string(list_transform(regexp_extract_all(content, '{_PIECES}'), lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END), '') AS code FROM c)
SELECT doc_id, sha256(code) AS code_sha256, code <> content AS commented FROM p""")
def prj_blank_comments(spark, sf):
    """Whole texts behind a line of code with a regular expression that would begin a comment."""
    from ..operators import source as Z

    content = F.concat(F.lit("const r = s.replace(/\\/*$/, \"\")\n"), F.coalesce("text", F.lit("")))
    code = table(spark, sf, "documents").select("doc_id", content.alias("content")).withColumn("code", Z.blank_comments(F.col("content")))
    return code.select("doc_id", F.sha2("code", 256).alias("code_sha256"), (F.col("code") != F.col("content")).alias("commented"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || source WHEN 1 THEN NULL ELSE source END AS value FROM documents")
def prj_static_string(spark, sf):
    from ..operators import source as Z

    literal = F.expr("CASE doc_id % 3 WHEN 0 THEN '\"' || lang || ' ' || source || '\"' WHEN 1 THEN '`' || lang || '$' || '{x}`' ELSE '`' || source || '`' END")
    return table(spark, sf, "documents").select("doc_id", Z.static_string(literal).alias("value"))


def _repository(spark, sf):
    """A repository made from documents: each folder `source/lang` is a package, and each document a module of it.

    A module imports the next one of its folder (so chains end), every fifth its own package's index, and offers two
    names of which the module before takes one.  The index takes the first module."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("folder"))
    n = docs.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("doc_id")))
    k = lambda d=0: (F.col("k") + d).cast("string")
    code = F.concat(
        F.lit("const bare = text.replace(/\\/*['\"`]$/, ''); import { a"), k(1), F.lit(" } from './m"), k(1), F.lit(".js'\n"), F.when(F.col("k") % 5 == 0, F.lit("import * as all from './index'\n")).otherwise(""),
        F.lit("export const a"), k(), F.lit(" = 1,\n  b"), k(), F.lit(" = 2\n"),
    )
    modules = n.select(F.concat("folder", F.lit("/m"), k(), F.lit(".ts")).alias("path"), code.alias("content"))
    folders = docs.select("folder").distinct()
    index = folders.select(F.concat("folder", F.lit("/index.ts")).alias("path"), F.lit("export { a1 } from './m1'\nimport 'used/deep'\n").alias("content"))
    lost = folders.select(F.concat("folder", F.lit("/lost.ts")).alias("path"), F.lit("export const nobody = 1").alias("content"))
    manifests = folders.select(F.concat("folder", F.lit("/package.json")).alias("path"), F.lit('{\n  "main": "./index.js",\n  "dependencies": {\n    "used": "1",\n    "idle": "1"\n  }\n}').alias("text"))
    return modules.union(index).union(lost), manifests


def _scanned(spark, sf):
    """Scans of the repository's files, written once, and its manifests."""
    from ..operators import language as L

    files, manifests = _repository(spark, sf)
    return written(L.scan_files(files), "scans"), manifests


def _imports(scans, manifests):
    from ..operators import language as L

    return L.import_graph(scans, manifests, manifests.limit(0))


_REPOSITORY = "m AS (SELECT source || '/' || lang AS folder, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents), z AS (SELECT folder, max(k) AS top FROM m GROUP BY 1)"


@query(f"""WITH {_REPOSITORY} SELECT folder || '/m' || k || '.ts' AS path, 'b' || k AS symbol, CAST(CASE WHEN k % 5 = 0 THEN 4 ELSE 3 END AS INTEGER) AS line, 'unreferenced-export' AS reason FROM m
UNION ALL SELECT folder || '/lost.ts', NULL, NULL, 'unreachable-file' FROM z UNION ALL SELECT folder || '/package.json', 'idle', 5, 'unused-dependency' FROM z""")
def lang_dead_code(spark, sf):
    from ..operators import language as L

    scans, manifests = _scanned(spark, sf)
    return L.findings(scans, *_imports(scans, manifests))


@query(f"""WITH {_REPOSITORY} SELECT folder || '/m' || k || '.ts' AS "from", folder || '/m' || (k + 1) || '.ts' AS "to", 'import' AS kind FROM m JOIN z USING (folder) WHERE k < top
UNION ALL SELECT folder || '/m' || k || '.ts', folder || '/index.ts', 'import' FROM m WHERE k % 5 = 0 UNION ALL SELECT folder || '/index.ts', folder || '/m1.ts', 'import' FROM z""")
def lang_import_graph(spark, sf):
    return _imports(*_scanned(spark, sf))[1].select("from", "to", "kind")


@query(f"""WITH {_REPOSITORY}, c AS (SELECT count(*) AS cycles, coalesce(sum(top // 5 * 5 + 1), 0) AS cycle_nodes FROM z WHERE top >= 5)
SELECT (SELECT count(*) FROM m) + 2 * (SELECT count(*) FROM z) AS nodes, (SELECT sum(top - 1 + top // 5 + 1) FROM z)::BIGINT AS edges, cycles, cycle_nodes::BIGINT AS cycle_nodes FROM c""")
def lang_graph_summary(spark, sf):
    scans, manifests = _scanned(spark, sf)
    edges = _imports(scans, manifests)[1]
    return G.summary(scans.select(F.col("path").alias("id")), edges, written(G.scc(edges), "cycles")).select("nodes", "edges", "cycles", "cycle_nodes")


@query(f"""WITH {_REPOSITORY} SELECT folder || '/m' || k || '.ts' AS path, CASE WHEN k % 5 = 0 THEN 5 ELSE 4 END AS loc, 1 AS complexity FROM m UNION ALL SELECT folder || '/index.ts', 3, 1 FROM z UNION ALL SELECT folder || '/lost.ts', 1, 1 FROM z""")
def lang_code_metrics(spark, sf):
    from ..operators import language as L

    return L.code_metrics(_scanned(spark, sf)[0]).select("path", "loc", "complexity")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'src/' || lang || '.ts' ELSE 'src/' || lang || '/index.ts' END AS path FROM documents")
def graph_entry_resolve(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.select("lang").distinct()
    built = names.select(F.concat(F.lit("src/"), "lang", F.lit(".ts")).alias("path")).union(names.select(F.concat(F.lit("src/"), "lang", F.lit("/index.ts"))))
    values = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("folder"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./dist/"), "lang", F.lit(".js"))).otherwise(F.concat(F.lit("lib/"), "lang", F.lit("/index.d.ts"))).alias("value"))
    return M.first_match(M.entry_candidates(values), built)


@query(f"WITH {_FILES}, fo AS (SELECT DISTINCT split_part(path, '/', 1) AS folder FROM f UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f), ch AS (SELECT split_part(folder, '/', 1) AS folder, count(*) AS n FROM fo WHERE contains(folder, '/') GROUP BY 1) SELECT fo.folder, CASE WHEN contains(fo.folder, '/') AND ch.n > 1 THEN split_part(fo.folder, '/', 1) ELSE '' END AS parent, CASE WHEN contains(fo.folder, '/') AND ch.n > 1 THEN split_part(fo.folder, '/', 2) ELSE fo.folder END AS name FROM fo JOIN ch ON ch.folder = split_part(fo.folder, '/', 1) WHERE contains(fo.folder, '/') OR ch.n > 1")
def tree_compress(spark, sf):
    return V.compressed_folders(T.files(spark, sf))


@query(f"WITH {_FILES}, it AS (SELECT DISTINCT split_part(path, '/', 1) AS path, 0 AS depth FROM f UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 1 FROM f WHERE starts_with(path, 'src1') UNION SELECT path, 2 FROM f WHERE starts_with(path, 'src1') AND contains(path, '/en/')) SELECT path, depth FROM it")
def tree_rows(spark, sf):
    files = T.files(spark, sf)
    opened = files.select(F.explode(js.ancestors(F.col("path"))).alias("folder")).where("folder LIKE 'src1%' AND (folder NOT LIKE '%/%' OR folder LIKE '%/en')").distinct()
    return V.open_rows(files, opened)


@query(f"WITH {_FILES} SELECT 'src1* -> **/de' AS rule, path, 'imports lib/de/x.ts' AS message, 'error' AS severity FROM f WHERE starts_with(path, 'src1') UNION ALL SELECT '**/fr -> lib', path, 'imports lib/de/x.ts', 'warning' FROM f WHERE contains(path, '/fr/')")
def ext_architecture_rules(spark, sf):
    from ..operators.gates import ArchitectureRule, violations

    edges = T.files(spark, sf).select(F.col("path").alias("from"), F.lit("lib/de/x.ts").alias("to"))
    return violations(edges, [ArchitectureRule("src1*", "**/de"), ArchitectureRule("**/fr", "lib", enforced=False)])


_COMPARED = f"{_TOUCH}, b AS (SELECT path, count(*) AS n FROM t WHERE ts < TIMESTAMP '1995-04-01' GROUP BY 1), a AS (SELECT path, count(*) AS n FROM t WHERE ts >= TIMESTAMP '1995-04-01' GROUP BY 1), c AS (SELECT coalesce(a.path, b.path) AS path, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL OUTER JOIN b ON a.path = b.path)"


def _compared(spark, sf):
    """The history before and from a day on, as two runs."""
    from ..operators.gates import compare

    touches, day = _touches(spark, sf), F.lit("1995-04-01").cast("timestamp")
    return compare(H.churn(touches.where(F.col("ts") < day)), H.churn(touches.where(F.col("ts") >= day)), "path", "changes")


@query(f"WITH {_COMPARED} SELECT * FROM c")
def ext_compare_runs(spark, sf):
    return _compared(spark, sf)


@query(f"WITH {_COMPARED} SELECT * FROM c WHERE change > 0 AND (before = 0 OR 100 * change > 20 * before)")
def ext_hotspot_gate(spark, sf):
    from ..operators.gates import regressions

    return regressions(_compared(spark, sf), 20)


@query(f"WITH {_ODD_PATHS} SELECT doc_id FROM o WHERE doc_id % 6 = 4 AND doc_id % 4 = 0")
def flt_tsconfig_path(spark, sf):
    path = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("path", r"package\.json\z", "tsconfig.app.json")).otherwise(F.concat(F.lit("node_modules/"), F.regexp_replace("path", r"package\.json\z", "tsconfig.json")))
    return _odd_paths(spark, sf).where(S.is_config(path)).select("doc_id")


@query(f"WITH {_FILES} SELECT DISTINCT source || '/' || lang AS component, CAST(count(*) AS BIGINT) AS size FROM documents GROUP BY 1 HAVING count(*) > 1")
def ext_new_cycles(spark, sf):
    """Each folder's files are a cycle; in the run before, folders of one file were cycles too, and other ones weren't."""
    from ..operators.gates import new_cycles

    cycles = T.files(spark, sf).select(js.dir_name(F.col("path")).alias("component"), F.col("path").alias("node"))
    sizes = cycles.groupBy("component").agg(F.count("*").alias("n"))
    before = cycles.join(sizes.where("n = 1"), "component").select("component", "node")
    return new_cycles(before, cycles).select("component", F.size("nodes").cast("long").alias("size"))


_PLACED = f"{_TOUCH}, p AS (SELECT p_partkey AS path, replace(p_brand, '/', '-') || '/' || p_size AS folder, replace(p_brand, '/', '-') AS top FROM part), z AS (SELECT unnest([top, folder, folder || '/' || t.path]) AS place, author FROM t JOIN p ON p.path = t.path)"


@query(f"""WITH {_PLACED}, n AS (SELECT place, author, count(*) AS n FROM z GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, author) AS k FROM n)
SELECT place, CAST(sum(n) AS BIGINT) AS commits, count(*) AS authors, max(CASE WHEN k = 1 THEN author END) AS owner, max(n) / sum(n) AS share, sum(n * n) / (sum(n) * sum(n)) AS concentration FROM r GROUP BY place""")
def ext_knowledge_map(spark, sf):
    """Files are parts in folders of brand and size."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.concat_ws("/", F.replace("p_brand", F.lit("/"), F.lit("-")), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("path"))
    return C.knowledge_map(_touches(spark, sf).withColumnRenamed("path", "part").join(parts, "part").select("path", "author"))


@query(f"""WITH {_HOT}, {_COUPLED} SELECT 'hotspots' AS series, CAST(path AS VARCHAR) AS subject, CAST(score AS DOUBLE) AS value, CAST(changes AS BIGINT) AS changes, NULL AS file_b, NULL AS shared_changes FROM h
UNION ALL SELECT 'change-coupling', file_a || ' ↔ ' || file_b, degree, NULL, file_b, shared_changes FROM cp WHERE degree >= 5""")
def agg_metric_series(spark, sf):
    """Two metrics in one form, written as that, and fields of their metas read back."""
    from ..operators import series as E

    rows = E.united([E.of_hotspots(_hotspots(spark, sf)), E.of_coupling(H.coupling(T.commit_files(spark, sf), LIMITS))])
    return written(rows, "series").select("series", "subject", "value", E.field("changes", "long").alias("changes"), E.field("fileB", "long").alias("file_b"), E.field("sharedChanges", "long").alias("shared_changes"))


def _two_reports(spark, sf):
    """Reports of the history before and after a day: change counts as hotspots, and who hands over to whom as cycles."""
    touched = _touches(spark, sf)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("n"))
    out = []
    for when, size in (("ts < '1995-04-01'", F.lit(5)), ("ts >= '1995-04-01'", F.lit(6))):
        hot = H.churn(touched.where(when)).select("path", F.col("changes").alias("score"))
        group = F.floor(F.col("a") / size)
        out.append({"hotspots": hot, "cycles": customers.select(group.alias("component"), F.col("a").alias("node")), "only": hot})
    return out


@query(f"""WITH {_COMPARED}, x AS (SELECT path, before, after FROM c),
cy AS (SELECT 0 AS side, c_custkey // 5 AS g, c_custkey AS node FROM customer UNION ALL SELECT 1, c_custkey // 6, c_custkey FROM customer),
cd AS (SELECT g, node, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS a FROM cy GROUP BY 1, 2)
SELECT 'hotspots' AS "table", CASE WHEN before = 0 THEN 'added' WHEN after = 0 THEN 'removed' ELSE 'changed' END AS change, count(*) AS rows, CAST(sum(after - before) AS BIGINT) AS growth FROM x WHERE before <> after GROUP BY 1, 2
UNION ALL SELECT 'cycles', CASE WHEN b = 0 THEN 'added' ELSE 'removed' END, count(*), NULL FROM cd WHERE (a = 0) <> (b = 0) GROUP BY 1, 2""")
def ext_report_differences(spark, sf):
    """All tables of two reports compared, counted by table and change."""
    from ..operators import gates

    found = gates.differences(*_two_reports(spark, sf), gates.KEYS | {"cycles": ("component", "node")})
    score = lambda c: F.coalesce(F.get_json_object(c, "$.score").cast("long"), F.lit(0))
    growth = F.sum(F.when(F.col("table") == "hotspots", score("after") - score("before")))
    return found.groupBy("table", "change").agg(F.count("*").alias("rows"), growth.alias("growth"))


@query(f"""WITH {_COMPARED}, cy AS (SELECT g, string_agg(CAST(node AS VARCHAR), ', ' ORDER BY node) AS nodes, count(*) AS n FROM (SELECT c_custkey // 6 AS g, c_custkey AS node FROM customer) y GROUP BY 1),
old AS (SELECT string_agg(CAST(node AS VARCHAR), ', ' ORDER BY node) AS nodes FROM (SELECT c_custkey // 5 AS g, c_custkey AS node FROM customer) y GROUP BY g)
SELECT 'new-cycle' AS gate, nodes AS subject, 'cycle of ' || n || ' files' AS message, 'error' AS severity FROM cy WHERE nodes NOT IN (SELECT nodes FROM old)
UNION ALL SELECT 'hotspot-regression', CAST(path AS VARCHAR), 'score ' || before || ' -> ' || after, 'warning' FROM c WHERE change > 0 AND (before = 0 OR 100 * change > 10 * before)""")
def ext_report_findings(spark, sf):
    from ..operators import gates

    return gates.findings(*_two_reports(spark, sf))
