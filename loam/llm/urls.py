"""URL filters: block and allow rules, spread over redirects and canonical links.

A url that a rule fits has that rule's verdict.  Any other takes the verdict of its aliases: urls
are joined by redirect edges and canonical-link edges, connected components are found by a
distributed contraction, and a component with an allow rule on any member is allowed, one with a
block rule only is blocked.  What nothing speaks about is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shared import components

#: Rules that become one expression of the plan; longer lists are joined by host suffix.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; text: host, then the path's beginning."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What is the same resource by itself: scheme and host in lower case, without the fragment."""
    plain = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(plain, r"^([\s\S]*?://[^/?]*)", 1)
    return F.when(url.isNotNull() & (head != ""), F.concat(F.translate(head, _UPPER, _LOWER), F.substring(plain, F.length(head) + 1, F.length(plain))))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df, which has host and path, with `rule` and `_loam_verdict` of the longest rule that fits; of equal ones, allow."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict, r.text))
    if len(ordered) > INLINE_RULES:
        return _joined(df, ordered)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.withColumns({"rule": rule, "_loam_verdict": verdict})


def _joined(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for long lists: an equi-join of (host, path) with the rules by host suffix."""
    table = df.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "r_host string, r_path string, rule string, _loam_verdict string")
    found = df.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes(F.col("host")))).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = found.groupBy("host", "path").agg(F.min_by(F.struct("rule", "_loam_verdict"), F.struct(-F.length("rule"), "_loam_verdict", "rule")).alias("best"))
    return df.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "_loam_verdict": F.col("best._loam_verdict")}).drop("best")


def _without_dots(path: Column) -> Column:
    """A path without `.` and `..`."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda p, x: F.when(x == "..", F.when(F.size(p) > 1, F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1)))).otherwise(p)).when(x == ".", p).otherwise(F.array_append(p, x)),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(ends, "/")).otherwise(path)


def absolute(link: Column, url: Column) -> Column:
    """A link as an absolute url, by the url of its page; null for other schemes, such as `mailto:`."""
    origin = F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*)", 1)
    own_path = path_of(url)
    folder = F.when(own_path.contains("/"), F.regexp_extract(own_path, r"^([\s\S]*/)", 1)).otherwise("/")
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*([\s\S]*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link))
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"^([\s\S]*?:)//", 1), link))
        .when(origin == "", F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(path == "", F.concat(origin, own_path, rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def _tag(page: Column, name: str, attribute: str) -> Column:
    """The first tag of a name that has an attribute (a pattern); empty if there is none."""
    tags = F.regexp_extract_all(page, F.lit(rf"(?i)<{name}\b[^>]*>"), 0)
    return F.coalesce(F.get(F.filter(tags, lambda t: t.rlike(rf"(?i)[\s\"']{attribute}")), 0), F.lit(""))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of the canonical link and the refresh redirect in each page's html."""
    page, link = F.col(html), lambda pattern, text: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    canonical_tag = _tag(page, "link", r"""rel\s*=\s*["']?canonical\b""")
    refresh_tag = _tag(page, "meta", r"""http-equiv\s*=\s*["']?refresh\b""")
    canonical = F.when(page.rlike("(?i)canonical"), link(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", canonical_tag))
    refresh = F.when(page.rlike("(?i)http-equiv"), link(r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", refresh_tag))
    links = pages.select(F.col(url).alias("source"), F.explode(F.array(canonical, refresh)).alias("link")).where("link is not null and source is not null")
    return links.select("source", absolute(F.col("link"), F.col("source")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict.

    edges: further (source, target) urls, such as a crawler's redirects.  Urls that differ in the
    fragment or the case of scheme and host are one.  A null url, or one without `://`, has an empty
    host and path, no alias, and is allowed unless a rule fits.  Repeated rows are judged alike; an
    empty table gives no rows.  Columns of pages with these names are replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    judged = with_rule(base.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}), rules)
    links = [page_edges(pages, url, html)] if html else []
    links += [edges.select("source", "target")] if edges is not None else []
    ends = None
    if links:
        all_links = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        ends = written(all_links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b").distinct(), "url-edges")
    if ends is not None and not ends.isEmpty():  # else each url stands for itself
        groups = components(ends, "url")
        # rules speak for the ends of edges too, whether they are pages or not
        member = with_rule(groups.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
        spread = member.groupBy("component").agg(F.min("_loam_verdict").alias("_loam_spread")).where("_loam_spread is not null")  # allow sorts before block
        aliases = groups.join(spread, "component").select(F.col("node").alias("_loam_node"), "_loam_spread")
        judged = judged.withColumn("_loam_node", node_of(F.col(url))).join(aliases, "_loam_node", "left")
    else:
        judged = judged.withColumn("_loam_spread", F.lit(None).cast("string"))
    return judged.withColumn("verdict", F.coalesce("_loam_verdict", "_loam_spread", F.lit("allow"))).drop("_loam_verdict", "_loam_spread", "_loam_node")
