"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import bpe, chat, classifier, contamination, fill_middle, filter_audit, line_dedup, lm_scoring, ngram_join, quality_rules, substring_dedup, tokens, urls


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = tuple(
    urls.Rule(verdict, text)
    for verdict, text in (
        ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
    )
)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    gathered = chat.gather_turns(rows).select("conv_id", F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")).alias("record"))
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.struct(F.lit(says).alias("prompt"), F.lit(says).alias("response")).alias("record"))
    turns = chat.to_turns(gathered, "record").select("conv_id", "turns").unionByName(chat.to_turns(extra, "record").select("conv_id", "turns"))
    back = chat.read_back(chat.format_turns(turns))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(classifier.add_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "stats")
    model = classifier.train(stats, table(spark, sf_dir, "labels"))
    return classifier.score(stats, model).select("doc_id", classifier.held_out().alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit_documents(docs, table(spark, sf_dir, "labels"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), training)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": JACCARD_SQL, "op2_chat_formatting": CHAT_SQL, "op3_url_filters": URL_SQL, "op4_quality_rules": RULES_SQL,
        "op9_decontamination": CONTAMINATION_SQL, "op10_substring_dedup": PASSAGES_SQL, "op11_filter_audit": AUDIT_SQL, "op13_fill_middle": MIDDLE_SQL,
    }


_SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOW.format("text"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 3) x
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 2
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED.format("text")} AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM d),
g AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before, string_agg(word, ' ') OVER fr AS win, count(*) OVER fr AS n FROM w
  WINDOW fr AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
t AS (SELECT doc_id, i, word, before, CASE WHEN n = 8 AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS twice FROM g),
c AS (SELECT doc_id, i, word, before, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM t),
cw AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(hit) AS BIGINT) AS n_repeat_words, count(*) FILTER (word = before) AS n_stutter FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN cw ON cw.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * greatest(n_words, 1) OR 100 * n_capitals > 40 * greatest(word_chars, 1) OR 100 * n_stutter > 20 * greatest(n_words, 1)
    OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) OR word_chars > 25 * greatest(n_words, 1) OR word_chars < 2 * n_words) AS kept
FROM a
"""

_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOW.format("text"))} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOW.format("text"))} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0) x),
w AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, size, ws, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM p) s WHERE len(ws) >= size) x),
h AS (SELECT w.doc_id, w.i, w.size, p.item_id FROM w JOIN p ON p.win = w.win AND p.size = w.size),
k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM h) y) x GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

PASSAGES_SQL = f"""
WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT doc_id, {_SPACED.format("text")} AS ws FROM documents) x),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER fr AS win, count(*) OVER fr AS n FROM w WINDOW fr AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM g WHERE n = 20),
c AS (SELECT w.doc_id, w.i, w.word, max(CASE WHEN f.k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.i = w.i),
s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

URL_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), f AS (
  SELECT u.page_id, u.url, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
), t AS (
  SELECT url, host, path, regexp_extract(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)[\s"'']rel\s*=\s*["'']?canonical\b'))[1], '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM u
  UNION ALL
  SELECT url, host, path, regexp_extract(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)[\s"'']http-equiv\s*=\s*["'']?refresh\b'))[1], '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM u
), l AS ( -- links without . and .. in their paths
  SELECT url AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link END
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^([\s\S]*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^([\s\S]*?://[^/?#]*)', 1) || link
    WHEN regexp_matches(link, '^[?#]') THEN regexp_extract(url, '^([\s\S]*?://[^?#]*)', 1) || link
    ELSE regexp_extract(url, '^([\s\S]*?://[^/?#]*)', 1) || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^([\s\S]*/)', 1) ELSE '/' END || link END AS b
  FROM t WHERE link <> ''
), n AS (
  SELECT DISTINCT v, translate(regexp_extract(v, '^([^#]*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(v, '^[^#]*?://[^/?#]*([^#]*)', 1) AS node
  FROM (SELECT a AS v FROM l UNION SELECT b FROM l UNION SELECT url FROM u) x WHERE regexp_matches(v, '^[^#]*?://')
), e AS (
  SELECT x.node AS a, y.node AS b FROM l JOIN n x ON x.v = l.a JOIN n y ON y.v = l.b UNION SELECT y.node, x.node FROM l JOIN n x ON x.v = l.a JOIN n y ON y.v = l.b
), c AS (SELECT a AS node, a AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.other),
h AS (SELECT DISTINCT other, regexp_extract(other, '://([^/?]*)', 1) AS host, regexp_extract(other, '://[^/?]*([^?]*)', 1) AS path FROM c),
j AS (SELECT h.other, r.verdict, row_number() OVER (PARTITION BY h.other ORDER BY length(r.host || r.path) DESC) AS k FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)),
s AS (SELECT c.node, min(j.verdict) AS verdict FROM c JOIN j ON j.other = c.other AND j.k = 1 GROUP BY c.node)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, s.verdict, 'allow') AS verdict FROM f LEFT JOIN n ON n.v = f.url LEFT JOIN s ON s.node = n.node WHERE f.k = 1
"""

AUDIT_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_SPACED.format("text")} AS ws FROM documents),
u AS (SELECT text AS same, min(doc_id) AS least FROM t GROUP BY text),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > u.least THEN 16 ELSE 0 END AS fails
  FROM t JOIN u ON u.same = t.text LEFT JOIN m ON m.doc_id = t.doc_id
),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, f WHERE NOT contains(filter_order, c)),
s AS (
  SELECT o.filter_order, k.step, f.bit, (SELECT coalesce(sum(x.bit), 0) FROM f x WHERE contains(substr(o.filter_order, 1, k.step - 1), x.c)) AS before
  FROM o, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS step) k JOIN f ON true WHERE length(o.filter_order) = 5 AND f.c = substr(o.filter_order, k.step, 1)
),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & CAST(before AS INTEGER) = 0 AND fails & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & CAST(before AS INTEGER) = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & CAST(before AS INTEGER) > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & CAST(before AS INTEGER) = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & CAST(before AS INTEGER) = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR h1 IS NULL OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
