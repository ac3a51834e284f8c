"""Operators against brute force, on hard cases, and on empty tables."""

import hashlib
import json
import random
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import automaton, bpe, chat, classifier, contamination, line_dedup, ngram_join, quality_rules, queries, shared, substring_dedup, tokens, urls

from .fixtures import as_dict, documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# -- 1


def components_of(rows, percent=90, k=3):
    sets = {}
    for i, x in rows:
        w = WORD.findall(low(x))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "block"), [(90, 4096), (90, 3), (70, 5)])
def test_ngram_join(spark, percent, block):
    rng = random.Random(percent + block)
    rows = texts()
    base = [f"w{k}" for k in range(120)]
    for _ in range(60):
        v = list(base)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(40)}"
        rows.append(" ".join(v))
    docs = documents(spark, rows)
    want = components_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], percent)
    got = ngram_join.join_components(docs, percent=percent, block=block)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


@pytest.mark.parametrize(("percent", "k"), [(80, 5), (90, 3)])
def test_ngram_join_of_spare_segments(spark, percent, k):
    rng = random.Random(percent)
    rows = []
    for n in (8, 25, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(n)]
            for _ in range(6):  # about as many changes as the similarity allows, in texts that share passages with others
                v = list(base)
                for _ in range(rng.randint(0, n // 36 + 1)):
                    v[rng.randrange(n)] = f"e{rng.randrange(40)}"
                rows.append(" ".join([*v, *(f"p{rng.randrange(3)}" for _ in range(n // 40))]))
    docs = documents(spark, rows)
    want = components_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], percent, k)
    got = ngram_join.join_components(docs, words=k, percent=percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_ngram_join_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(3, text), (3, text), (2, text), (None, text), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect())
    assert got == [(0, 28, None), (2, 28, 2), (3, 28, 2), (3, 28, 2), (9, 0, 9)]


@pytest.mark.parametrize("block", [4096, 1])
@pytest.mark.parametrize("empty", [None, "", " "])
def test_ngram_join_empty_row_of_a_repeated_id(spark, empty, block):
    words = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*words[:k], "new", *words[k + 1 :]])
    docs = spark.createDataFrame([(5, " ".join(words)), (5, empty), (6, near(59)), (7, near(0))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, block=block).collect())
    assert got == [(5, 0, 5), (5, 58, 5), (6, 58, 5), (7, 58, 5)]


def test_link_group_across_blocks():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, np.concatenate([a[:90], a[:9] + 1000]), np.concatenate([a[:89], a[:10] + 1000])]
    sets = [np.sort(s) for s in sets]
    found, open_ = ngram_join.link_group([1, 2, 3], sets, 0, 90, np.array([False, False, True]))
    assert found == [(3, 2)] and open_.tolist() == [1, 2]


@pytest.mark.parametrize("block_tokens", [1 << 20, 700])
def test_ngram_join_of_large_groups(spark, monkeypatch, block_tokens):
    """Crowded lists, keys dealt in many parts, and links across blocks between sets that don't link to their leader."""
    monkeypatch.setattr(ngram_join, "HELD", 500)
    rng = random.Random(block_tokens)
    base = [f"w{k}" for k in range(150)]
    rows = [" ".join(base)] * 40 + ["", None]
    for k in range(120):  # chains of texts, each a few words from the one before it
        v = list(base)
        for j in range(k % 30):
            v[(7 * j + 40 * (k // 30)) % 150] = f"c{k // 30}.{j}"
        rows.append(" ".join(v))
    rows += [" ".join(base[:100] + [f"x{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(60)]
    docs = documents(spark, rows)
    for words, percent in ((3, 90), (5, 80)):
        want = components_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], percent, words)
        got = ngram_join.join_components(docs, words=words, percent=percent, block_tokens=block_tokens)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


# -- 2


def test_chat_round_trip(spark):
    rows = [(1, 1, "user", "hi <|im_end|> <\\| <|"), (1, 0, "sys\\n\n<|im_start|>\\", ""), (1, 2, "assistant", "ok\n<|im_start|>assistant\nno\\"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "é😀")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_turns(chat.gather_turns(table)))
    got = {r["conv_id"]: r for r in back.collect()}
    assert [tuple(t) for t in got[1]["read_turns"]] == [("sys\\n\n<|im_start|>\\", ""), ("user", rows[0][3]), ("assistant", ""), ("assistant", rows[2][3])]
    assert got[1]["loss_texts"] == ["", rows[2][3]]
    assert got[1]["formatted"].count("<|im_start|>") == 4
    assert got[None]["loss_texts"] == ["é😀"]
    assert [tuple(t) for t in got[2]["read_turns"]] == [("", "x")]


def test_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"question": "q", "answer": None}, {"other": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(7, None), (8, "{")], "k long, record string")
    got = {r["k"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.to_turns(df, "record").collect()}
    assert got == {
        0: ("prompt_response", [("user", "p"), ("assistant", "r")]), 1: ("instruction_input", [("user", "i"), ("assistant", "o")]), 2: ("instruction_input", [("user", "i\nn"), ("assistant", "o")]),
        3: ("messages", [("user", "u"), ("assistant", "")]), 4: ("conversations", [("user", "u"), ("assistant", "a")]), 5: ("question_answer", [("user", "q")]), 6: (None, None), 7: (None, None), 8: (None, None),
    }
    flat = spark.createDataFrame([("a", "b", 1)], "completion string, prompt string, meta long")
    assert [tuple(t) for t in chat.to_turns(flat).first()["turns"]] == [("user", "b"), ("assistant", "a")]


# -- 3


def test_urls(spark):
    rules = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("block", "net/"), urls.Rule("allow", "net/de/")]
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    rows = [
        (1, "http://a.Example.COM/en/77?x", None), (2, "http://a.example.com/en/6", ""), (3, "http://x.org/1#f", link("http://b.net/q")), (4, "HTTP://X.org/1", "<meta http-equiv='refresh' content='0; url=/2'>"),
        (5, "http://x.org/2", None), (6, "http://y.org/", link("http://c.net/de/1")), (7, "http://y.org/", link("//d.net/z")), (8, None, None), (9, "no scheme", None), (10, "http://z.org", "canonical"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for limit in (200, 0):
        urls.INLINE_RULES, kept = limit, urls.INLINE_RULES
        try:
            got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
        finally:
            urls.INLINE_RULES = kept
        assert got[1] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
        assert got[2] == ("a.example.com", "/en/6", "com/en/", "block")
        assert [got[k][3] for k in (3, 4, 5)] == ["block"] * 3
        assert [got[k][3] for k in (6, 7)] == ["allow"] * 2  # an allow rule on an alias goes before a block rule
        assert got[8] == got[9] == ("", "", None, "allow")
        assert got[10][2:] == (None, "allow")


def test_links_of_pages(spark):
    base = "http://A.org/x/y?q=1"
    cases = {
        "z.html": "http://A.org/x/z.html", "../w": "http://A.org/w", "./v/../u?a=/../b": "http://A.org/x/u?a=/../b", "?id=3": "http://A.org/x/y?id=3", "/go?u=http://b.org": "http://A.org/go?u=http://b.org",
        "//c.org/d": "http://c.org/d", "https://e.org": "https://e.org", "mailto:x@y": None, "..": "http://A.org/", "../../..": "http://A.org/",
    }
    df = spark.createDataFrame([(k, base) for k in cases], "link string, url string")
    assert {r["link"]: r["to"] for r in df.select("link", urls.absolute(F.col("link"), F.col("url")).alias("to")).collect()} == cases
    pages = spark.createDataFrame([(base, f'<link rel="alternate" href="/no"><link {"x" * 2000} href=\'z\' REL=canonical>')], "url string, html string")
    assert [tuple(r) for r in urls.page_edges(pages).collect()] == [(base, "http://A.org/x/z")]


def test_url_query_with_aliases_equals_its_sql(spark, tmp_path):
    """The driver's pages have no such links: here blocks and allowances spread over chains of them."""
    import duckdb

    rng, rows = random.Random(12), []
    hosts = ["a.example.com", "example.net", "b.net", "c.org", "d.io", "D.io", "e.dev", "f.dev"]
    any_url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'xx'])}/{rng.randrange(9)}"
    for k in range(300):
        link = rng.choice([any_url(), any_url().replace("http:", ""), f"/es/{k % 9}", f"{k % 7}", f"?p={k % 3}", "mailto:a@b", "#top"])
        html = rng.choice(["", f'<link rel="canonical" href="{link}">', f"<META HTTP-EQUIV=refresh content='0; URL={link}'>", None])
        rows.append((k, None if k % 50 == 0 else any_url() + rng.choice(["", "?x", "#f"]), html))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.URL_SQL})").fetchall()))
    got = queries.op3_url_filters(spark, f"file://{tmp_path}")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    spread = got.where("rule is null and verdict = 'block'").count()
    assert spread > 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + k, 501 + k) for k in range(60)] + [(700, k) for k in range(701, 760)] + [(5, None)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges[:-1]:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


# -- 4


def base_counts(x):
    w, seen, dup, places = WORD.findall(x), set(), 0, defaultdict(list)
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    hit = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(hit)


def test_quality_rules(spark):
    docs = documents(spark, texts() + ["# $ a\n# $ a\nb\nb"])
    got = as_dict(quality_rules.apply_rules(docs))
    for r in docs.collect():
        want = base_counts(r["text"] or "")
        own = got[r["doc_id"]]
        assert tuple(own[c] for c in quality_rules.COUNTS) == want
        assert own["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (own["base_failed"] and own["kept"])
    short = as_dict(quality_rules.apply_rules(docs, counts=False))
    assert {k: v["kept"] for k, v in short.items()} == {k: v["kept"] for k, v in got.items()}


def test_cascade_runs_a_rule_on_survivors_only():
    import pyarrow as pa

    seen = []
    first = quality_rules.Rule("first", lambda s: s.n_words < 2)
    second = quality_rules.Rule("second", lambda s: seen.append(len(s.column)) or s.n_words > 2)
    kept = quality_rules.cascade(quality_rules.Stats(pa.array(["a", "a b", "a b c", None])), [first, second])
    assert kept.tolist() == [False, True, False, False]
    assert seen == [2]


def test_order_of_rules_counts_what_is_known_already():
    import time

    import pyarrow as pa

    def slow(s):
        s.n_words
        time.sleep(0.01)
        return s.n_words > 3

    rules = (quality_rules.Rule("slow", slow), quality_rules.Rule("quick", lambda s: s.n_words > 3), quality_rules.Rule("never", lambda s: s.n_words < 0))
    assert quality_rules.measured_order(pa.array(["a b c d e", "a", None]), rules)[0] == 1
    carried = quality_rules.Stats(pa.array(["x y", "a A\na A\nb", None, "b $ c c c"]))
    carried.n_dup_lines
    taken, fresh = carried.take(np.array([1, 3])), quality_rules.Stats(pa.array(["a A\na A\nb", "b $ c c c"]))
    assert "w" in taken.known
    for c in (*quality_rules.COUNTS, "n_capitals", "n_stutter", "n_lines"):
        assert getattr(taken, c).tolist() == getattr(fresh, c).tolist(), c


# -- 5 and 6


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = ["Ǆ ǰ'd Ʃ ŉ İ ſ", "a\x1cb\x85c", "ΣΑΣ ²³½ é", "<|startoftext|>Hi", "it's we'll 1234"]
    docs = documents(spark, texts() + extra)
    got = as_dict(tokens.count_tokens(docs, path, table_size=20, sample_rows=10))
    for r in docs.collect():
        x = r["text"] or ""
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"]) == (len(library.encode(x, add_special_tokens=False).ids), len(x.encode())), x


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = documents(spark, texts() + ["a\x1cb\x85c 　d", "ΣΑΣ ²³½ é \U0001f600", "  lead\n\n  x  "])
    got = as_dict(bpe.round_trip(docs, path, ids="ids"))
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        own = got[r["doc_id"]]
        assert own["ids"] == ids
        assert own["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = as_dict(bpe.decode(bpe.encode(docs, path), path))
    assert all(again[r["doc_id"]]["decoded"] == (r["text"] or "") for r in docs.collect())


def test_segment_tree_sizes_agree():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcdestin") for _ in range(rng.randint(1, 64))).encode() for _ in range(200)]
    assert codec._merge_rows(pieces, 64) == [codec._merge_one(p) for p in pieces]


# -- 7


def removed_of_all_lines(rows):
    """Lines that an earlier line equals, or is one word or (under 5 words) one character away from."""

    def near(a, b):
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    lines = sorted((i, n, x) for i, t in rows if t is not None and i is not None for n, x in enumerate(t.split("\n")) if WORD.search(x))
    seen, firsts, out = {}, {True: [], False: []}, defaultdict(set)
    for i, n, x in lines:
        w = x.split(" ")
        worded = len(w) >= 5
        units = w if worded else list(x)
        if x not in seen:
            seen[x] = next((o[0] for o in firsts[worded] if near(units, o[1])), None)
            firsts[worded].append(((i, n), units))
            first = seen[x]
        else:
            first = (-1, -1)  # an exact copy
        if first is not None and first != (i, n):
            out[i].add(n)
    return dict(out)


@pytest.mark.parametrize("shift", [0, 1 << 50])
def test_line_dedup(spark, shift):
    rng = random.Random(2)
    rows = texts()
    for _ in range(30):
        rows.append("\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(6)))
    docs = documents(spark, rows)
    if shift:  # ids too far apart to be packed
        docs = docs.withColumn("doc_id", F.col("doc_id") * (shift // 64))
    want = removed_of_all_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = as_dict(line_dedup.dedup_lines(docs))
    assert len(got) == len(rows)
    for r in docs.collect():
        own, gone = got[r["doc_id"]], want.get(r["doc_id"], set())
        assert own["n_removed"] == len(gone)
        if r["text"] is None:
            assert own["text"] is None
        else:
            assert own["text"] == "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone)


def test_line_dedup_repeated_rows_and_null_ids(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, line, 0), (1, line, 0), (1, line, 0), (2, "", 1)]


def test_line_dedup_of_one_id_with_different_texts(spark):
    copied = "a line that stands in the first document"
    rows = [(1, copied), (2, f"only here, in one of two\n{copied}"), (2, "first of the other row\nnothing else has this second line"), (2, "first of the other row\nnothing else has this second line"), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("own"))
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"], r["removed"]) for r in line_dedup.dedup_lines(docs).collect())
    other = (2, rows[2][1], 0, "own")
    assert got == sorted([(0, copied, 0, "own"), (1, copied, 0, "own"), (2, "only here, in one of two", 1, "own"), other, other])


def test_line_dedup_of_keys_that_coincide(spark, monkeypatch):
    """With 128 keys for all variants most candidates are none, and the true ones further on must be found."""
    monkeypatch.setattr(line_dedup, "_MASK", 127)
    rng = random.Random(8)
    docs = documents(spark, ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 7))) for _ in range(8)) for _ in range(40)])
    want = removed_of_all_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = as_dict(line_dedup.dedup_lines(docs))
    assert {k: r["n_removed"] for k, r in got.items() if r["n_removed"]} == {k: len(v) for k, v in want.items()}


def test_line_dedup_of_very_long_lines(spark):
    """Lines of a hundred thousand characters without a space, and of as many words, with one edit at each end and in the middle."""
    n = 100_000
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(n))
    many = [rng.choice(["one", "two", "three", "four"]) for _ in range(n)]
    edits = [long, "x" + long, long[: n // 2] + long[n // 2 + 1 :], long[:-1] + "y", long[::-1], long[: n // 2] + "zz" + long[n // 2 + 2 :]]
    edits += [" ".join(many), " ".join(many[:-1]), " ".join([*many[: n // 2], "five", *many[n // 2 + 1 :]]), " ".join([*many[:9], "six", "six", *many[11:]])]
    got = as_dict(line_dedup.dedup_lines(documents(spark, edits)))
    ids = {r["text"]: r["doc_id"] for r in documents(spark, edits).collect()}
    for group in (edits[:4], edits[6:9]):  # each is one edit from the first; from one another they are two
        first = ids[group[0]]
        assert all(got[ids[t]]["n_removed"] == 1 for t in group if ids[t] > first)
    assert all(got[ids[edits[k]]]["n_removed"] == 0 for k in (4, 5, 9))


def test_line_dedup_of_all_lines(spark):
    rng = random.Random(5)
    url = "https://example.org/" + "abcdefghij" * 30
    rows = texts() + [f"{url}\nAll rights reserved.\n\n \na\tb\tc\td\te\tf\nok\n日本語の文章です", f"{url}\nAll rights reserved\n\n \na\tb\tc\td\te\tf\nok\n日本語の😀章です", f"x{url[:99]}{url[100:]}\nno\na b c d e\nabcde\nabcd"]
    for _ in range(30):
        rows.append("\n".join("".join(rng.choice("ab ") for _ in range(rng.randint(1, 12))) for _ in range(6)))
    docs = documents(spark, rows)
    want = removed_of_all_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = as_dict(line_dedup.dedup_lines(docs))
    for r in docs.collect():
        own, gone = got[r["doc_id"]], want.get(r["doc_id"], set())
        assert own["text"] == (r["text"] if r["text"] is None else "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone))


def test_line_dedup_query_judges_short_lines(spark):
    folder = "/root/testdata/sf0.001"
    want = removed_of_all_lines([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    got = as_dict(queries.op7_line_dedup(spark, folder))
    assert {k: r["n_removed"] for k, r in got.items() if r["n_removed"]} == {k: len(v) for k, v in want.items()}


# -- 8


def test_classifier(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["house", "tree", "river", "walks", "under", "quiet", "sky", "above"]) for _ in range(rng.randint(30, 200))) for _ in range(80)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "###", "NOW!!"]) for _ in range(rng.randint(30, 200))) for _ in range(40)]
    docs = documents(spark, good + bad + [None, ""])
    label = {t: 1 for t in good} | {t: 0 for t in bad}
    labels = spark.createDataFrame([(r["doc_id"], label[r["text"]]) for r in docs.collect() if r["text"]], "doc_id long, quality int")
    model = classifier.train(classifier.add_statistics(docs.select("doc_id", "text")), labels)
    got = as_dict(classifier.score_texts(docs, model))
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[r["doc_id"]]["predicted"] == label[r["text"]] for r in docs.collect() if r["text"])
    other = as_dict(classifier.score(classifier.add_statistics(docs.select("doc_id", "text")), model))
    assert all(abs(other[k]["score"] - r["score"]) < 1e-9 for k, r in got.items())


def test_classifier_equals_plain_discriminant(spark):
    """The scores against a quadratic discriminant written out with numpy."""
    import pyarrow as pa

    rng = random.Random(14)
    words = ["house", "Tree", "river!", "$$", "42", "über", "a", "NOW", "quietly"]
    rows = [" ".join(rng.choices(words, weights=[1 + (k + j) % 4 for j in range(9)], k=rng.randint(1, 90))) + "\nend" * (k % 3) for k in range(160)] + [None, ""]
    docs = documents(spark, rows)
    own = docs.select("doc_id", "text").collect()
    labels = [(r["doc_id"], int(len(r["text"] or "") % 3 > 0)) for r in own]
    model = classifier.train(classifier.add_statistics(docs.select("doc_id", "text")), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = as_dict(classifier.score_texts(docs, model))
    import zlib

    x = classifier.statistics(pa.array([r["text"] for r in own], pa.string()))
    y = np.array([v for _, v in labels])
    learned = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in own])
    assert 0 < learned.sum() < len(own)
    pooled = sum(np.cov(x[learned & (y == c)].T, bias=True) * (y[learned] == c).sum() for c in (0, 1)) / learned.sum()
    density = []
    for c in (0, 1):
        z = x[learned & (y == c)]
        cov = 0.9 * np.cov(z.T, bias=True) + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        d = x - z.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(z) / learned.sum()))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    assert np.allclose([got[r["doc_id"]]["score"] for r in own], want, atol=1e-6)


def test_classifier_without_labels(spark):
    docs = documents(spark, ["a b c", None])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.train(classifier.add_statistics(docs.select("doc_id", "text")), labels)
    assert all(r["score"] == r["score"] for r in classifier.score_texts(docs, model).collect())


def test_held_out_rows_are_not_learned(spark):
    import zlib

    ids = spark.range(40).selectExpr("id as doc_id")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", classifier.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}


# -- 9


@pytest.mark.parametrize("shard_words", [500_000, 20])
def test_contamination(spark, shard_words):
    rng = random.Random(6)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = texts()
    items = [(k, " ".join((rows[12 + k] or "x").split(" ")[3:40])) for k in range(6)] + [(20, "one"), (100, "two Words"), (7, None), (8, "..."), (9, " ".join(rng.choice("abc") for _ in range(15)))]
    rows += [" ".join(rng.choice("abc") for _ in range(400)), "x one-Two words"]
    docs = documents(spark, rows)
    patterns = defaultdict(set)
    for i, x in items:
        w = word.findall(low(x))
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns[tuple(w[k : k + 13])].add(i)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = as_dict(contamination.find_contamination(docs, table, shard_words=shard_words))
    for r in docs.collect():
        w, hit, found = word.findall(low(r["text"])), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_hit"], own["items"], own["contaminated"]) == (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w))


# -- 10


def test_substring_dedup(spark):
    rng = random.Random(9)
    rows = texts()
    passage = " ".join(f"p{k}" for k in range(45))
    for k in range(25):
        rows.append(f"{' '.join(rng.choice('ab') for _ in range(30))} {k} {passage} {k} end")
    docs = documents(spark, rows)
    seen, want = set(), {}
    for r in sorted(docs.select("doc_id", "text").collect()):
        w, gone = WORD.findall(r["text"] or ""), set()
        for k in range(len(w) - 19):
            p = tuple(w[k : k + 20])
            if p in seen:
                gone.update(range(k, k + 20))
            seen.add(p)
        want[r["doc_id"]] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in as_dict(substring_dedup.remove_repeats(docs)).items()}
    assert got == want


def test_substring_dedup_of_one_id_with_different_texts(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    own = " ".join(f"u{k}" for k in range(27))
    rows = [(1, passage), (2, f"x {passage}"), (2, own), (2, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("mine"))
    got = sorted((r["doc_id"], r["kept"], r["n_removed"], r["places"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == sorted([(1, passage, 0, "mine"), (2, "x", 25, "mine"), (2, own, 0, "mine"), (2, own, 0, "mine")])


def thue_morse(n, flip=False):
    """Words that collide in every polynomial hash modulo 2 ** 64."""
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    one, other = thue_morse(1024), thue_morse(1024, True)
    text = lambda x: " ".join([*(f"w{k}" for k in range(15)), x, *(f"v{k}" for k in range(15))])
    docs = spark.createDataFrame([(1, text(one)), (2, text(other)), (3, text(one))], "doc_id long, text string")
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {k: r["n_hit"] for k, r in as_dict(contamination.find_contamination(docs, items)).items()} == {1: 1, 2: 0, 3: 1}
    assert {k: r["n_removed"] for k, r in as_dict(substring_dedup.remove_repeats(docs)).items()} == {1: 0, 2: 0, 3: 31}
    assert {k: r["component_id"] for k, r in as_dict(ngram_join.join_components(docs)).items()} == {1: 1, 2: 2, 3: 1}


def test_contamination_confirms_words_behind_hashes(spark, monkeypatch):
    from loam.llm import words

    hashed = words.span_hash
    monkeypatch.setattr(words, "span_hash", lambda d, a, b: hashed(d, a, b) % np.uint64(3))
    tables = contamination.build_tables(["a b c d", "e"], 13)
    import pyarrow as pa

    n, places, items = contamination.search(pa.array(["a b c d", "d c b a", "f g h i j k l e"]), tables)
    assert [p.tolist() for p in places] == [[0, 1, 2, 3], [], [7]] and [x.tolist() for x in items] == [[0], [], [1]]


def test_substring_dedup_of_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    text = " ".join(f"w{k % 70}" for k in range(300))
    docs = spark.createDataFrame([(2, text), (2, text), (1, "x " + text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    # words 70 on repeat those before; document 2 stands in document 1 as a whole; a null id is left alone
    assert got == [(0, 300, 0), (1, 301, 230), (2, 300, 300), (2, 300, 300)]


@pytest.mark.parametrize("shard_words", [100_000, 40])
def test_suffix_automata_of_a_reference(spark, shard_words):
    rng = random.Random(11)
    reference = [" ".join(rng.choice("abc") for _ in range(n)) for n in (3, 30, 30, 50, 80)] + [None, ""]
    rows = [None, ""] + [" ".join([rng.choice("abc") for _ in range(10)] + (reference[rng.randrange(5)].split(" ") * 2)[k : k + 35] + ["z"]) for k in range(30)]
    docs = documents(spark, rows)
    got = as_dict(automaton.remove_referenced(docs, spark.createDataFrame([(x,) for x in reference], "text string"), min_words=8, shard_words=shard_words))
    grams = {tuple(w[k : k + 8]) for x in reference if x for w in [x.split(" ")] for k in range(len(w) - 7)}
    for r in docs.collect():
        w, gone = WORD.findall(r["text"] or ""), set()
        for k in range(len(w) - 7):
            if tuple(w[k : k + 8]) in grams:
                gone.update(range(k, k + 8))
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_removed"], own["kept"]) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


# -- all


def test_empty_tables(spark):
    docs = documents(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert ngram_join.join_components(docs).count() == 0
    assert chat.read_back(chat.format_turns(chat.gather_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), [urls.Rule("block", "net/")]).count() == 0
    assert quality_rules.apply_rules(docs).count() == 0
    assert tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bpe.round_trip(docs, path).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert classifier.add_statistics(docs.select("doc_id", "text")).count() == 0
    assert contamination.find_contamination(docs, benchmark).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    full = documents(spark, ["a b c", None])
    assert sorted((r["n_words"], r["n_hit"]) for r in contamination.find_contamination(full, benchmark).collect()) == [(0, 0), (3, 0)]


def test_ngram_join_takes_one_plan_at_every_size(spark):
    """op1_ngram_jaccard: the texts were shuffled on large tables only, so that growth was told from two plans."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d e")], "doc_id long, text string")
    ids = spark.createDataFrame([(2, "x")], "id long, tasks string")
    got = ngram_join._tokens(docs, ids, "doc_id", "text", 3)
    assert [(r["id"], r["tasks"], len(r["tokens"])) for r in got.collect()] == [(2, "x", 16)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
