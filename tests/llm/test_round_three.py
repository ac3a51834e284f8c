"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import elias_fano, fill_middle, filter_audit, lm_scoring

from .fixtures import documents, texts, words

LONG = 300_000


def long_text():
    rng = random.Random(5)
    return "\n".join(words(rng, 9) for _ in range(LONG // 40)) + " " + "x" * LONG + "\n\n"


def audited(rows, labels):
    """(part, order, step) -> figures, straight from the definition."""
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        docs.append((lang or "", fails, i is not None and good[i], i is not None and toxic[i]))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [d for d in left if d[1][c]]
                left = [d for d in left if not d[1][c]]
                failing = [d for d in own if d[1][c]]
                unique = sum(sum(d[1].values()) == 1 for d in failing)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), unique, sum(d[2] for d in gone), sum(d[3] for d in gone), c]
                shapley[part, c] += len(gone)
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts())]
    many = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(6)]
    rows += [(100 + k, rng.choice(many) + rng.choice(["", " #", " A" * 60]), rng.choice(["en", "de"])) for k in range(60)]
    rows += [(7, many[0], "en"), (7, many[0], "en"), (None, many[0], "de"), (500, long_text(), "en"), (None, None, None)]
    return rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 160, 2)] + [(100, 1, 1), (100, 0, None), (101, None, 1), (None, 1, 1)]


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "'x' as part", "2 as kept")
    found = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == COLUMNS
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == audited(rows, labels)


def test_filter_audit_overall_and_empty(spark):
    rows, labels = audit_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    both = filter_audit.audit_documents(docs, marks, overall=True).where("part is null").collect()
    want = audited([(i, t, "all") for i, t, _ in rows], labels)
    assert {("all", *r[1:3]): tuple(r[3:]) for r in both} == want
    assert filter_audit.audit_documents(docs.limit(0), marks).count() == 0
    none = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit_documents(docs, marks.limit(0)).collect()}
    assert none == audited(rows, [])


def test_filter_audit_other_filters(spark):
    found = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 1), ("p", False, False, 5, 2, 0)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r[3:]) for r in filter_audit.audit(found, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 3, 1, 1, 8), ("XY", 2): (5, 0, 2, 0, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 0, 1, 2), ("YX", 2): (5, 3, 2, 3, 1, 0, 8)}
    with pytest.raises(ValueError):
        filter_audit.audit(found, "XX")


def test_elias_fano_successors():
    rng = np.random.default_rng(0)
    for n, top in ((0, 0), (1, 0), (1, 10), (5, 5), (700, 10), (700, 10**6), (900, 10**12), (64, 63), (100, 0)):
        values = np.sort(rng.integers(0, top + 1, n))
        s = elias_fano.EliasFano.of(values)
        assert (s.get(np.arange(n)) == values).all()
        x, begin = rng.integers(0, top + 5, 300), rng.integers(0, n + 1, 300)
        end = np.array([rng.integers(b, n + 1) for b in begin])
        want = [next((i for i in range(b, e) if values[i] >= y), e) for y, b, e in zip(x, begin, end, strict=True)]
        assert s.successor(x, begin, end).tolist() == want
        held = [set(values[b:e].tolist()) for b, e in zip(begin, end, strict=True)]
        at = s.place(x, begin, end)
        assert [i >= 0 for i in at.tolist()] == [y in h for y, h in zip(x.tolist(), held, strict=True)]
        assert (values[at[at >= 0]] == x[at >= 0]).all()
        if n > 1:
            i = np.arange(n - 1)
            assert all((a == b).all() for a, b in zip(s.pair(i), (values[:-1], values[1:]), strict=True))


def test_trie_level_is_mapped_and_found():
    import tempfile

    rng = random.Random(2)
    counts = Counter((rng.randrange(40), rng.randrange(1000)) for _ in range(3000))
    keys = sorted(counts)
    context, successor, count = (np.array(c) for c in zip(*[(*k, counts[k]) for k in keys], strict=True))
    total = np.bincount(context, weights=count).astype(int)[context]
    with tempfile.TemporaryFile() as file:
        level = elias_fano.Level.load(file, elias_fano.Level.of(context, successor, count, total, 0.75).save(file))
        asked = np.array([(c, s) for c in range(45) for s in range(0, 1005, 7)])
        begin, end, base = level.ranges(asked[:, 0])
        at = level.find(begin, end, base, asked[:, 1])
        assert [keys[i] if i >= 0 else None for i in at.tolist()] == [k if k in counts else None for k in map(tuple, asked.tolist())]
        p = elias_fano.probability(level.codes[np.arange(len(keys))].astype(int))
        assert np.allclose(p, (count - 0.75) / total, rtol=4e-4)


def model_scores(rows, training, order, d=lm_scoring.DISCOUNT):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [" end"], training(i)) for i, t in rows]
    grams, total, followers = Counter(), Counter(), Counter()
    for _, ws, train in docs:
        if train:
            s = [" end", *ws]
            for k in range(1, order + 1):
                for j in range(1, len(s)):
                    if j - k + 1 >= (0 if k > 1 else 1):
                        grams[tuple(s[j - k + 1 : j + 1])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    for g, c in grams.items():
        if len(g) > 1:
            total[g[:-1]] += c
            followers[g[:-1]] += 1
    out = []
    for i, ws, train in docs:
        s, base, score, known = [" end", *ws], 0.0, 0.0, 0
        for j in range(1, len(s)):
            c = grams[s[j],]
            p = (c + 0.1) / (n + 0.1 * (v + 1))
            base, known = base + math.log10(p), known + (c > 0)
            for k in range(2, order + 1):
                g = tuple(s[max(0, j - k + 1) : j + 1])
                if len(g) == k and total[g[:-1]]:
                    p = max(grams[g] - d, 0) / total[g[:-1]] + d * followers[g[:-1]] / total[g[:-1]] * p
            score += math.log10(p)
        out.append((i, not train, len(ws), known, n, base, score))
    return out


@pytest.mark.parametrize(("order", "chunk", "part", "spread"), [(3, 8 << 20, 2 << 20, 64), (2, 500, 50, 64), (4, 900, 300, 10**6), (3, 400, 100, 5)])
def test_lm_scores(spark, monkeypatch, order, chunk, part, spread):
    monkeypatch.setattr(lm_scoring, "SPREAD", spread)
    rng = random.Random(4)
    rows = list(enumerate(texts())) + [(300, None), (300, "The the THE of"), (None, "the of and")]
    rows += [(400 + k, " ".join(rng.choice(["a b c", "a b d", "x y", "Z"]) for _ in range(30))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as held", "5 as chunk").repartition(3)
    trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    found = lm_scoring.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, order=order, chunk_bytes=chunk, part_tokens=part).collect()
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    got, want = sorted(map(tuple, found), key=key), sorted(model_scores(rows, trains, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(abs(a[6] - b[6]) < a[2] / elias_fano.UNITS for a, b in zip(got, want, strict=True))


def test_lm_scores_of_nothing_learned_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id int, text string")
    assert lm_scoring.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert [tuple(r) for r in lm_scoring.score_texts(docs, F.lit(False)).orderBy("doc_id").collect()] == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    rows = [(1, long_text()), (2, long_text()), (3, "a")]
    got = sorted(map(tuple, lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 2).collect()))
    want = model_scores(rows, lambda i: i != 2, 3)
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-4)
    with pytest.raises(ValueError):
        lm_scoring.score_texts(docs, F.lit(True), order=1)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.empty(0, np.int64), np.zeros(5, np.int64), rng.integers(0, 2**62, 100), np.array([255, 256])]
    assert [a.tolist() for a in lm_scoring.unpack(lm_scoring.pack(*arrays))] == [a.tolist() for a in arrays]


def filled(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, 7), (60, 20, 1)])
def test_fill_in_middle(spark, rate, spm, seed):
    rows = texts() + ["a <P> b", "x\n<M>", "<S", "\n", "\n\n\n", "a\nb", "<\n<P", "é\nü\n日本\n\n", long_text(), None]
    docs = spark.createDataFrame([(i, t, "n", -1) for i, t in enumerate(rows)] + [(5, "again\nand\nagain", "n", 0), (None, "a\nb", "n", 0)], "doc_id long, text string, form string, c0 int")
    found = fill_middle.fill_in_middle(docs, rate=rate, spm=spm, seed=seed)
    assert found.columns == ["doc_id", "text", "c0", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect():
        assert tuple(r[3:8]) == filled(r["doc_id"], r["text"], rate, spm, seed)
        assert r["back"] == (r["text"] or "")
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_ranked_bits():
    rng = random.Random(6)
    for width in (1, 2, 63, 64, 65, 1000, 4097):
        bits = rng.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [fill_middle.ranked_bit(bits, k, width) for k in range(len(places))] == places


def test_fixture_documents_keep_clashing_columns(spark):
    docs = documents(spark)
    assert fill_middle.fill_in_middle(docs).columns[: len(docs.columns)] == docs.columns


def test_numbers_of_words_and_packed_arrays():
    """op12: hashes that differ in their last bits only, and arrays of every width."""
    from loam.llm import lm_scoring as L

    rng = np.random.default_rng(3)
    near = np.array([8, 9, 8, 1 << 63, 10, (1 << 63) + 1, 9], np.uint64)
    for hashes in (near, rng.integers(0, 1 << 63, 500, np.uint64)[rng.integers(0, 500, 4000)], near[:1], near[:0]):
        want = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)[1:]
        assert [x.tolist() for x in L._different(hashes)] == [x.tolist() for x in want]
    arrays = [np.array(x, np.int64) for x in ([], [0, 0], [255, 1], [256, 0, 3], [1 << 40, 7], [(1 << 63) - 1, 5], [1 << 56])]
    assert [x.tolist() for x in L.unpack(L.pack(*arrays))] == [x.tolist() for x in arrays]
    assert [x.tolist() for x in L.unpack(L.pack(*arrays), 3)] == [x.tolist() for x in arrays[:3]]
    data = np.frombuffer(b"one three  two", np.uint8)
    assert L._spaced(data, np.array([4, 0]), np.array([5, 3])) == b" three one" and L._spaced(data, np.array([], int), np.array([], int)) == b""
