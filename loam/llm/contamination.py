"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of benchmark items (an item of fewer words is one
pattern).  For patterns of one length m, a text is read at window ends: the block of the last two
words there gives a shift from the block table; a positive shift skips that many places at once, and
shift 0 leads to the bucket of patterns with this suffix block, which are compared directly.  Many
places are read side by side as lanes of a numpy step, each lane skipping on its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..session import written

#: Words of benchmark texts in one broadcast set of tables, at most (about 100 bytes a word); more are searched in further passes.
SHARD_WORDS = 500_000
_LANE = 256


class Table:
    """Shift and bucket tables of all patterns of one length; words are 64-bit hashes, and behind them their bytes."""

    def __init__(self, patterns: np.ndarray, items: list[np.ndarray], words: list[tuple[bytes, ...]]):
        """patterns: one row of word hashes each, distinct; items: the item numbers that hold it; words: its words."""
        self.m = patterns.shape[1]
        self.block = min(2, self.m)
        keys, shifts = [], []
        for end in range(self.block - 1, self.m):
            keys.append(self._key(patterns, end))
            shifts.append(np.full(len(patterns), self.m - 1 - end))
        keys, shifts = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, self.shifts = keys[first], shifts[first]
        self.default = self.m - self.block + 1
        suffix = self._key(patterns, self.m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.patterns = patterns[self.order]
        self.items = [items[k] for k in self.order]
        self.words = [words[k] for k in self.order]

    def _key(self, rows: np.ndarray, end: int) -> np.ndarray:
        return rows[:, end] if self.block == 1 else W.join_hash(rows[:, end - 1], rows[:, end])

    def confirmed(self, w: W.Words, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which of the occurrences that find() gives have the pattern's own words, byte for byte."""
        raw, same = w.data.tobytes() if len(ends) else b"", np.ones(len(ends), bool)
        for k, (end, pattern) in enumerate(zip(ends.tolist(), found.tolist(), strict=True)):
            first = end - self.m + 1
            same[k] = all(raw[a:b] == own for a, b, own in zip(w.start[first : end + 1].tolist(), w.end[first : end + 1].tolist(), self.words[pattern], strict=True))
        return same

    def find(self, h: np.ndarray, block: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end place, pattern) of all occurrences.  h: word hashes; block: block hash ending at each
        place; first and stop: for every lane, the first window end and the place after the last."""
        ends, found, at = [], [], first.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            here = at[live]
            k = np.minimum(np.searchsorted(self.keys, block[here]), len(self.keys) - 1)
            shift = np.where(self.keys[k] == block[here], self.shifts[k], self.default)
            test = here[shift == 0]
            if len(test):
                a = np.searchsorted(self.suffix, block[test], side="left")
                b = np.searchsorted(self.suffix, block[test], side="right")
                place = np.repeat(test, b - a)
                pattern = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(place))
                for j in range(self.m):  # direct comparison, the farthest word first
                    same = h[place - self.m + 1 + j] == self.patterns[pattern, j]
                    place, pattern = place[same], pattern[same]
                ends.append(place)
                found.append(pattern)
            at[live] = here + np.maximum(shift, 1)
            live = live[at[live] < stop[live]]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))


def build_tables(texts: list[str], window: int = 13) -> list[Table]:
    """Tables for the items, by pattern length; item numbers are places in texts."""
    w = W.words_of(pa.array(texts, pa.string()), W.ALNUM, lower=True)
    raw, first, patterns = w.data.tobytes(), w.first(), defaultdict(lambda: defaultdict(set))
    words = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    for item in range(len(texts)):
        own = words[first[item] : first[item + 1]]
        for k in range(max(1, len(own) - window + 1) if own else 0):
            patterns[min(window, len(own))][tuple(own[k : k + window])].add(item)
    code = dict(zip(words, w.hash.tolist(), strict=True))
    hashes = lambda found: np.array([[code[x] for x in p] for p in found], np.uint64)
    return [Table(hashes(found), [np.array(sorted(x)) for x in found.values()], list(found)) for _, found in sorted(patterns.items())]


def search(column: pa.Array, tables: list[Table]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For a chunk of texts: word counts, each text's places of hit words, and its item numbers."""
    w = W.words_of(column, W.ALNUM, lower=True)
    first, n = w.first(), len(w.hash)
    step, items = np.zeros(n + 1, np.int64), [[] for _ in range(len(column))]
    for t in tables:
        if n < t.m:
            continue
        block = w.hash if t.block == 1 else np.concatenate([np.zeros(1, np.uint64), W.join_hash(w.hash[:-1], w.hash[1:])])
        # a lane is a stretch of window ends in one text; long texts have many, so none is waited for
        lanes = np.maximum(0, -(-(np.diff(first) - t.m + 1) // _LANE))
        doc = np.repeat(np.arange(len(lanes)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(lanes)[:-1]]), lanes)
        start = first[doc] + t.m - 1 + k * _LANE
        ends, found = t.find(w.hash, block, start, np.minimum(start + _LANE, first[doc + 1]))
        sure = t.confirmed(w, ends, found)
        ends, found = ends[sure], found[sure]
        np.add.at(step, ends - t.m + 1, 1)
        np.add.at(step, ends + 1, -1)
        for d, p in set(zip(w.doc[ends].tolist(), found.tolist(), strict=True)):
            items[d].append(t.items[p])
    hit = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    cut = np.searchsorted(hit, first)
    places = [hit[cut[d] : cut[d + 1]] - first[d] for d in range(len(column))]
    return np.diff(first), places, [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in items]


def shards_of(benchmark: DataFrame, item: str, text: str, shard_words: int) -> Iterator[tuple[list, list[str]]]:
    """Blocks of items of a bounded number of words, read one block at a time through the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(row[1]) // 2 + 1
        if ids and size + n > shard_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if ids:
        yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (sorted strings of item ids) and contaminated.

    contaminated: share * n_hit >= n_words and n_hit > 0.  Null or empty texts have no words and no
    hits; repeated items count by their id, repeated rows are judged alike, an empty benchmark hits
    nothing.  Columns of docs with these names are replaced.  The search tables of at most
    shard_words benchmark words are sent to the tasks at once; a larger benchmark takes further
    passes of the same job, each over all documents, and the hit words of the passes are united.
    """
    names = ["n_words", "n_hit", "items", "contaminated"]
    found = docs.drop(*names).withColumns({"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "_loam_at": F.array().cast("array<int>")})
    passes = 0
    for ids, texts in shards_of(benchmark, item, item_text, shard_words):
        found = _pass(written(found, "contamination") if passes else found, text, ids, build_tables(texts, window))
        passes += 1
    if not passes:  # the words still count
        found = _pass(found, text, [], [])
    return found.withColumn("n_hit", F.size("_loam_at").cast("long")).drop("_loam_at").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _pass(docs: DataFrame, text: str, ids: list, tables: list[Table]) -> DataFrame:
    """One search over all documents; its hits are united with those that docs already has."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array([str(x) for x in ids], dtype=object), tables))
    keep = [c for c in docs.columns if c not in ("n_words", "items", "_loam_at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = sent.value
        for part in W.chunks(batches, text):
            n, places, items = search(part.column(text), own)
            listed = [sorted({*old, *names[new].tolist()}) for old, new in zip(part.column("items").to_pylist(), items, strict=True)]
            at = [np.union1d(old, new) if old else new for old, new in zip(part.column("_loam_at").to_pylist(), places, strict=True)]
            made = [pa.array(n, pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "n_words", "items", "_loam_at"])

    schema = docs.select(keep).schema.add("n_words", "long").add("items", T.ArrayType(T.StringType())).add("_loam_at", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)
