"""Quality rules as a short-circuit cascade.

Every rule reads columns of cheap per-document statistics and says which documents fail.  The cost
of a rule (the statistics that aren't known yet when its turn comes, and its own test) and its
selectivity among the documents that are left are measured on a bounded sample; the cascade then runs
rules by rejections per second, and each rule sees only the documents that all earlier ones let
pass.  The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Texts in the sample that costs and selectivities are measured on, about, and bytes of them all together: texts are added up to there.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 25

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITAL = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


class Stats:
    """Statistics of a chunk of texts, each computed when a rule first asks for it."""

    def __init__(self, column: pa.Array):
        self.column, self.known = column, {}

    def __getattr__(self, name: str):
        if name.startswith("_") or name in ("column", "known"):
            raise AttributeError(name)
        if name not in self.known:
            self.known[name] = getattr(self, f"_{name}")()
        return self.known[name]

    def _w(self):
        return W.words_of(self.column)

    def _per_doc(self, at: np.ndarray, weight=None) -> np.ndarray:
        doc = np.searchsorted(self.w.offsets, at, side="right") - 1
        return np.bincount(doc, weights=weight, minlength=len(self.column)).astype(np.int64)

    def _sum(self, byte_class: np.ndarray) -> np.ndarray:
        return self._per_doc(np.flatnonzero(byte_class[self.w.data]))

    def _n_words(self):
        return self.w.counts.astype(np.int64)

    def _word_chars(self):
        return self._sum(W.SPACED & ~_CONTINUES)

    def _n_symbols(self):
        return self._sum(SYMBOLS)

    def _n_capitals(self):
        return self._sum(_CAPITAL)

    def _lines(self):
        """(document, hash) of every line that has a word."""
        w = self.w
        breaks = np.flatnonzero(w.data == 10)
        edges = np.union1d(np.concatenate([[0], breaks + 1]), w.offsets[:-1])
        line = np.searchsorted(edges, w.start, side="right") - 1
        used = np.unique(line)
        start = edges[used]
        doc = np.searchsorted(w.offsets, start, side="right") - 1
        stops = np.union1d(breaks, w.offsets[1:])
        end = stops[np.searchsorted(stops, start, side="right")]
        return doc, W.span_hash(w.data, start, end)

    def _n_dup_lines(self):
        doc, h = self.lines
        order = W.sort_within(doc, h)
        again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
        return np.bincount(doc[order][1:][again], minlength=len(self.column)).astype(np.int64)

    def _n_lines(self):
        return np.bincount(self.lines[0], minlength=len(self.column)).astype(np.int64)

    def _n_repeat_words(self):
        w, k = self.w, 8
        at, h = w.windows(k)
        order = W.sort_within(w.doc[at], h)
        d, g = w.doc[at][order], h[order]
        same = (d[1:] == d[:-1]) & (g[1:] == g[:-1])
        hit = np.zeros(len(g), bool)
        hit[1:] |= same
        hit[:-1] |= same
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, at[order][hit], 1)
        np.add.at(step, at[order][hit] + k, -1)
        return np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=len(self.column)).astype(np.int64)

    def _n_stutter(self):
        """Words equal to the word before."""
        w = self.w
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        return np.bincount(w.doc[1:][same], minlength=len(self.column)).astype(np.int64)

    def take(self, rows: np.ndarray) -> Stats:
        """The statistics of some rows; what is known is carried over."""
        out = Stats(self.column.take(pa.array(rows)))
        out.known = {k: v[rows] for k, v in self.known.items() if isinstance(v, np.ndarray)}
        if "w" in self.known:
            out.known["w"] = self.known["w"].take(rows, out.column)
        if "lines" in self.known:
            doc, h = self.known["lines"]
            place = np.full(len(self.column), -1)
            place[rows] = np.arange(len(rows))
            out.known["lines"] = place[doc][place[doc] >= 0], h[place[doc] >= 0]
        return out


@dataclass(frozen=True)
class Rule:
    """A rule and what it fails: a boolean array over the chunk's documents."""

    name: str
    fails: Callable[[Stats], np.ndarray]


#: The rules that every text must pass, then those of this method.
BASE = (
    Rule("too_short", lambda s: s.n_words < 20),
    Rule("repeats_itself", lambda s: 100 * s.n_repeat_words > 30 * s.n_words),
)
METHOD = (
    Rule("symbols", lambda s: 100 * s.n_symbols > 20 * np.maximum(s.n_words, 1)),
    Rule("shouting", lambda s: 100 * s.n_capitals > 40 * np.maximum(s.word_chars, 1)),
    Rule("stutter", lambda s: 100 * s.n_stutter > 20 * np.maximum(s.n_words, 1)),
    Rule("duplicate_lines", lambda s: (s.n_lines >= 4) & (100 * s.n_dup_lines > 50 * s.n_lines)),
    Rule("word_length", lambda s: (s.word_chars > 25 * np.maximum(s.n_words, 1)) | (s.word_chars < 2 * s.n_words)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_order(sample: pa.Array, rules: tuple[Rule, ...], known: tuple[str, ...] = ()) -> list[int]:
    """Indexes of rules, each time the one of most rejections per second among the sample's documents that are left.

    known: statistics that are there anyway.  What an earlier rule has computed costs a later one nothing."""
    left, order, rest = Stats(sample), [], list(range(len(rules)))
    for c in known:
        getattr(left, c)
    while rest and len(left.column):
        gain = []
        for k in rest:
            trial = Stats(left.column)
            trial.known = dict(left.known)
            began = time.perf_counter()
            fails = rules[k].fails(trial)
            gain.append((-int(fails.sum()) / (time.perf_counter() - began), k, trial, fails))
        _, k, trial, fails = min(gain, key=lambda g: g[:2])
        order.append(k)
        rest.remove(k)
        left = trial.take(np.flatnonzero(~fails))
    return order + rest


def cascade(stats: Stats, rules: list[Rule]) -> np.ndarray:
    """Which documents pass all rules; a rule is run only on those that are left."""
    alive, left = np.arange(len(stats.column)), stats
    for rule in rules:
        if not len(alive):
            break
        passed = np.flatnonzero(~rule.fails(left))
        if len(passed) < len(alive):
            alive, left = alive[passed], left.take(passed)
    kept = np.zeros(len(stats.column), bool)
    kept[alive] = True
    return kept


def _sampled(texts: DataFrame, rows: int) -> pa.Array:
    """About so many texts from all over the table, whole ones and long ones among them; fewer if they are large."""
    some = texts.sample(min(1.0, rows / max(texts.count(), 1)), seed=1)
    kept, size = [], 0
    for r in some.limit(2 * rows).toLocalIterator():
        size += len(r[0] or "")
        if kept and size > SAMPLE_BYTES:
            break
        kept.append(r[0])
    return pa.array(kept, pa.string())


def apply_rules(docs: DataFrame, text: str = "text", counts: bool = True, rules: tuple[Rule, ...] = METHOD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A null or empty text has no words and fails; repeated rows are judged alike; an empty table gives
    no rows.  Columns of docs with these names are replaced.  A document that fails a rule is never given
    to the later ones; with counts=False only base_failed and kept are made, and no statistic is
    computed for it that no rule before asked for.
    """
    sample = _sampled(docs.select(text), sample_rows)
    known = COUNTS if counts else ()
    base = [BASE[k] for k in measured_order(sample, BASE, known)]
    passed = sample.take(pa.array(np.flatnonzero(cascade(Stats(sample), base)))) if len(sample) else sample
    ordered = [rules[k] for k in measured_order(passed, rules, known)]
    names = [*(COUNTS if counts else ()), "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            stats = Stats(part.column(text))
            made = [getattr(stats, c) for c in COUNTS] if counts else []
            passed = cascade(stats, base)
            kept = np.zeros(len(passed), bool)
            alive = np.flatnonzero(passed)
            if len(alive):
                kept[alive] = cascade(stats.take(alive), ordered)
            columns = [part.column(c) for c in keep] + [pa.array(x) for x in [*made, ~passed, kept]]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    schema = docs.select(keep).schema
    for c in names:
        schema = schema.add(c, "boolean" if c in ("base_failed", "kept") else "long")
    return docs.select(keep).mapInArrow(run, schema)
