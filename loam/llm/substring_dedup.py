"""Exact removal of passages that stand earlier in the corpus.

A window is a run of 20 words.  Its anchor is the 10-word run inside it of least hash, so that equal
windows have equal anchors at the same place, and neighbouring windows mostly share one.

1. Anchors (one word in six or so) are dealt by hash; an anchor that occurs once rules its windows out.
2. The windows that are left are dealt by hash; of each, all but the earliest occurrence go.
3. Each document drops the words that its removed windows cover.

Anchors and windows travel as packed arrays, one row for each task and bucket.  What occurs more
than once within a task is settled there: only its earliest occurrence travels on, so that a passage
that a large part of the corpus shares makes no hot bucket.  Windows are the same if 96 bits of hash are
(of two independent hashes of the words): at 10 ** 13 windows 0.001 pairs of others are expected to be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import told_apart

WINDOW = 20
#: Occurrences that a task holds before it deals them out.
HELD = 1 << 18
#: Bytes of text whose occurrences make one bucket, which a task holds.
BUCKET_BYTES = 32 << 20

_DEALT = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("hashes", "checks", "docs", "places"))])
_PACKED = T.StructType([f for f in _DEALT.fields if f.name not in ("hashes", "checks")])
_FOUND = T.StructType([T.StructField("_loam_id", T.LongType()), T.StructField("_loam_places", T.ArrayType(T.IntegerType()))])


def anchors(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, word at which its anchor starts, anchor hash by word)."""
    run = (window + 1) // 2
    span = window - run + 1  # anchors to choose from
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = W.run_hash(w.hash, run)
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size * 2 <= span:
        value, place = _least(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    if size < span:
        value, place = _least(value[: n], place[: n], value[span - size :][: n], place[span - size :][: n])
    start = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    return start, place[start], hashes


def _least(a, at_a, b, at_b):
    """The lesser values with their places, the left one of equal ones."""
    left = a <= b
    return np.where(left, a, b), np.where(left, at_a, at_b)


def _in_order(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences by hash, check, document and place, and which of them begin another hash and check."""
    order = np.lexsort((p, d, c, h)) if len(c) else np.lexsort((p, d, h))
    h, c, d, p = h[order], c[order] if len(c) else c, d[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if len(c):
        new[1:] |= c[1:] != c[:-1]
    return h, c, d, p, new


class Dealer:
    """Gathers occurrences (hash, check, document, place) and deals them out as packed rows.  Checks may be left out."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> None:
        self.parts.append((hashes, checks, docs, places))
        self.size += len(hashes)

    def deal(self, all_copies: bool) -> pa.RecordBatch:
        """Rows by bucket.  Of copies held here the earliest is dealt by hash.  The others (with
        all_copies the earliest too) are settled, and go to negative buckets."""
        none = (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32))
        h, c, d, p = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else none
        self.parts, self.size = [], 0
        h, c, d, p, new = _in_order(h, c, d, p)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        copied = np.bincount(group, minlength=len(first))[group] > 1
        later = copied & ((d != d[first][group]) | (p != p[first][group])) if len(h) else copied
        settled = np.flatnonzero(copied if all_copies else later)
        bucket = np.concatenate([(h[first] % np.uint64(self.buckets)).astype(np.int64), -1 - d[settled] % self.buckets])
        take = np.concatenate([first, settled])
        order = np.argsort(bucket, kind="stable")
        bucket, take = bucket[order], take[order]
        h, c, d, p = h[take], c[take] if len(c) else c, d[take], p[take].astype(np.int32)
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        raw = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
        dealt = lambda x: pa.array([x[a:b].tobytes() if bucket[a] >= 0 else b"" for a, b in spans], pa.binary())  # noqa: E731  hashes of settled ones are of no more use
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]] if spans else [], pa.int32()), dealt(h), dealt(c), raw(d), raw(p)], names=_DEALT.names)


def _packed(bucket: np.ndarray, d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Occurrences as one row for each bucket, by document and place."""
    order = np.lexsort((p, d, bucket))
    bucket, d, p = bucket[order], d[order], p[order].astype(np.int32)
    cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    columns = [pa.array(bucket[cut[:-1]] if spans else [], pa.int32()), pa.array([d[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([p[x:y].tobytes() for x, y in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=_PACKED.names)


def _meet(dealt: DataFrame, all_copies: bool, buckets: int) -> DataFrame:
    """Packed occurrences that have a copy (all_copies), or an earlier copy, dealt by document."""

    def settle(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        h, c, d, p, new = _in_order(h, c, d, p)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        found = (d != d[first]) | (p != p[first])
        if all_copies:
            found |= np.bincount(first[found], minlength=len(h))[first] > 0
        return _packed(d[found] % buckets, d[found], p[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, h, c, d, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if bucket < 0:  # settled already, and dealt by document
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([d], pa.binary()), pa.array([p], pa.binary())], names=_PACKED.names)
                    continue
                if bucket != now and held:
                    yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = bucket
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32), np.frombuffer(d, np.int64), np.frombuffer(p, np.int32)))
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        W.release()

    return W.dealt(dealt, buckets).mapInArrow(run, _PACKED)


def _gathered(packed: DataFrame, buckets: int) -> DataFrame:
    """(_loam_id, _loam_places) with one row for each document."""

    def rows(held: list) -> pa.RecordBatch:
        d, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        cut = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [len(d)]]) if len(d) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(d[cut[:-1]] if len(d) else [], pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(p, pa.int32()))], names=_FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, d, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and held:
                    yield rows(held)
                    held = []
                now = bucket
                held.append((np.frombuffer(d, np.int64), np.frombuffer(p, np.int32)))
        if held:
            yield rows(held)
        held.clear()
        W.release()

    return W.dealt(packed, buckets).mapInArrow(run, _FOUND)


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_loam_id, _loam_places): the words at which the windows start that also start earlier; no row for other documents.

    Ids must tell different texts apart, as remove_repeats() sees to."""
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_loam_id"), text)
    size = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def deal_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for part in W.chunks(batches, text):
            ids, w = part.column("_loam_id").to_numpy(), W.words_of(part.column(text))
            _, place, hashes = anchors(w, window)
            place = np.unique(place)
            dealer.add(hashes[place], np.empty(0, np.uint32), ids[w.doc[place]], (place - w.first()[w.doc[place]]).astype(np.int32))
            if dealer.size > HELD:
                yield dealer.deal(all_copies=True)
        yield dealer.deal(all_copies=True)

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for part in W.chunks(batches, text):
            ids, w = part.column("_loam_id").to_numpy(), W.words_of(part.column(text))
            start, place, _ = anchors(w, window)
            first, shared = w.first(), part.column("_loam_places")
            known = np.zeros(len(w.hash) + 1, bool)
            ends = shared.offsets.to_numpy()
            known[shared.values.to_numpy()[ends[0] : ends[-1]] + np.repeat(first[:-1], np.diff(ends))] = True
            start = start[known[place]]
            if len(start):
                checks = (W.run_hash(W.mix(w.hash, 55), window)[start] >> np.uint64(32)).astype(np.uint32)
                dealer.add(W.run_hash(w.hash, window)[start], checks, ids[w.doc[start]], (start - first[w.doc[start]]).astype(np.int32))
            if dealer.size > HELD:
                yield dealer.deal(all_copies=False)
        yield dealer.deal(all_copies=False)

    shared = _gathered(_meet(own.mapInArrow(deal_anchors, _DEALT), True, buckets), buckets)
    windows = own.join(shared, "_loam_id").select("_loam_id", text, "_loam_places").mapInArrow(deal_windows, _DEALT)
    return _gathered(_meet(windows, False, buckets), buckets)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", kept: str = "kept", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and `kept`, the words that are left joined by one space.

    A word is removed if a window that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one.  Windows are judged on the input, not on what is left.  Ids are
    integers; different texts of one id are judged one after the other, in the order of their hashes; equal
    rows are judged alike, none of them earlier.  Nothing is removed at a null id; a null text has no
    words.  Columns of docs with these names are replaced.
    """
    base = docs.drop("n_words", "n_removed", kept)
    keep, kind = base.columns, docs.schema[doc_id].dataType
    apart = told_apart(base, doc_id, text, "_loam_row")
    if apart is not None:
        base, key = apart, "_loam_row"
    else:
        key = doc_id
    # the side of the join is the one of find_repeats(), column for column where docs has no others, so
    # that Spark shuffles the texts once for both
    own = base.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_loam_id"), *(c for c in keep if c != key))
    found = own.join(find_repeats(base, doc_id=key, text=text, window=window), "_loam_id", "left")
    found = found.select(*(F.col("_loam_id").cast(kind).alias(c) if c == key else F.col(c) for c in keep), "_loam_places")
    joined = found.unionByName(base.where(F.col(key).isNull()).select(keep).withColumn("_loam_places", F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            w = W.words_of(part.column(text))
            first, n = w.first(), len(w.hash)
            step = np.zeros(n + 1, np.int64)
            for k, places in enumerate(part.column("_loam_places").to_pylist()):
                if places:
                    at = np.unique(places) + first[k]
                    step[at] += 1
                    step[at + window] -= 1
            covered = np.cumsum(step[:-1]) > 0
            removed = np.bincount(w.doc[covered], minlength=part.num_rows)
            left = pa.array(W.gather_words(w, ~covered), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(w.counts), pa.array(removed), left], names=[*keep, "n_words", "n_removed", kept])

    return joined.select(*keep, "_loam_places").mapInArrow(run, joined.select(keep).schema.add("n_words", "long").add("n_removed", "long").add(kept, "string"))
