"""Token counts by a map-side two-tier lookup.

A compact table of the lengths (in tokens) of frequent pre-tokens is sent to all tasks.  Each task
cuts its texts into pre-tokens, looks lengths up there and then in its worker's cache, and encodes
only what both miss.  Pre-tokens are never shuffled.

The cutting is done with Python patterns where they agree with the tokenizer's own normaliser and
pre-tokenizer (texts of Latin letters, ASCII and general punctuation), and by those two for any other
text.  Special strings are cut out before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import byte_letters

#: Pre-tokens in the broadcast table, at most, and texts in the sample that they are counted on, about.
TABLE_SIZE = 1 << 16
SAMPLE_ROWS = 2_000
#: Pre-tokens in a worker's cache, at most: when its younger half is full it becomes the older one, and the older one goes.
#: Those of more than LONG characters are not kept.
CACHE_SIZE, LONG = 1 << 18, 64

#: ASCII, Latin letters, general punctuation: here Python and the tokenizer agree on cases and classes.
_SIMPLE = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-ſ‐-‧‰-⁞]*")
#: Code points of these ranges that the tokenizer classes apart from letters and signs.
_ODD = re.compile(r"[\xb2\xb3\xb9\xbc-\xbeİ]")
_ASCII_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ſ"
_LATIN_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")


class Counter2:
    """Counts the tokens of texts for a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letter = {b: c for c, b in byte_letters().items()}
        self.byte = byte_letters()
        self.frequent, self.lengths, self.older = frequent or {}, {}, {}  # the two tiers: sent to all, and this worker's own

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string is one."""
        if self._split is None or not any(s in text for s in self.special):
            return self._cut_plain(text)
        return [p for k, x in enumerate(self._split.split(text)) for p in ([x] if k % 2 else self._cut_plain(x) if x else [])]

    def _cut_plain(self, text: str) -> list[str]:
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            if text.isascii():
                return _ASCII_CUT.findall(text.lower())
            if _SIMPLE.fullmatch(text) and not _ODD.search(text):
                return _LATIN_CUT.findall(text.lower())
        t = self.tokenizer  # other scripts are cut by the library itself, for its Unicode tables
        return [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]

    def length(self, piece: str) -> int:
        if piece in self.special:
            return 1
        return len(self.tokenizer.model.tokenize("".join(map(self.letter.__getitem__, piece.encode()))))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(x) for x in texts]
        seen = set(chain.from_iterable(cut))
        missed = [p for p in seen if p not in self.lengths]
        if len(self.lengths) + len(missed) > CACHE_SIZE // 2:
            self.lengths, self.older = {}, self.lengths
            missed = list(seen)
        known = (self.older, self.frequent)
        self.lengths.update((p, next((t[p] for t in known if p in t), None) or self.length(p)) for p in missed)
        get = self.lengths.__getitem__
        out = [sum(map(get, pieces)) for pieces in cut]
        for p in missed:
            if len(p) > LONG:
                del self.lengths[p]
        return out


_workers: dict[str, Counter2] = {}


def _worker(path: str, frequent: dict[str, int] | None = None) -> Counter2:
    """One counter for each Python worker, so that its cache outlives a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _workers:
        _workers[path] = Counter2(path, frequent)
    if frequent:
        _workers[path].frequent = frequent
    return _workers[path]


def texts_of(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Chunks of about `size` bytes with their texts; a null is an empty text."""
    from .words import chunks

    for part in chunks(batches, column, size):
        yield part, pc.fill_null(part.column(column), "").to_pylist()


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Lengths of the pre-tokens found most often in a sample of about sample_rows texts.

    Rows are drawn at random, each in its own task, and only counts leave it.  The sample decides what is quick, and no result."""
    own = docs.select(text).where(F.col(text).isNotNull())
    rows = own.count()
    sample = own.sample(min(1.0, sample_rows / rows), seed=7) if rows else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found = _worker(path), Counter()
        for _, texts in texts_of(batches, text):
            for x in texts:
                found.update(p for p in counter.cut(x) if len(p) <= LONG)
        top = [p for p, _ in found.most_common(table_size)]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([found[p] for p in top], pa.int64()), pa.array([counter.length(p) for p in top], pa.int32())], names=["piece", "n", "size"])

    found = sample.mapInArrow(run, "piece string, n long, size int").groupBy("piece", "size").agg(F.sum("n").alias("n")).where("n > 1")
    return {r["piece"]: r["size"] for r in found.orderBy(F.desc("n"), "piece").limit(table_size).select("piece", "size").collect()}


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens, as the tokenizer at `path` gives them without added special tokens.

    Special strings inside texts are single tokens, as is the library's default.  A null or empty
    text has 0 of both; repeated rows count alike; an empty table gives no rows.  Columns of docs
    with these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, table_size, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(path, sent.value)
        for part, texts in texts_of(batches, text):
            sizes = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), sizes, pa.array(counter.counts(texts), pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(keep).mapInArrow(run, docs.select(keep).schema.add("n_bytes", "long").add("n_tokens", "long"))
