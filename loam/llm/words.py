"""Vectorised words and word windows of Arrow text columns (helpers that run inside Spark tasks).

A batch of texts is one byte buffer with offsets.  All the word classes that the operators use end
at ASCII bytes, and no byte of a multi-byte UTF-8 character is ASCII, so words are found on bytes.
Words and windows are compared as 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_U = np.uint64
#: 8-byte pieces that are hashed in one step, at most, or one longer span.
_STEP = 1 << 19


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h + _U((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two adjoining parts, in this order."""
    return mix(left * _U(0x2545F4914F6CDD1D) + right)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans data[start : end], by their bytes alone.

    A span is the sum of its 8-byte pieces, each mixed with its own place, and not a polynomial in one
    base: words like those of Thue and Morse, which collide for every base modulo 2 ** 64, don't here."""
    length = end - start
    pieces = (length + 7) >> 3
    out, ends = np.zeros(len(start), _U), np.cumsum(pieces)
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _STEP, side="right")))
        own = pieces[a:b]
        first = np.cumsum(own) - own
        place = np.arange(own.sum()) - np.repeat(first, own)
        here = eights[np.repeat(start[a:b], own) + 8 * place]
        spare = np.maximum(8 * (place + 1) - np.repeat(length[a:b], own), 0).astype(_U)
        here &= _U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * spare)
        values = mix(here + place.astype(_U) * _U(0xA0761D6478BD642F), 5)
        full = np.flatnonzero(own)
        if len(full):
            out[a + full] = np.add.reduceat(values, first[full])
        a = b
    return mix(mix(out, 2) + length.astype(_U), 3)


def _class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes inside a word `[^\\x20\\x09-\\x0D]+`.
SPACED = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes inside a word of lower-cased letters, digits and everything outside ASCII.
ALNUM = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """Words of a chunk of texts, in order: byte span, document index in the chunk, hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def first(self) -> np.ndarray:
        """Index of each document's first word; one more entry at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def take(self, rows: np.ndarray, column: pa.Array) -> Words:
        """The words of some documents (ascending); column: the texts of those."""
        data, offsets = text_bytes(column)
        own = np.zeros(len(self.offsets) - 1, bool)
        own[rows] = True
        kept = own[self.doc]
        doc = (np.cumsum(own) - 1)[self.doc[kept]]
        shift = offsets[doc] - self.offsets[self.doc[kept]]
        return Words(data, offsets, self.start[kept] + shift, self.end[kept] + shift, doc, self.hash[kept])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, run_hash(self.hash, k)[at]


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i, by doubling; h has k entries at least."""
    n, out, have, power, size = len(h), None, 0, h, 1
    while have < k:
        if k & size:
            m = n - have - size + 1
            out = power[:m] if out is None else join_hash(out[:m], power[have : have + m])
            have += size
        if have < k:
            power = join_hash(power[: n - 2 * size + 1], power[size : n - size + 1])
            size *= 2
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets (starting at 0) of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """df by its `bucket`, sorted; with a partition for each bucket where there are more than Spark would make."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition(buckets, "bucket") if buckets > usual else df.repartition("bucket")).sortWithinPartitions("bucket")


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a chunk holds about `size` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        release()


def words_of(column: pa.Array, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower and len(data):
        data = _LOWER[data]
    word = inside[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    return Words(data, offsets, first, last, doc, span_hash(data, first, last))


def sort_within(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by document, then value."""
    order = np.argsort(value)
    small = doc[order].astype(np.uint16) if len(doc) and doc[-1] < 65536 else doc[order]
    return order[np.argsort(small, kind="stable")]


def gather_words(w: Words, keep: np.ndarray) -> list[bytes]:
    """For each document, its words at the kept places joined by one space."""
    raw, out, first = w.data.tobytes(), [], w.first()
    for d in range(len(w.offsets) - 1):
        a, b = first[d], first[d + 1]
        at = np.flatnonzero(keep[a:b]) + a
        out.append(b" ".join([raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
