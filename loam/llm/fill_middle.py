"""Fill-in-middle: texts cut at two line boundaries and put in another order around marks.

A text is held as big integers with a bit for each byte: `bytes.translate` turns it into the masks of its
byte classes, shifts and boolean operations mark where units begin, `bit_count` counts them, and the
bit of a given rank is found by halving the mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_NEWLINE = bytes(0x31 if b == 10 else 0x30 for b in range(256))
_LEAD = bytes(0x30 if b & 0xC0 == 0x80 else 0x31 for b in range(256))


def mask(raw: bytes, byte_class: bytes) -> int:
    """An integer whose bit i tells whether byte i is of the class, a table of the letters 0 and 1."""
    return int(raw.translate(byte_class)[::-1] or b"0", 2)


def line_starts(raw: bytes) -> int:
    """The bits of bytes that begin a line; a line ends behind its newline, or at the end of the text."""
    return (mask(raw, _NEWLINE) << 1 | 1) & ((1 << len(raw)) - 1)


def ranked_bit(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set ones below it."""
    place = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, place, width = bits >> half, rank - below, place + half, width - half
    return place


def cut(raw: bytes, first: int, second: int) -> tuple[int, int, int, int, int]:
    """(n, end of prefix, end of middle, code points of prefix, of middle); first and second are taken modulo n + 1."""
    starts = line_starts(raw)
    n = starts.bit_count()
    ends = [ranked_bit(starts, k, len(raw)) if k < n else len(raw) for k in sorted((first % (n + 1), second % (n + 1)))]
    lead = mask(raw, _LEAD)
    chars = [(lead & ((1 << e) - 1)).bit_count() for e in ends]
    return n, *ends, chars[0], chars[1] - chars[0]


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate: percent of texts that are cut; spm: percent of those whose suffix goes first.  A text that is
    null, empty or holds a mark, or whose id is null, is plain: its output is the text (null: empty), and it has no chars.  Rows of one
    id and different texts share their draws.  Columns of docs with the names made are replaced.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in docs.columns if c not in made]
    h = draws(F.col(doc_id), seed)
    form = F.when(F.coalesce(h[2] % 100 >= rate, F.lit(True)), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.coalesce(text, F.lit("")).alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for raw, shape, a, b in zip(*(chunk.column(c).to_pylist() for c in ("text", "form", "h1", "h2")), strict=True):
                raw = raw.encode()
                if not raw or shape == "plain" or any(m in raw for m in marks):
                    row = line_starts(raw).bit_count(), "plain", None, None, raw
                else:
                    n, x, y, before, between = cut(raw, a, b)
                    p, m, s = raw[:x], raw[x:y], raw[y:]
                    parts = (marks[0], p, marks[1], s, marks[2], m) if shape == "psm" else (marks[1], s, marks[0], p, marks[2], m)
                    row = n, shape, before, between, b"".join(parts)
                for to, v in zip(out, row, strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(chunk.column(f"c{i}") for i in range(len(keep))), *arrays], names=[*(f"c{i}" for i in range(len(keep))), *made])

    schema = rows.select(*(f"c{i}" for i in range(len(keep)))).schema
    for c, kind in zip(made, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(c, kind)
    return rows.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; natively, from the output alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
