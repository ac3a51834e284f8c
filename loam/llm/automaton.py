"""Suffix automata of reference shards, and matching statistics against them.

For a reference table that is apart from the documents: its texts are cut into shards of a bounded
number of words, each shard's automaton is built once and sent to the tasks, and every document is
streamed through it.  At each word the automaton knows the longest run ending there that occurs in
the shard; maximal runs of at least the threshold are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import words as W

#: Words in a shard, at most: about 1 KB each in a task's memory.
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """All runs of the words of some texts, none across two texts."""

    def __init__(self):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def add_text(self, words: list[int]) -> None:
        self.last = 0
        for w in words:
            self._add(w)

    def _add(self, w: int) -> None:
        after, link, length = self.next, self.link, self.length
        p, known = self.last, after[self.last].get(w)
        if known is not None and length[known] == length[p] + 1:  # the run stands in an earlier text
            self.last = known
            return
        new = -1
        if known is None:
            new = self._state(length[p] + 1, 0, {})
            while p != -1 and w not in after[p]:
                after[p][w] = new
                p = link[p]
            if p == -1:
                self.last = new
                return
            known = after[p][w]
            if length[known] == length[p] + 1:
                link[new], self.last = known, new
                return
        copy = self._state(length[p] + 1, link[known], dict(after[known]))
        while p != -1 and after[p].get(w) == known:
            after[p][w] = copy
            p = link[p]
        link[known] = copy
        if new != -1:
            link[new] = copy
        self.last = copy if new == -1 else new

    def matches(self, words: list[int]) -> list[int]:
        """For each word, the length of the longest run ending there that the automaton has."""
        after, link, length, out, state, n = self.next, self.link, self.length, [], 0, 0
        for w in words:
            while state and w not in after[state]:
                state = link[state]
                n = length[state]
            if w in after[state]:
                state, n = after[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def _shards(reference: DataFrame, text: str, shard_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of blocks of whole texts, made one at a time; a text longer than a shard is one of its own."""
    shard, size = SuffixAutomaton(), 0
    for row in reference.select(text).where(F.col(text).isNotNull()).toLocalIterator():
        words = W.words_of(pa.array([row[0]])).hash.tolist()
        if size and size + len(words) > shard_words:
            yield shard
            shard, size = SuffixAutomaton(), 0
        shard.add_text(words)
        size += len(words)
    if size:
        yield shard


def remove_referenced(docs: DataFrame, reference: DataFrame, *, text: str = "text", reference_text: str = "text", min_words: int = 20, kept: str = "kept", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with n_words, n_removed and `kept`: words outside all runs of min_words or more that the reference has.

    One pass over the documents for each shard of the reference.  Nulls have no words; an empty
    reference removes nothing; columns of docs with these names are replaced.
    """
    found, passes = docs.drop("n_words", "n_removed", kept, "_gone").withColumn("_gone", F.array().cast("array<int>")), 0
    keep = [c for c in found.columns if c != "_gone"]
    for shard in _shards(reference, reference_text, shard_words):
        found = _pass(written(found, "automaton") if passes else found, keep, text, shard, min_words)
        passes += 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            w = W.words_of(part.column(text))
            left = np.ones(len(w.hash), bool)
            for first, gone in zip(w.first().tolist(), part.column("_gone").to_pylist(), strict=False):
                left[first + np.array(gone, np.int64)] = False
            rest = pa.array(W.gather_words(w, left), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(w.counts), pa.array(np.bincount(w.doc[~left], minlength=part.num_rows)), rest], names=[*keep, "n_words", "n_removed", kept])

    return found.mapInArrow(finish, T.StructType([*found.select(keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept, T.StringType())]))


def _pass(docs: DataFrame, keep: list[str], text: str, shard: SuffixAutomaton, min_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for part in W.chunks(batches, text):
            w, out = W.words_of(part.column(text)), []
            first, hashes = w.first().tolist(), w.hash.tolist()
            for k, old in enumerate(part.column("_gone").to_pylist()):
                gone = set(old)
                for end, n in enumerate(automaton.matches(hashes[first[k] : first[k + 1]])):
                    if n >= min_words:
                        gone.update(range(end - n + 1, end + 1))
                out.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.list_(pa.int32()))], names=[*keep, "_gone"])

    return docs.select(*keep, "_gone").mapInArrow(run, T.StructType([*docs.select(keep).schema.fields, T.StructField("_gone", T.ArrayType(T.IntegerType()))]))
