"""Language-model scores from an Elias-Fano n-gram trie that is learned from the corpus.

The model is an interpolated one with absolute discounting over an additively smoothed unigram:
p(w | c) = max(count(c w) - d, 0) / count(c) + d * different successors(c) / count(c) * p(w | c without its first word).

Texts are read once, as chunks of documents with their words numbered.  Level after level a chunk asks for its different n-grams, each once and
with its own training count, and the task that owns a part of the level adds up the counts of
all chunks, builds the part's trie level in a mapped file, and answers every chunk by successor
search.  A context is the node that the level before answered with, and a successor is numbered among the
successors of the shorter context.  So the trie grows with the corpus but no task holds more than its
part, nothing of it is sent to all tasks, and frequent n-grams travel once for each chunk.  Contexts with over a
64th of all tokens are spread over several parts.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, ship, written
from . import words as W
from .elias_fano import Level, code_of, probability

#: Highest n, the discount, bytes of text in a chunk, and tokens of the corpus for each part of a level.
ORDER, DISCOUNT, CHUNK_BYTES, PART_TOKENS = 3, 0.75, 8 << 20, 2 << 20
#: Contexts with more than one in so many tokens are spread.
SPREAD = 64

_PARTS = "part int, chunk long, blob binary, names binary"
_ANSWERS = "chunk long, level int, part int, blob binary, tokens long, different long"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, whose shuffle files go as soon as it is there: each level has shuffles of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, by the planes of their bytes, compressed."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.int64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head.append(struct.pack("<qB", len(a), width))
        body += [(a >> 8 * k).astype(np.uint8).tobytes() for k in range(width)]
    raw = b"".join(body)
    return struct.pack("<Bq", len(arrays), len(raw)) + b"".join(head) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes, wanted: int | None = None) -> list[np.ndarray]:
    """The arrays of pack(), or the first ones of them."""
    count, size = struct.unpack_from("<Bq", blob)
    heads = [struct.unpack_from("<qB", blob, 9 + 9 * k) for k in range(count)]
    raw = np.frombuffer(pa.decompress(memoryview(blob)[9 + 9 * count :], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for n, width in heads[:wanted]:
        a = raw[at : at + n].astype(np.int64) if width else np.zeros(n, np.int64)
        for k in range(1, width):
            a |= raw[at + n * k : at + n * k + n].astype(np.int64) << 8 * k
        out.append(a)
        at += n * width
    return out


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)
        del batch, columns
        W.release()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each different hash, by hash; each place's number among them; how often each occurs).

    The leading bits of a hash and its place make one number, and numbers are sorted as such; hashes that differ in the other bits only are told apart as a whole."""
    n = len(hashes)
    low = np.uint64((1 << n.bit_length()) - 1)
    one = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    order = (one & low).astype(np.int64)
    ordered = hashes[order]
    new = ordered[1:] != ordered[:-1]
    if (new & ((one[1:] & ~low) == (one[:-1] & ~low))).any():
        return np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)[1:]
    new = np.concatenate([[True], new])[:n]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], number, np.diff(np.append(first, n))


def _spaced(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """Byte spans of data, a space before each."""
    out, ends = np.full(int(length.sum()) + len(length), 0x20, np.uint8), np.cumsum(length)
    place = np.arange(len(out) - len(length))
    out[place + np.repeat(np.arange(1, len(length) + 1), length)] = data[place + np.repeat(start - (ends - length), length)]
    return out.tobytes()


def _read(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, blob, names, counts, size) of docs (doc_id, text, held): word numbers, the words and their training counts.

    Numbers go by falling frequency in the chunk; 0 is the end of a text."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in W.chunks(batches, "text", chunk_bytes):
            w = W.words_of(part.column("text"), lower=True)
            held = part.column("held").to_numpy(zero_copy_only=False)
            at, code, total = _different(w.hash)
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            code = rank[code]
            trained = np.bincount(code, weights=~held[w.doc], minlength=len(order) + 1).astype(np.int64)
            trained[0] = len(held) - held.sum()
            at = at[order]
            names = _spaced(w.data, w.start[at], w.end[at] - w.start[at])
            ids = part.column("doc_id")
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            rest = [[number], [pack(code, w.counts, held)], [pa.compress(struct.pack("<q", 0) + names, codec="zstd", asbytes=True)], [pack(trained)], [len(code) + len(held)], [len(names) + 8]]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(v, k) for v, k in zip(rest, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, ids], names=["chunk", "blob", "names", "counts", "size", "names_size", "ids"])
            number += 1

    schema = T.StructType().add("chunk", "long").add("blob", "binary").add("names", "binary").add("counts", "binary").add("size", "long").add("names_size", "long")
    return docs.mapInArrow(run, schema.add("ids", T.ArrayType(kind)))


def _names(blob: bytes, size: int) -> list[bytes]:
    return pa.decompress(blob, size, codec="zstd", asbytes=True)[8:].split(b" ")


def _ask_words(chunks: DataFrame, parts: int) -> DataFrame:
    """Each chunk's words, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, names, size, counts in _rows(batches, "chunk", "names", "names_size", "counts"):
            found, (trained,) = _names(names, size), unpack(counts)
            data, offsets = W.text_bytes(pa.array(found, pa.binary()))
            part = (W.mix(W.span_hash(data, offsets[:-1], offsets[1:]), 7) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for p, own in _slices(part[order]):
                local = order[own]
                words = b" ".join([found[i] for i in local.tolist()])
                yield _batch(_PARTS, [(p, chunk, pack(local, trained[local]), words)])

    return chunks.select("chunk", "names", "names_size", "counts").mapInArrow(run, _PARTS)


def _ordered(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys of non-negative integers in order, by the first one first; the order).

    Where they fit into 63 bits they make one number, and together with the place, numbers are sorted as such."""
    n = len(keys[0])
    widths = [int(k.max()).bit_length() if n else 0 for k in keys]
    place = n.bit_length()
    if sum(widths) > 63:
        order = np.lexsort(keys[::-1])
        return [k[order] for k in keys], order
    one = keys[0].astype(np.int64)
    for k, w in zip(keys[1:], widths[1:], strict=True):
        one = (one << w) | k
    if sum(widths) + place > 63:
        order = np.argsort(one)
        one = one[order]
    else:
        one = np.sort((one << place) | np.arange(n))
        order = one & ((1 << place) - 1)
        one >>= place
    out = []
    for w in widths[:0:-1]:
        out.append(one & ((1 << w) - 1))
        one = one >> w
    return [one, *out[::-1]], order


def _order(*keys: np.ndarray) -> np.ndarray:
    return _ordered(*keys)[1]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys, ascending; each key's number among them)."""
    if not len(keys):
        return keys, keys
    (ordered,), order = _ordered(keys)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of the runs of sorted keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
        yield int(keys[a]), slice(a, b)


class Held:
    """Byte strings kept in an unlinked temporary file until they are read again."""

    def __init__(self):
        self.file, self.sizes = tempfile.TemporaryFile(), []

    def add(self, *parts: bytes) -> None:
        for p in parts:
            self.file.write(p)
        self.sizes.append([len(p) for p in parts])

    def __iter__(self) -> Iterator[list[bytes]]:
        self.file.seek(0)
        for sizes in self.sizes:
            yield [self.file.read(n) for n in sizes]


def _answer_words(asked: DataFrame, parts: int) -> DataFrame:
    """For each part and chunk: the numbers of its words, their identities plus one (0: never in training) and training counts.

    An identity is the word's rank by training count within its part, times the number of parts, plus
    the part: frequent words have small ones.  One row of no chunk for each part has its tokens and different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches, "part", "chunk", "blob", "names"), key=lambda r: r[0]):
            held, known, waiting = Held(), pa.table({"w": pa.array([], pa.binary()), "c": pa.array([], pa.int64())}), []

            def merged(known: pa.Table, waiting: list) -> pa.Table:
                both = pa.concat_tables([known, *waiting]).group_by("w").aggregate([("c", "sum")])
                return pa.table({"w": both["w"].combine_chunks(), "c": both["c_sum"].combine_chunks()})

            for _, chunk, blob, names in rows:
                held.add(struct.pack("<q", chunk), blob, names)
                counts = unpack(blob)[1]
                words = pa.array(names.split(b" "), pa.binary())
                waiting.append(pa.table({"w": words, "c": pa.array(counts)}).filter(pa.array(counts > 0)))
                if sum(map(len, waiting)) > max(len(known), 1 << 19):
                    known, waiting = merged(known, waiting), []
            known = merged(known, waiting).sort_by([("c", "descending"), ("w", "ascending")])
            words = known["w"].combine_chunks() if known["w"].num_chunks != 1 else known["w"].chunk(0)
            counts = known["c"].to_numpy()
            for chunk, blob, names in held:
                at = pc.fill_null(pc.index_in(pa.array(names.split(b" "), pa.binary()), value_set=words), -1).to_numpy().astype(np.int64)
                seen = at >= 0
                identity, count = np.where(seen, at * parts + part + 1, 0), np.zeros(len(at), np.int64)
                count[seen] = counts[at[seen]]
                yield _batch(_ANSWERS, [(struct.unpack("<q", chunk)[0], 1, part, pack(*unpack(blob, 1), identity, count), 0, 0)])
            yield _batch(_ANSWERS, [(None, 1, part, b"", int(counts.sum()), len(counts))])
            del held, known, words, counts
            W.release()

    return W.dealt(asked.withColumnRenamed("part", "bucket"), parts).withColumnRenamed("bucket", "part").mapInArrow(run, _ANSWERS)


class Chunk:
    """A chunk's documents and the n-grams in them, and what has been answered about those.

    The different n-grams of a level are numbered; `gram[k]` has the number of the k-gram that ends at each
    place, `node`, `relative` and `count` its node, its number among its context's successors (-1: not in the trie) and its training count,
    from level 2 on as its quantised probability gives it, which is exact below some 3,000."""

    def __init__(self, blob: bytes, parts: int):
        code, counts, held = unpack(blob)
        self.held, self.parts = held.astype(bool), parts
        self.lengths = counts + 2
        ends = np.cumsum(self.lengths)
        n = int(ends[-1]) if len(ends) else 0
        self.doc = np.repeat(np.arange(len(counts)), self.lengths)
        self.offset = np.arange(n) - np.repeat(ends - self.lengths, self.lengths)
        inner = (self.offset > 0) & (self.offset <= counts[self.doc])
        places = np.zeros(n, np.int64)
        places[inner] = code
        self.trained = ~self.held[self.doc]
        self.gram: dict[int, np.ndarray] = {1: places}
        self.node: dict[int, np.ndarray] = {}
        self.relative: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}
        self.share: dict[int, np.ndarray] = {}
        self.rest: dict[int, np.ndarray] = {}

    def words(self, answers: list[bytes]) -> None:
        found = [unpack(a) for a in answers]
        local, identity, count = (np.concatenate(c) for c in zip(*found, strict=True))
        self.node[1], self.count[1] = np.full(len(local), -1), np.zeros(len(local), np.int64)
        self.node[1][local], self.count[1][local] = identity - 1, count
        self.relative[1] = self.node[1]

    def asked(self, level: int, spread: int, counted: bool = True) -> tuple[np.ndarray, ...]:
        """The contexts and n-grams to ask for, in the order of parts, nodes and successors.

        (part, number of the context, node, total; part, number of the n-gram, node, successor, training count or, if not counted, none)"""
        above = self.gram[level - 1]
        at = np.flatnonzero(self.offset >= level - 1)
        bits = len(self.node[1]).bit_length()
        different, inverse = _numbered(above[at - 1] << bits | self.gram[1][at])
        self.gram[level] = np.full(len(above), -1)
        self.gram[level][at] = inverse
        context, suffix = different >> bits, np.empty(len(different), np.int64)
        suffix[inverse] = above[at]
        node_of = self.node[level - 1]
        self.context, self.copies = context, 1 + self.count[level - 1] // spread
        # n-grams are sorted by context, so each context's own stand together
        contexts = context[np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))] if len(context) else context
        contexts = contexts[node_of[contexts] >= 0]
        node, successor = node_of[context], self.relative[level - 1][suffix]
        grams = np.flatnonzero((node >= 0) & (successor >= 0))
        node, successor = node[grams], successor[grams]
        spreads = len(contexts) and self.copies[contexts].max() > 1
        if spreads:
            times = self.copies[contexts]
            salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            contexts = np.repeat(contexts, times)
            nodes = node_of[contexts]
            c_part, g_part = self._part(nodes, salt), self._part(node, successor % self.copies[context[grams]])
        else:
            nodes = node_of[contexts]
            c_part = self._part(nodes)
        order = _order(c_part, nodes)
        again = (c_part[order][1:] == c_part[order][:-1]) & (nodes[order][1:] == nodes[order][:-1])
        if again.any():  # copies of a context can meet in a part
            order = order[np.concatenate([[True], ~again])]
        contexts, nodes, c_part = contexts[order], nodes[order], c_part[order]
        if spreads:
            by = _order(g_part, node, successor)
            g_part, node, successor = g_part[by], node[by], successor[by]
        else:  # each context is in one part: n-grams go by its place among the contexts
            place = np.zeros(len(node_of), np.int64)
            place[contexts] = np.arange(len(contexts))
            (place, successor), by = _ordered(place[context[grams]], successor)
            g_part, node = c_part[place], nodes[place]
        grams = grams[by]
        count = np.bincount(inverse[self.trained[at]], minlength=len(different))[grams] if counted else None
        return c_part, contexts, nodes, self.count[level - 1][contexts], g_part, grams, node, successor, count

    def _part(self, node: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return (W.mix(node.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt, np.uint64), 11) % np.uint64(self.parts)).astype(np.int64)

    def answered(self, level: int, spread: int, answers: list[tuple[int, bytes]], discount: float) -> None:
        c_part, contexts, _, total, g_part, grams, _, successor, _ = self.asked(level, spread, counted=False)
        n, m = len(self.context), len(self.copies)
        self.share[level], successors, totals = np.zeros(n), np.zeros(m), np.zeros(m)
        self.node[level], self.relative[level], self.count[level] = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
        totals[contexts] = total
        of_context, of_gram = dict(_slices(c_part)), dict(_slices(g_part))
        one = code_of(np.ones(1), np.maximum(totals, 1), discount)
        for part, blob in answers:
            different, below, *more = unpack(blob)
            own, mine = of_context[part], of_gram.get(part, slice(0, 0))
            successors[contexts[own]] += different  # no context stands twice in a part
            found = np.flatnonzero(below > 0)
            number = grams[mine][found]
            context = self.context[number]
            code = one[context] + 1 - below[found]
            self.share[level][number] = probability(code)
            if more:
                begin = np.zeros(m, np.int64)
                begin[contexts[own][different > 0]] = np.cumsum(more[0])
                copies = self.copies[context]
                self.node[level][number] = (begin[context] + more[1]) * self.parts + part
                self.relative[level][number] = more[1] * copies + successor[mine][found] % copies
                self.count[level][number] = np.maximum(np.rint(probability(code) * totals[context] + discount), 1).astype(np.int64)
        self.rest[level] = np.where(totals > 0, discount * successors / np.maximum(totals, 1), 1.0)

    def scores(self, order: int, tokens: int, different: int) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each document."""
        at = np.flatnonzero(self.offset > 0)
        word = self.gram[1][at]
        of_word = (self.count[1] + 0.1) / (tokens + 0.1 * (different + 1))
        p = of_word[self.gram[1]]
        for level in range(2, order + 1):
            here = np.flatnonzero(self.offset >= level - 1)
            p[here] = self.share[level][self.gram[level][here]] + self.rest[level][self.gram[level - 1][here - 1]] * p[here]
        doc, n = self.doc[at], len(self.lengths)
        total = lambda v: np.bincount(doc, weights=v, minlength=n)
        return self.lengths - 1, total((self.count[1] > 0)[word]).astype(np.int64), total(np.log10(of_word)[word]), total(np.log10(p[at]))


def _gathered(chunks: DataFrame, answers: list[DataFrame], number: int, ids: bool = False) -> DataFrame:
    """(chunk, level, part, blob[, ids]), by chunk: its documents as level 0, then all answers, sorted."""
    none = F.lit(None).cast(chunks.schema["ids"].dataType)
    rows = chunks.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("part"), "blob", (F.col("ids") if ids else none).alias("ids"))
    for a in answers:
        rows = rows.unionAll(a.where("chunk is not null").select("chunk", "level", "part", "blob", none.alias("ids")))
    usual = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(number, usual), "chunk").sortWithinPartitions("chunk", "level", "part")


def _chunks_of(batches: Iterator[pa.RecordBatch], levels: int, parts: int, spread: int, discount: float, *more: str) -> Iterator[tuple[int, Chunk, tuple]]:
    """(chunk's number, its n-grams with the answers of so many levels, more columns of its first row)."""
    for number, rows in groupby(_rows(batches, "chunk", "level", "part", "blob", *more), key=lambda r: r[0]):
        first = next(rows)
        chunk = Chunk(first[3], parts)
        found = {level: [(r[2], r[3]) for r in own] for level, own in groupby(rows, key=lambda r: r[1])}
        chunk.words([b for _, b in found[1]])
        for level in range(2, levels + 1):
            chunk.answered(level, spread, found.get(level, []), discount)
        yield number, chunk, first[4:]
        del chunk
        W.release()


def _ask(gathered: DataFrame, level: int, parts: int, spread: int, discount: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _ in _chunks_of(batches, level - 1, parts, spread, discount):
            c_part, contexts, nodes, total, g_part, _, node, successor, count = chunk.asked(level, spread)
            of_gram = dict(_slices(g_part))
            for p, own in _slices(c_part):
                mine = of_gram.get(p, slice(0, 0))
                sizes = np.diff(np.searchsorted(node[mine], nodes[own]), append=mine.stop - mine.start)  # each node is one of the contexts
                yield _batch(_PARTS, [(p, number, pack(np.diff(nodes[own], prepend=0), total[own], sizes, successor[mine], count[mine]), None)])

    return gathered.mapInArrow(run, _PARTS)


def _merge(pending: list[tuple]) -> list[tuple]:
    """Entries (node, successor, count, total), sorted, with the counts of equal ones added up."""
    node, successor, count, total = (np.concatenate(c) for c in zip(*pending, strict=True))
    (node, successor), order = _ordered(node, successor)
    new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (successor[1:] != successor[:-1])])[: len(node)])
    return [(node[new], successor[new], np.add.reduceat(count[order], new) if len(new) else count, total[order][new])]


def _answer(asked: DataFrame, level: int, parts: int, discount: float, last: bool) -> DataFrame:
    """For each part and chunk: how many successors its contexts have, and its n-grams' quantised probabilities, unless it is the last level also where successors begin and the places of n-grams among them.

    A probability goes as its distance, plus one, from that of a count of 1, which is small and means the same to both sides; 0 is for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        for part, rows in groupby(_rows(batches, "part", "chunk", "blob"), key=lambda r: r[0]):
            held, pending, waiting = Held(), [(empty, empty, empty, empty)], 0
            for _, chunk, blob in rows:
                held.add(struct.pack("<q", chunk), blob)
                steps, total, sizes, successor, count = unpack(blob)
                seen = count > 0
                pending.append((np.repeat(np.cumsum(steps), sizes)[seen], successor[seen], count[seen], np.repeat(total, sizes)[seen]))
                waiting += int(seen.sum())
                if waiting > max(len(pending[0][0]), 1 << 20):
                    pending, waiting = _merge(pending), 0
            (entries,) = _merge(pending)
            del pending
            with tempfile.TemporaryFile() as file:
                trie = Level.load(file, Level.of(*entries, discount).save(file))
                del entries
                W.release()
                for chunk, blob in held:
                    steps, total, sizes, successor = unpack(blob, 4)
                    begin, end, base = trie.ranges(np.cumsum(steps))
                    from_ = np.repeat(begin, sizes)
                    at = trie.find(from_, np.repeat(end, sizes), np.repeat(base, sizes), successor)
                    found = np.flatnonzero(at >= 0)
                    below = np.zeros(len(at), np.int64)
                    below[found] = np.repeat(code_of(np.ones(1), total, discount), sizes)[found] + 1 - trie.codes[at[found]]
                    more = [] if last else [np.diff(begin[end > begin], prepend=0), (at - from_)[found]]
                    yield _batch(_ANSWERS, [(struct.unpack("<q", chunk)[0], level, part, pack(end - begin, below, *more), 0, 0)])
                del trie, held
            W.release()

    return W.dealt(asked.select(F.col("part").alias("bucket"), "chunk", "blob"), parts).withColumnRenamed("bucket", "part").mapInArrow(run, _ANSWERS)


def score_texts(
    docs: DataFrame, training: Column, *, doc_id: str = "doc_id", text: str = "text",
    order: int = ORDER, discount: float = DISCOUNT, chunk_bytes: int = CHUNK_BYTES, part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    training: which rows the model learns from; rows where it is null are held out.  Tokens are the words of the text, with A to Z
    lower-cased, and one end.  base_score is the log10 probability under the additively smoothed unigram alone, score
    that of the whole model of n-grams up to `order`.  A null or empty text is one end; rows of equal
    ids are scored each, and all are learned from; an empty table gives no rows; other columns of docs are left out.  Without any training row each
    score is 0.  A text is held by one task.  Larger corpora take larger chunks and parts, as executors allow.
    """
    if order < 2 or not 0 < discount < 1:
        raise ValueError("order is 2 or more, discount between 0 and 1")
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(training, F.lit(False))).alias("held"))
    chunks = _kept(_read(rows, chunk_bytes), "lm-chunks")
    number, size = chunks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, size // part_tokens + 1)
    answers = [_kept(_answer_words(_ask_words(chunks, parts), parts), "lm-words")]
    tokens, different = answers[0].where("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    spread = tokens // SPREAD + 1
    for level in range(2, order + 1):
        asked = _ask(_gathered(chunks, answers, number), level, parts, spread, discount)
        answers.append(_kept(_answer(asked, level, parts, discount, level == order), f"lm-level-{level}"))
    kind = chunks.schema["ids"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, (ids,) in _chunks_of(batches, order, parts, spread, discount, "ids"):
            n_tokens, n_known, base, score = chunk.scores(order, tokens, different)
            made = [chunk.held, n_tokens, n_known, np.full(len(base), tokens), base, score]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind.elementType)), *map(pa.array, made)], names=names)

    schema = T.StructType().add("doc_id", kind.elementType).add("held_out", "boolean")
    for c in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(c, "long")
    scored = _gathered(chunks, answers, number, ids=True).mapInArrow(run, schema.add("base_score", "double").add("score", "double"))
    found = _kept(scored, "lm-scores")
    discard(chunks, *answers)
    return found


def to_arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type as convert

    return convert(kind)
