"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles.  The join is exact and in two steps.

Index lists.  By the pigeonhole principle, two sets within the similarity share the whole content of
at least one of m hash segments of the token space, where m is more than the most tokens in which
such sets of a size class can differ.  A list holds the sets of one class with one content of one
segment; lists of one set are dropped.  Segments rather than single tokens are the keys because
a frequent shingle would make a list of a large part of the corpus.  There are half as many spare
segments, so that linked sets agree on more than one: a set leaves that many of its lists, those of the
most sets, and sets that only share a passage don't meet.  The keys of lists travel packed, once.

Answers.  A list's least set is its leader.  Its answers (overlaps with all sets of its lists) are
computed in full, and those of the others are derived from them: with D(y) the difference of y and
the leader, |y xor z| = |D(y)| + |D(z)| - 2 |D(y) and D(z)|, so only the small differences
are indexed.  Members stand in these index lists in the order of |D|, and blocks of a list whose
positions differ by more than the similarity allows are skipped.  Pairs of two sets that both link
to the leader are answered already.  A leader of many members is dealt to blocks of a bounded number of
tokens; only members that don't link to it are sent to the other blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..session import written
from .shared import components, sent_if_small

WORDS = 3
PERCENT = 90
#: Members of a leader, and tokens of them, in one block.
BLOCK, BLOCK_TOKENS = 4096, 1 << 19
#: Keys that a task holds before it deals them out, and keys in one bucket.
HELD, BUCKET = 1 << 18, 1 << 20
#: Lists of so many sets or more are alike: none is told to be more crowded than another.
CROWDED = 32
_LOW = (1 << 40) - 1


def shingles(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of all distinct shingles, sorted by both; fewer than k words make one token."""
    w = W.words_of(column, W.SPACED, lower=True)
    at, h = w.windows(k)
    doc, parts = [w.doc[at]], [h]
    first, n = w.first(), w.counts
    for size in range(1, k):
        own = np.flatnonzero(n == size)
        if len(own):
            run = w.hash[first[own]]
            for j in range(1, size):
                run = W.join_hash(run, w.hash[first[own] + j])
            doc.append(own)
            parts.append(W.mix(run, 100 + size))
    doc, token = np.concatenate(doc), np.concatenate(parts)
    if len(parts) > 1:
        order = np.argsort(doc, kind="stable")
        doc, token = doc[order], token[order]
    order = W.sort_within(doc, token)
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


class Classes:
    """Size classes and their numbers of segments for a similarity in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        # sets of fewer tokens are linked only if they are equal
        bounds = [next(s for s in range(1, 10_000) if self.differ(2 * s + 1) >= 1)]
        while bounds[-1] < 1 << 40:
            bounds.append(-(-bounds[-1] * 3 // 2))
        self.bounds = np.array(bounds)
        most = np.array([self.differ(2 * (b - 1)) for b in bounds[1:]])
        #: So many segments more than needed agree, unless they are empty in both sets.
        self.spare = np.maximum(most // 2, 1)
        # more where the least sets of a class leave more segments empty: lists of those would hold much of the class
        few, spare = self.bounds[:-1] > 0, self.spare
        while few.any():
            m = most + 1 + spare
            empty = m * np.exp(-self.bounds[:-1] / m)
            few = (spare < empty + 2 * np.sqrt(empty)) & (spare < self.bounds[:-1])
            spare = spare + few * np.maximum(spare // 8, 1)
        self.spare = np.where(spare < self.bounds[:-1], spare, np.minimum(self.spare, 3))
        self.segments = most + 1 + self.spare

    def differ(self, sizes: int) -> int:
        """The most tokens in which two linked sets of together `sizes` tokens differ."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def keys(self, doc: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, up) of the lists that each set belongs to, in its own class (up 0) and the next one (up 1).

        And for either, of so many of its lists each set needs not be a member."""
        docs, keys, ups, left = [], [], [], np.zeros((2, len(n)), np.int64)
        own = np.searchsorted(self.bounds, n, side="right") - 1
        place, salt = W.mix(token, 11) >> np.uint64(32), W.mix(token, 12)
        for up in (0, 1):
            c = own + up
            # in the next class too, if a partner can be there
            used = (own >= 0) if not up else (own >= -1) & (n * 100 // self.percent >= self.bounds[c]) & (n > 0)
            m = np.where(used, self.segments[np.where(used, c, 0)], 0)
            base = np.cumsum(m) - m
            inside = used[doc]
            flat = base[doc[inside]] + ((place[inside] * m[doc[inside]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(flat, minlength=m.sum())
            # tokens of one segment need not adjoin, so contents are sums
            content = np.zeros(len(count), np.uint64)
            np.add.at(content, flat, salt[inside])
            of = np.repeat(np.arange(len(n)), m)
            segment = np.arange(len(content)) - base[of]
            empty = np.bincount(of[count == 0], minlength=len(n))
            spare = self.spare[np.maximum(c, 0)]
            out = (count > 0) | (empty > spare)[of]
            label = W.mix((c[of] << 32 | segment).astype(np.uint64), 13)
            # segments empty in both sets agree too, but make no list
            left[up] = np.where(used, np.maximum(spare - empty, 0), 0)
            docs.append(of[out])
            keys.append(W.join_hash(label, content + count.astype(np.uint64))[out])
            ups.append(np.full(len(docs[-1]), up, np.uint8))
        return np.concatenate(docs), np.concatenate(keys), np.concatenate(ups), left


def _describe(part: pa.RecordBatch, text: str, words: int, classes: Classes):
    """Of a chunk: (set sizes, two fingerprints of the sets, and what Classes.keys() gives)."""
    doc, token = shingles(part.column(text), words)
    rows = part.num_rows
    n, f1, f2 = np.bincount(doc, minlength=rows), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(f1, doc, W.mix(token, 21))
    np.add.at(f2, doc, W.mix(token, 22))
    return n, f1.view(np.int64), f2.view(np.int64), classes.keys(doc, token, n)


def describe_sets(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, n_shingles, f1, f2, n_keys, left0, left1) of each row: set size, a 128-bit fingerprint of the set, its lists, and how many of them it may leave."""
    classes = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            n, f1, f2, (of, _, _, left) = _describe(part, text, words, classes)
            yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, (n, f1, f2, np.bincount(of, minlength=len(n)), left[0], left[1]))], names=["id", "n_shingles", "f1", "f2", "n_keys", "left0", "left1"])

    own = docs.select(F.col(doc_id).alias("id"), text)
    schema = own.select("id").schema
    for c in ("n_shingles", "f1", "f2", "n_keys", "left0", "left1"):
        schema = schema.add(c, "long")
    return own.mapInArrow(run, schema)


_DEALT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("base", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "ids", "ups", "hot"))])
_SHARED = "key long, id long, c int, up int"


class KeyDealer:
    """Gathers (key, id, up) and deals them out by ranges of keys, as packed rows of 5 + 4 (or 8) + 1 bytes an entry."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, ups: np.ndarray) -> None:
        self.parts.append((keys, ids, ups))
        self.size += len(keys)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def label(self, keys: np.ndarray) -> np.ndarray:
        """What is left of a key: its bucket and 40 bits.  Keys that coincide cost a comparison, nothing else."""
        return (self.bucket(keys) << 40) | (keys & np.uint64(_LOW)).astype(np.int64)

    def deal(self) -> pa.RecordBatch:
        """Rows by bucket.  Entries of keys that are crowded here already are settled: they go to negative
        buckets, and only their keys, as `hot`, to the others."""
        k, i, u = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8))
        self.parts, self.size = [], 0
        order = np.argsort(k)
        k, i, u = k[order], i[order], u[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(k) else np.empty(0, np.int64)
        crowded = count >= CROWDED
        hot = k[new & crowded]
        hot_bucket = self.bucket(hot)
        rows = {c: [] for c in _DEALT.names}

        def add(bucket: int, keys: bytes, ids: np.ndarray, ups: np.ndarray, hot: bytes) -> None:
            base = int(ids.min()) if len(ids) else 0
            near = not len(ids) or int(ids.max()) - base < 1 << 32
            for c, v in zip(_DEALT.names, (bucket, base, keys, ((ids - base).astype("<u4") if near else ids.astype("<i8")).tobytes(), ups.tobytes(), hot), strict=True):
                rows[c].append(v)

        plain = ~crowded
        k0, i0, u0 = k[plain], i[plain], u[plain]
        low = np.ascontiguousarray((k0 & np.uint64(_LOW)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        bucket = self.bucket(k0)
        used = np.union1d(bucket, hot_bucket)
        cuts, hot_cuts = (np.searchsorted(b, np.append(used, self.buckets)) for b in (bucket, hot_bucket))
        for n, b in enumerate(used.tolist()):
            a, z = cuts[n], cuts[n + 1]
            add(b, low[a:z].tobytes(), i0[a:z], u0[a:z], (hot[hot_cuts[n] : hot_cuts[n + 1]] & np.uint64(_LOW)).tobytes())
        k1, i1, u1 = self.label(k[crowded]), i[crowded], u[crowded]
        for a in range(0, len(k1), 1 << 16):
            z = a + (1 << 16)
            add(-1 - int(k1[a] % self.buckets), k1[a:z].tobytes(), i1[a:z], u1[a:z], b"")
        return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(_DEALT.names, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=_DEALT.names)


def _shared_lists(dealt: DataFrame) -> DataFrame:
    """(key, id, c, up): entries of keys that occur more than once; c: how often, CROWDED at most."""

    def ids_of(base: int, raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, "<i8") if len(raw) == 8 * n else np.frombuffer(raw, "<u4").astype(np.int64) + base

    def batch(k: np.ndarray, i: np.ndarray, c: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(c.astype(np.int32)), pa.array(u.astype(np.int32))], names=["key", "id", "c", "up"])

    def settle(bucket: int, held: list) -> pa.RecordBatch:
        k, i, u = (np.concatenate(x) for x in zip(*((h[0], h[1], h[2]) for h in held), strict=True))
        hot = np.unique(np.concatenate([h[3] for h in held]))
        order = np.argsort(k)
        k, i, u = k[order], i[order], u[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        group = np.cumsum(new) - 1
        c = np.minimum(np.bincount(group)[group], CROWDED) if len(k) else np.empty(0, np.int64)
        if len(hot) and len(k):
            c[hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k] = CROWDED
        out = c > 1
        return batch((bucket << 40) | k[out], i[out], c[out], u[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for bucket, base, keys, ids, ups, hot in zip(*(b.column(c).to_pylist() for c in _DEALT.names), strict=True):
                u = np.frombuffer(ups, np.uint8)
                i = ids_of(base, ids, len(u))
                if bucket < 0:
                    yield batch(np.frombuffer(keys, np.int64), i, np.full(len(u), CROWDED), u)
                    continue
                if bucket != now and held:
                    yield settle(now, held)
                    held = []
                now = bucket
                wide = np.zeros((len(u), 8), np.uint8)
                wide[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
                held.append((wide.view("<i8").ravel(), i, u, np.frombuffer(hot, np.int64)))
        if held:
            yield settle(now, held)
        held.clear()
        W.release()

    return dealt.mapInArrow(run, _SHARED)


def shared_lists(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, buckets: int) -> DataFrame:
    """(key, id, c, up) of the lists of two sets or more; of equal sets in a chunk, those of the least id only."""
    classes = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = KeyDealer(buckets)
        for part in W.chunks(batches, text):
            n, f1, f2, (of, keys, ups, _) = _describe(part, text, words, classes)
            ids = part.column("id").to_numpy()
            order = np.lexsort((ids, n, f2, f1))
            own = np.zeros(len(n), bool)
            own[order] = np.concatenate([[True], (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1]) | (n[order][1:] != n[order][:-1])])
            kept = own[of]
            dealer.add(keys[kept], ids[of[kept]], ups[kept])
            if dealer.size > HELD:
                yield dealer.deal()
        yield dealer.deal()

    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text)
    return _shared_lists(W.dealt(own.mapInArrow(run, _DEALT), buckets))


def link_group(ids: list, sets: list[np.ndarray], lead: int, percent: int, queries: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray]:
    """Pairs (id, id) that span the components of a leader's members, and the places of those that don't link to it.

    sets: sorted distinct tokens.  lead: the leader's place.  queries: members that are only compared with those
    that are none (and the leader); without them all are compared with all."""
    m, n = len(ids), np.array([len(s) for s in sets])
    root = np.arange(m)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    linked = lambda inter, total: 100 * inter >= percent * (total - inter)
    leader = sets[lead]
    token, member = np.concatenate(sets), np.repeat(np.arange(m), n)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.minimum(np.searchsorted(leader, token), len(leader) - 1)
    shared = leader[at] == token
    inter = np.bincount(member[shared], minlength=m)
    near = linked(inter, n + len(leader))
    root[near] = lead
    open_ = np.flatnonzero(~near)
    asked = open_ if queries is None else open_[queries[open_]]
    if len(asked) and m > 2:
        # differences from the leader: own tokens, and tokens of the leader that are missing
        gone, gone_member, step = [], [], max(1, (1 << 22) // len(leader))
        for a in range(0, m, step):
            b = min(a + step, m)
            miss, own = np.ones((b - a, len(leader)), bool), slice(first[a], first[b])
            miss[member[own][shared[own]] - a, at[own][shared[own]]] = False
            x, y = np.nonzero(miss)
            gone_member.append(x + a)
            gone.append(y)
        d_token = np.concatenate([token[~shared], leader[np.concatenate(gone)]])
        d_member = np.concatenate([member[~shared], *gone_member])
        size = np.bincount(d_member, minlength=m)
        order = np.argsort(size, kind="stable")  # a member's position in all lists
        position = np.empty(m, np.int64)
        position[order] = np.arange(m)
        _, code, df = np.unique(d_token, return_inverse=True, return_counts=True)
        useful = df[code] > 1
        code, d_member = code[useful], d_member[useful]
        entry = np.sort(code.astype(np.int64) * m + position[d_member])
        own_code = code[np.argsort(d_member, kind="stable")]
        own_first = np.concatenate([[0], np.cumsum(np.bincount(d_member, minlength=m))])
        sizes = size[order]
        for y in asked.tolist():
            # |D(y) xor D(z)| is at least the difference of the sizes: other blocks of the lists are skipped
            reach = (n[y] + n[y] * 100 // percent) * (100 - percent) // (100 + percent)
            low, high = np.searchsorted(sizes, size[y] - reach), np.searchsorted(sizes, size[y] + reach, side="right")
            codes = own_code[own_first[y] : own_first[y + 1]].astype(np.int64) * m
            a, b = np.searchsorted(entry, codes + low), np.searchsorted(entry, codes + high)
            count = b - a
            place = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(entry[place] % m - low, minlength=high - low)
            z = order[low:high]
            both = (n[y] + n[z] - (size[y] + size[z] - 2 * common)) // 2
            hit = z[linked(both, n[y] + n[z]) & (z != y)]
            for other in (hit if queries is None else hit[~queries[hit]]).tolist():
                p, q = find(y), find(other)
                if p != q:
                    root[max(p, q)] = min(p, q)
    return [(ids[k], ids[r]) for k in range(m) if (r := find(k)) != k and ids[k] != ids[r]], open_


def _link_tasks(rows: DataFrame, percent: int, id_type: T.DataType) -> DataFrame:
    """(a, b, leader): links (leader null), and members a that don't link to their leader (b null), of leaders of several blocks.

    rows: (leader, block, ask, id, query, several, tokens), sorted so that a task's rows adjoin."""
    names = ("a", "b", "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, kind = None, [], [], None

        def close() -> None:
            own = [r for r in held if len(r[3])]  # a row without tokens that shares its id with one that has some
            # without its leader's text (a row that is gone) the members still need an anchor
            lead = next((k for k, r in enumerate(own) if r[0] == key[0]), 0)
            if len(own) > 1:
                queries = np.array([r[1] for r in own])
                pairs, open_ = link_group([r[0] for r in own], [r[3] for r in own], lead, percent, queries if queries.any() else None)
                out.extend((a, b, None) for a, b in pairs)
                if own[0][2] and not queries.any():
                    out.extend((own[k][0], None, key[0]) for k in open_.tolist())

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k in range(3)], names=names)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("id").type
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                columns = [part.column(c).to_pylist() for c in ("leader", "block", "ask", "id", "query", "several", "tokens")]
                for leader, block, ask, own, query, several, raw in zip(*columns, strict=True):
                    if key != (leader, block, ask):
                        if held:
                            close()
                        key, held = (leader, block, ask), []
                    held.append((own, query, several, np.frombuffer(raw, "<u8")))
            yield made()
        if held:
            close()
            yield made()
        held.clear()
        W.release()

    return rows.mapInArrow(run, T.StructType([T.StructField(c, id_type) for c in names]))


def _tokens(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The rows of ids with the `tokens` of the documents of that id.

    A sort-merge join at every size: ids grow with the documents, and sent to all tasks on small tables only they
    would hide the shuffle of the texts that large ones take."""
    names = ids.columns
    texts = docs.select(F.col(doc_id).alias("id"), text).join(ids.hint("merge"), "id").select(text, *names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            doc, token = shingles(part.column(text), words)
            raw, ends = token.astype("<u8").tobytes(), (np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]) * 8).tolist()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=[*names, "tokens"])

    return texts.mapInArrow(pack, texts.select(names).schema.add("tokens", "binary"))


def _by_document(tasks: DataFrame) -> DataFrame:
    """(id, tasks) of tasks (id, leader, block, ask, query, several)."""
    return written(tasks.groupBy("id").agg(F.collect_list(F.struct("leader", "block", "ask", "query", "several")).alias("tasks")), "tasks")


def _link(packed: DataFrame, percent: int) -> DataFrame:
    """_link_tasks() of (id, tasks, tokens)."""
    rows = packed.select("id", "tokens", F.explode("tasks").alias("t")).select("t.*", "id", "tokens")
    grouped = rows.repartition("leader", "block", "ask").sortWithinPartitions("leader", "block", "ask", "id")
    return _link_tasks(grouped, percent, packed.schema["id"].dataType)


def find_links(docs: DataFrame, sets: DataFrame, *, doc_id: str, text: str, words: int, percent: int, block: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(a, b): links that span every component of documents within the similarity."""
    kind = sets.schema["id"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{doc_id} must hold integers")
    usable = sets.where("id is not null and n_shingles > 0")
    firsts = written(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.first("left0").alias("left0"), F.first("left1").alias("left1")), "firsts")
    copies = usable.select("id", "f1", "f2", "n_shingles").join(firsts.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    n_keys = usable.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // BUCKET))
    shared = shared_lists(docs, doc_id, text, words, percent, buckets)
    # of texts that share an id, what the least of them may leave
    reps = firsts.groupBy(F.col("rep").alias("id")).agg(F.min("left0").alias("left0"), F.min("left1").alias("left1"), F.sum("n_shingles").alias("n"))
    own = shared.withColumn("id", F.col("id").cast(kind)).join(reps, "id")
    # in one order for all sets, so that what either of two linked sets leaves out is less than what they share
    rank = F.row_number().over(Window.partitionBy("id", "up").orderBy(F.desc("c"), "key"))
    kept = written(own.withColumn("rank", rank).where(F.col("rank") > F.when(F.col("up") == 0, F.col("left0")).otherwise(F.col("left1"))).select("key", "id", "n"), "kept")
    leaders = written(kept.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("leader")).where("c > 1").select("key", "leader"), "leaders")
    members = written(kept.join(leaders, "key").select("leader", "id", "n").distinct(), "members")

    # leaders of several blocks have many members each, so they are few
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_tokens)).cast("int")
    large = written(members.groupBy("leader").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    dealt = members.join(sent_if_small(large, 40), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a leader is in all of its blocks
    at = F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own_block))
    tasks = dealt.select("id", "leader", F.explode(at).alias("block"), F.lit(0).alias("ask"), F.lit(False).alias("query"), (F.col("blocks") > 1).alias("several"))
    packed = _tokens(docs, _by_document(tasks), doc_id, text, words)
    if not large.isEmpty():  # tokens may be asked for again
        packed = written(packed, "tokens")
    found = written(_link(packed, percent), "links")
    links = copies.unionByName(found.where("b is not null").select("a", "b"))
    open_ = found.where("b is null").select("leader", F.col("a").alias("id")).distinct()
    if open_.isEmpty():
        return links
    # what doesn't link to its leader is compared with the other blocks too, as many at once as a block holds
    open_ = written(open_.join(members, ["leader", "id"]), "open")
    asks = open_.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_tokens)).cast("int").alias("asks"))
    asked = dealt.join(sent_if_small(written(asks, "asks"), 40), "leader").join(open_.select("leader", "id", F.lit(True).alias("open")), ["leader", "id"], "left")
    struct = lambda b, q, query: F.struct(b.alias("block"), q.alias("ask"), F.lit(query).alias("query"))
    every, turns = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("asks") - 1)
    target = F.flatten(F.transform(at, lambda b: F.transform(turns, lambda q: struct(b, q, False))))
    own_ask = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("asks")).cast("int")
    query = F.when(F.col("open"), F.transform(F.filter(every, lambda b: b != own_block), lambda b: struct(b, own_ask, True)))
    each = asked.select("id", "leader", F.explode(F.concat(target, F.coalesce(query, F.expr("cast(array() as array<struct<block:int,ask:int,query:boolean>>)")))).alias("t"))
    across = each.select("id", "leader", "t.block", "t.ask", "t.query", F.lit(False).alias("several"))
    again = packed.select("id", "tokens").join(_by_document(across).hint("merge"), "id")
    return links.unionByName(_link(again, percent).where("b is not null").select("a", "b"))


def join_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least id reachable by links, itself included.  Null and empty texts have no
    shingles and no links.  Ids are integers; rows that share one are one node with the links of all of
    them; a null id has a null component.  An empty table gives no rows.
    """
    sets = written(describe_sets(docs, doc_id, text, words, percent), "sets")
    links = find_links(docs, sets, doc_id=doc_id, text=text, words=words, percent=percent, block=block, block_tokens=block_tokens)
    groups = components(links, "ngram")
    out = sets.select("id", "n_shingles").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("component", "id").alias("component_id"))
