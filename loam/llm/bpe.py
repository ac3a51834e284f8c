"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

For a pre-token, leaf i of the tree holds (rank of the pair that starts at symbol i, i), or infinity
where no merge is known.  The root is then the leftmost pair of lowest rank.  A merge changes three
leaves, each an O(log n) update of its ancestors, and goes on until the root is infinity.

Pre-tokens of up to 64 bytes are merged side by side, as rows of numpy arrays with one tree each;
longer ones take the same steps alone.  Results are kept in a cache of the Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import texts_of
from .words import byte_letters

#: Pre-tokens in a worker's cache, at most.  When its younger half is full it becomes the older one, and the older one goes.
CACHE_SIZE = 1 << 19
#: Tree sizes of pre-tokens that are merged side by side, and rows in one such step.
SIZES = (8, 16, 32, 64)
ROWS = 1 << 13
#: Pre-tokens of more characters are not kept in the cache.
LONG = 64
_NONE = np.iinfo(np.int64).max

_SIMPLE = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-ſ‐-‧‰-⁞]*")
_ODD = re.compile(r"[\xb2\xb3\xb9\xbc-\xbe]")
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[0-9]+| ?[^\s{0}0-9]+|\s+(?!\S)|\s+"
_ASCII_CUT, _LATIN_CUT = re.compile(_CUT.format("A-Za-z")), re.compile(_CUT.format(_LATIN))


class Codec:
    """Encoder and decoder for a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        content = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content |= {i: token.encode() for token, i in self.special.items()}
        self._split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        byte = {letters[t]: i for t, i in vocab.items() if len(t) == 1 and t in letters}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([vocab["".join(m)] for m in merges], np.int64)
        keys = (left << 32) | right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.ranks = dict(zip(zip(left.tolist(), right.tolist(), strict=True), range(len(merges)), strict=True))
        sizes = np.zeros(max(content) + 1, np.int64)
        sizes[list(content)] = [len(x) for x in content.values()]
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(content[i] for i in sorted(content)), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.path, self.tokenizer = path, None

    # -- cutting

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            if text.isascii():
                return _ASCII_CUT.findall(text)
            if _SIMPLE.fullmatch(text) and not _ODD.search(text):
                return _LATIN_CUT.findall(text)
        if self.tokenizer is None:  # other scripts are cut by the library itself, for its Unicode tables
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        letters = byte_letters()
        return [bytes(letters[c] for c in piece).decode() for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    # -- merging

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def _merge_rows(self, pieces: list[bytes], n: int) -> list[bytes]:
        """Ids of pieces of at most n bytes, as little-endian 32-bit integers."""
        rows, length = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(rows, n)
        symbol = self.byte_ids[raw]
        alive = np.arange(n) < length[:, None]
        leaf = np.full((rows, n), _NONE)
        rank = self._rank(symbol[:, :-1], symbol[:, 1:])
        leaf[:, :-1] = np.where((rank >= 0) & alive[:, 1:], rank * n + np.arange(n - 1), _NONE)
        tree = np.empty((rows, 2 * n), np.int64)
        tree[:, n:] = leaf
        level = n
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        tree[:, 0] = _NONE
        after = np.broadcast_to(np.arange(1, n + 1), (rows, n)).copy()
        after[after >= length[:, None]] = n
        before = np.broadcast_to(np.arange(-1, n - 1), (rows, n)).copy()
        symbol, alive, tree, after, before = (x.reshape(-1) for x in (symbol, alive, tree, after, before))
        live = np.arange(rows)
        while True:
            root = tree[live * 2 * n + 1]
            live, root = live[root != _NONE], root[root != _NONE]
            if not len(live):
                break
            base, top = live * n, live * 2 * n
            at, made = root % n, self.made[root // n]
            right = after[base + at]
            beyond = after[base + right]
            symbol[base + at] = made
            alive[base + right] = False
            after[base + at] = beyond
            inner = beyond < n
            before[base[inner] + beyond[inner]] = at[inner]
            prior = before[base + at]
            outer = prior >= 0
            new = np.full(len(live), _NONE)
            rank = self._rank(made[inner], symbol[base[inner] + beyond[inner]])
            new[inner] = np.where(rank >= 0, rank * n + at[inner], _NONE)
            self._update(tree, top, n, right, np.full(len(live), _NONE))
            self._update(tree, top, n, at, new)
            rank = self._rank(symbol[base[outer] + prior[outer]], made[outer])
            self._update(tree, top[outer], n, prior[outer], np.where(rank >= 0, rank * n + prior[outer], _NONE))
        ids = symbol[alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(alive.reshape(rows, n).sum(1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _update(tree: np.ndarray, top: np.ndarray, n: int, leaf: np.ndarray, value: np.ndarray) -> None:
        node = n + leaf
        tree[top + node] = value
        while n > 1:
            n //= 2
            value = np.minimum(value, tree[top + (node ^ 1)])
            node = node >> 1
            tree[top + node] = value

    def _merge_one(self, piece: bytes) -> bytes:
        """The same for one long pre-token."""
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        count, n = len(symbol), 1
        while n < count:
            n *= 2
        get, made, none = self.ranks.get, self.made, _NONE
        tree = [none] * (2 * n)
        for k in range(count - 1):
            rank = get((symbol[k], symbol[k + 1]))
            if rank is not None:
                tree[n + k] = rank * n + k
        for k in range(n - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))

        def update(leaf: int, value: int) -> None:
            node = n + leaf
            tree[node] = value
            while node > 1:
                value = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] != none:
            rank, at = divmod(tree[1], n)
            right = after[at]
            beyond, prior = after[right], before[at]
            symbol[at], symbol[right] = int(made[rank]), -1
            after[at] = beyond
            update(right, none)
            rank = None
            if beyond < count:
                before[beyond] = at
                rank = get((symbol[at], symbol[beyond]))
            update(at, none if rank is None else rank * n + at)
            if prior >= 0:
                rank = get((symbol[prior], symbol[at]))
                update(prior, none if rank is None else rank * n + prior)
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        raw = {p: p.encode() for p in pieces}
        low = 0
        for n in SIZES:
            own = [p for p in pieces if low < len(raw[p]) <= n]
            for k in range(0, len(own), ROWS):
                some = own[k : k + ROWS]
                self.cache.update(zip(some, self._merge_rows([raw[p] for p in some], n), strict=True))
            low = n
        self.cache.update((p, self._merge_one(x)) for p, x in raw.items() if len(x) > low)

    # -- whole texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; special strings are single tokens."""
        parts = []
        for x in texts:
            specials = [m.group() for m in self._split.finditer(x)]
            plain = self._split.split(x) if specials else [x]
            parts.append(([self.cut(p) if p else [] for p in plain], specials))
        seen = set(chain.from_iterable(chain.from_iterable(p for p, _ in parts)))
        missed = [p for p in seen if p not in self.cache]
        if len(self.cache) + len(missed) > CACHE_SIZE // 2:
            self.older, self.cache = self.cache, {}
            missed = list(seen)
        self.cache.update((p, self.older[p]) for p in missed if p in self.older)
        self._learn([p for p in missed if p not in self.cache])
        get, out = self.cache.__getitem__, []
        for plain, specials in parts:
            own = [b"".join(map(get, pieces)) for pieces in plain]
            ids = [np.array([self.special[s]], "<u4").tobytes() for s in specials]
            out.append(b"".join(chain.from_iterable(zip(own, [*ids, b""], strict=True))))
        for p in missed:
            if len(p) > LONG:
                del self.cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; bytes that are not UTF-8 become U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.sizes[i]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[i] - (ends - size), size)
        raw = self.blob[at].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


_workers: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python process, so that its cache outlives a task."""
    if path not in _workers:
        _workers[path] = Codec(path)
    return _workers[path]


def _columns(docs: DataFrame, make, column: str, names: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    keep = [c for c in docs.columns if c not in [n for n, _, _ in names]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts_of(batches, column):
            made = make(values)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, t) for x, (_, _, t) in zip(made, names, strict=True))], names=[*keep, *(n for n, _, _ in names)])

    schema = docs.select(keep).schema
    for n, spark_type, _ in names:
        schema = schema.add(n, T._parse_datatype_string(spark_type))
    return docs.select(list(dict.fromkeys([*keep, column]))).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of `text` as an array column.

    A null or empty text has no ids; repeated rows encode alike; an empty table gives no rows.  A
    column of docs named as `ids` is replaced.
    """
    make = lambda texts: [[np.frombuffer(x, "<u4").astype(np.int32) for x in codec(path).encode(texts)]]
    return _columns(docs, make, text, [(ids, "array<int>", pa.list_(pa.int32()))])


def decode(df: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that the array column `ids` stands for; null or empty ids give an empty text."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            made = [codec(path).decode(np.array(x or [], "<u4").tobytes()).decode() for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.string())], names=[*keep, text])

    return df.select(keep).mapInArrow(run, df.select(keep).schema.add(text, "string"))


def round_trip(docs: DataFrame, path: str, *, text: str = "text", ids: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded again.

    With `ids`, the token ids themselves are a column of this name.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in
    UTF-8.  Nulls, repeats and empty tables as in encode().
    """

    def make(texts: list[str]) -> list[list]:
        own = codec(path)
        coded = own.encode(texts)
        made = [[len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(own.decode(x)).hexdigest() for x in coded]]
        return [*made, [np.frombuffer(x, "<u4").astype(np.int32) for x in coded]] if ids else made

    names = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _columns(docs, make, text, [*names, (ids, "array<int>", pa.list_(pa.int32()))] if ids else names)
