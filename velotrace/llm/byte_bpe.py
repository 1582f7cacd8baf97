"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern into pre-tokens; one that is a token
itself is that token, any other starts as its bytes and is merged pair by
pair: always the pair of least rank, the leftmost of equals. The leaves of a
segment tree are the byte positions of a pre-token, each with the rank of the
pair that begins there, and every inner node has the least (rank, position)
below it, so the root names the next merge. A merge sets three leaves (the
merged pair, its live neighbour on the left, the position that dies), and each
of them is carried up to the root in as many steps as the tree has levels.

A worker keeps the ids of distinct pre-tokens in two bounded generations, and merges
those of a batch it does not know together: trees of one size stand in one
array, and each step performs the next merge of every unfinished one.

Whole texts are encoded, special tokens are ordinary text. Defined results:
null or empty text has no tokens; repeated rows get equal results; empty
tables give empty results; other columns are ignored by :func:`encode` and
kept by :func:`decode`. What is a letter or a number is as the installed
pattern library has it, so characters new in its version of Unicode may be cut
otherwise than by a library with an older one. A pre-token takes about 200 bytes of working memory for
each of its own bytes while it is merged; a text is taken in parts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_names, quoted, slices

#: Distinct pre-tokens with which a generation is full (it takes in the batch at hand first), the longest it keeps (in characters), and how many of
#: one text are taken at a time.
_KEEP, _LONG, _PART = 150_000, 200, 200_000
#: Bytes of pre-tokens that are merged together; wider trees than this are merged one by one.
_TOGETHER, _WIDE = 1 << 20, 1024
#: No pair: in 32 bits for trees of at most ``_WIDE`` leaves, else in 64.
_NONE, _BIG = np.iinfo(np.int32).max, np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Ranks: token -> id. Pairs: sorted codes of (left id, right id) and the ids they merge to."""

    ranks: dict[bytes, int]
    pattern: str
    raw: list[bytes] = field(init=False)
    codes: np.ndarray = field(init=False)
    merged: np.ndarray = field(init=False)
    singles: np.ndarray = field(init=False)
    #: Rank of every two bytes; no byte has number 256.
    bytes_rank: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        ranks = self.ranks
        self.raw = [b""] * (max(ranks.values()) + 1)
        if (len(self.raw) + 1) * _WIDE > _NONE:
            raise ValueError(f"{len(self.raw)} ranks are too many for trees of {_WIDE} leaves in 32 bits")
        for token, i in ranks.items():
            self.raw[i] = token
        found = {
            (ranks[token[:k]] << 32) | ranks[token[k:]]: i
            for token, i in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.codes = np.array(sorted(found), np.int64)
        self.merged = np.array([found[c] for c in self.codes.tolist()], np.int32)
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_rank = np.full((257, 257), _NONE, np.int32)
        for token, i in ranks.items():
            if len(token) == 2:
                self.bytes_rank[token[0], token[1]] = i

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, or ``_NONE``; ids below zero are no token."""
        code = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (right >= 0), self.merged[at], _NONE)


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """Read a rank file (a token in base64 and its rank a line) on the driver; the installed multilingual one by default."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Vocabulary(ranks, pattern)


def shipped(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Broadcast:
    """The vocabulary for all workers; its size is that of the rank file, whatever the data."""
    return spark.sparkContext.broadcast(load(path, pattern))


def merge(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids (32 bits each) of pre-tokens that are no token themselves, in the order given."""
    out = [b""] * len(words)
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_size.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
    for k in (k for width, own in by_size.items() if width > _WIDE for k in own):
        out[k] = _merge_tree(vocabulary, words[k])
    for width, own in ((width, own) for width, own in by_size.items() if width <= _WIDE):
        many = max(1, _TOGETHER // width)
        for start in range(0, len(own), many):
            part = own[start : start + many]
            ids, sizes = _merge_trees(vocabulary, [words[k] for k in part], width)
            data, at = ids.tobytes(), 0
            for k, end in zip(part, np.cumsum(sizes * ids.itemsize).tolist(), strict=True):
                out[k], at = data[at:end], end
    return out


def _merge_trees(v: Vocabulary, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """One segment tree of ``width`` leaves a word; all take their next merge in the same step. Ids one word after the other, and how many each has."""
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    places = np.arange(width, dtype=np.int32)
    inside = places < sizes[:, None]
    letters = np.full((n, width + 1), 256, np.int32)
    letters[:, :width][inside] = np.frombuffer(b"".join(words), np.uint8)
    # symbols by position, -1 where none begins; one more column stands for "no neighbour"
    ids = np.append(v.singles, np.int32(-1))[letters]
    after = np.where(places + 1 < sizes[:, None], places + 1, np.int32(width))
    before = np.full((n, width + 1), width, np.int32)
    before[:, 1:width] = places[:-1]
    tree = np.full((n, 2 * width), _NONE, np.int32)
    tree[:, width:] = _keys(v.bytes_rank[letters[:, :-1], letters[:, 1:]], places, width)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    live = np.arange(n)
    while True:
        live = live[tree[live, 1] != _NONE]
        if not len(live):
            break
        rank, at = np.divmod(tree[live, 1], width)
        dead = after[live, at]
        right, left = after[live, dead], before[live, at]
        ids[live, at], ids[live, dead] = rank, -1
        after[live, at] = right
        before[live, right] = at
        ids[live, width] = -1
        near = left < width
        rows, to = live[near], left[near]
        keys = [np.full(len(live), _NONE, np.int32), _keys(v.pair_ranks(rank, ids[live, right]), at, width)]
        keys.append(_keys(v.pair_ranks(ids[rows, to], rank[near]), to, width))
        _set(tree, np.concatenate([live, live, rows]), np.concatenate([dead, at, to]), np.concatenate(keys), width)
    begun = ids[:, :width] >= 0
    return ids[:, :width][begun].astype(np.int32), begun.sum(1)


def _merge_tree(v: Vocabulary, word: bytes) -> bytes:
    """The same tree for one long pre-token, in plain numbers."""
    n, ranks, raw = len(word), v.ranks, v.raw
    width = 1 << (n - 1).bit_length()
    ids, after, before = v.singles[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    ids.append(-1)
    tree = np.full(2 * width, _BIG, np.int64)
    ranks_here = v.bytes_rank[np.frombuffer(word[:-1], np.uint8), np.frombuffer(word[1:], np.uint8)].astype(np.int64)
    tree[width : width + n - 1] = np.where(ranks_here == _NONE, _BIG, ranks_here * width + np.arange(n - 1))
    for level in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
        tree[level : 2 * level] = tree[2 * level : 4 * level].reshape(-1, 2).min(1)
    tree = tree.tolist()

    def put(at: int, key: int) -> None:
        node = at + width
        tree[node] = key
        while node > 1:
            key = min(key, tree[node ^ 1])
            node >>= 1
            if tree[node] == key:
                break
            tree[node] = key

    def pair(at: int) -> int:
        to = after[at]
        rank = ranks.get(raw[ids[at]] + raw[ids[to]]) if to < n else None
        return _BIG if rank is None else rank * width + at

    while tree[1] != _BIG:
        rank, at = divmod(tree[1], width)
        dead = after[at]
        ids[at], ids[dead], after[at] = rank, -1, after[dead]
        if after[at] < n:
            before[after[at]] = at
        put(dead, _BIG)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return np.array([i for i in ids if i >= 0], np.int32).tobytes()


def _keys(ranks: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rank and position in one number, so that the least is the leftmost pair of least rank."""
    return np.where(ranks == _NONE, _NONE, ranks * np.int32(width) + at)


def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray, width: int) -> None:
    """Set leaves, all different, and renew the nodes above them level by level."""
    flat, begin, node = tree.reshape(-1), rows * (2 * width), at + width
    flat[begin + node] = keys
    while width > 1:
        node, width = node >> 1, width >> 1
        child = begin + 2 * node
        flat[begin + node] = np.minimum(flat[child], flat[child + 1])


class Encoder:
    """A vocabulary, its compiled pattern and the pre-tokens that one worker knows, in two generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cut = vocabulary, regex.compile(vocabulary.pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for a, b in slices(texts, 2_000_000):
            words = [self.cut.findall(t) if len(t) <= _PART else None for t in texts[a:b]]
            known = self._known(set(chain.from_iterable(own for own in words if own)))
            coded = [None if own is None else b"".join(map(known.__getitem__, own)) for own in words]
            self._age()
            for text, ids in zip(texts[a:b], coded, strict=True):
                yield np.frombuffer(b"".join(self._long(text)) if ids is None else ids, np.int32)

    def _long(self, text: str) -> Iterator[bytes]:
        matches = (m.group() for m in self.cut.finditer(text))
        while part := list(islice(matches, _PART)):
            yield b"".join(map(self._known(set(part)).__getitem__, part))
            self._age()

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """The young generation, with all ``words`` in it."""
        young, old = self.young, self.old
        missing = words.difference(young)
        new = missing.difference(old)
        young.update((w, old[w]) for w in missing.difference(new))
        new = list(new)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = list(map(self.v.ranks.get, raw))
        merged = iter(merge(self.v, [data for data, i in zip(raw, whole, strict=True) if i is None]))
        young.update((w, next(merged) if i is None else i.to_bytes(4, "little")) for w, i in zip(new, whole, strict=True))
        self.long = [w for w in new if len(w) > _LONG]
        return young

    def _age(self) -> None:
        """Let long pre-tokens go, and the old generation once the young one is full."""
        for w in self.long:
            del self.young[w]
        if len(self.young) > _KEEP:
            self.old, self.young = self.young, {}


_WORKER: list[Encoder] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if not _WORKER or _WORKER[0].v is not vocabulary:
        _WORKER[:] = [Encoder(vocabulary)]
    return _WORKER[0]


def encoder(vocabulary: Broadcast):
    """Column function: text -> ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_encoder(vocabulary.value).encode(texts.tolist())), dtype=object)

    return lambda text: encode(F.coalesce(text, F.lit("")))


def decoder(vocabulary: Broadcast):
    """Column function: ids -> bytes. An id that no token has is an error."""

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        raw = vocabulary.value.raw
        return pd.Series([b"".join(map(raw.__getitem__, ids.tolist())) for ids in rows], dtype=object)

    return lambda ids: decode(F.coalesce(ids, F.array().cast("array<int>")))


@F.pandas_udf(T.BinaryType())
def little_endian(rows: pd.Series) -> pd.Series:
    """Ids as unsigned 32-bit numbers, lowest byte first."""
    return pd.Series([ids.astype("<u4").tobytes() for ids in rows], dtype=object)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, n_tokens`` of every row."""
    bounded_batches(docs.sparkSession)
    ids = encoder(shipped(docs.sparkSession, path, pattern))
    coded = docs.select(quoted(id_col).alias("id"), ids(quoted(text_col)).alias("ids"))
    return coded.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"))


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of ``coded`` and, last, ``decoded`` (or a like name that is free): the bytes of the ids."""
    (name,) = free_names(coded, "decoded")
    return coded.withColumn(name, decoder(shipped(coded.sparkSession, path))(quoted(ids_col)))
