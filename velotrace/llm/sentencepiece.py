"""SentencePiece encoding and decoding by an Aho-Corasick single-pass Viterbi.

The automaton holds all ordinary pieces. While it reads a text once, it names
at every position all pieces that end there, longest first, by following its
output links; each relaxes the best score at its end from the best score at
its start. A position that no piece of one character covers takes the byte
pieces of its character at the worst score less 10. At equal scores the longer
last piece stays.

No piece of the vocabulary crosses from another character into the word mark,
or holds a line feed (this is checked when it is loaded), so the best path of
a text is that of its pre-tokens one after the other, and each worker keeps
the paths of distinct pre-tokens in a bounded store. Whole texts are encoded.

Defined results: null or empty text has no pieces; text that holds the word
mark itself decodes to a blank there. Repeated rows get equal results; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A pre-token: word marks with what follows up to the next mark, or a line feed.
_PRE = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Longer runs are pre-tokens like any other, but their paths are not stored.
_LONG, _KEEP = 200, 150_000
#: Characters of pre-tokens that are read together.
_TOGETHER = 100_000
#: In place of the id of a piece: the bytes of one character.
_BYTES = -1


@dataclass
class Pieces:
    """Vocabulary: piece -> (id, score); ids of the 256 byte pieces; bytes of every id; the unknown score."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    raw: list[bytes]
    unknown: float
    #: Of every id: what it adds to a path's score, and whether it is a byte piece.
    scores: np.ndarray = field(init=False)
    is_byte: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.scores, self.is_byte = np.zeros(len(self.raw)), np.zeros(len(self.raw), bool)
        for i, s in self.pieces.values():
            self.scores[i] = s
        self.is_byte[self.byte_ids] = True
        for byte, i in enumerate(self.byte_ids):  # a character counts once, at its leading byte
            self.scores[i] = 0.0 if byte & 0xC0 == 0x80 else self.unknown
        for p in self.pieces:
            if "\n" in p or re.search(f"[^{MARK}]{MARK}", p):
                raise ValueError(f"piece {p!r} crosses pre-tokens")


@lru_cache(maxsize=2)
def load(model: str = DEFAULT_MODEL) -> Pieces:
    """Read a model file on the driver."""
    import sentencepiece as spm

    m = spm.SentencePieceProcessor(model_file=model)
    pieces, raw, byte_ids = {}, [b""] * m.get_piece_size(), [0] * 256
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            raw[i] = bytes([int(p[1:-1], 16)])
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces[p] = i, m.get_score(i)
            raw[i] = p.replace(MARK, " ").encode()
    return Pieces(pieces, byte_ids, raw, min(s for _, s in pieces.values()) - 10)


def shipped(spark: SparkSession, model: str = DEFAULT_MODEL) -> Broadcast:
    """The vocabulary for all workers; its size is that of the model file, whatever the data."""
    return spark.sparkContext.broadcast(load(model))


def pre_tokens(text: str | None) -> list[str]:
    """Blanks become word marks, one is put in front; the parts join to the whole."""
    return _PRE.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """The automaton of a vocabulary and the store of pre-tokens of one worker."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for p, (i, s) in vocabulary.pieces.items():
            self.automaton.add_word(p, (len(p), i, s))
        self.automaton.make_automaton()
        self.sizes = {i: len(p) for p, (i, _) in vocabulary.pieces.items()}
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, text: str) -> array:
        """Ids of the best path. A position takes 12 bytes: its score and the id of the piece that ends there."""
        n, sizes = len(text), self.sizes
        best, back = array("d", [-np.inf]) * (n + 1), array("i", [_BYTES]) * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for last, (size, i, score) in self.automaton.iter(text):
                end = last + 1
                s = best[end - size] + score
                if s > best[end]:
                    best[end], back[end] = s, i
        else:
            done = 0
            for last, (size, i, score) in self.automaton.iter(text):
                if last > done:  # nothing more ends before this position
                    self._fall_back(text, best, back, done, last)
                    done = last
                s = best[last + 1 - size] + score
                if s > best[last + 1]:
                    best[last + 1], back[last + 1] = s, i
            self._fall_back(text, best, back, done, n)
        ids, at = array("i"), n
        while at:
            i = back[at]
            if i == _BYTES:
                ids.extend([self.v.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))])
                at -= 1
            else:
                ids.append(i)
                at -= sizes[i]
        ids.reverse()
        return ids

    def paths(self, words: list[str]) -> list[bytes]:
        """Ids (32 bits each) of the best paths of pre-tokens of pieces' characters alone, in one reading.

        No piece holds a line feed, so none crosses from one to the next where they are joined by line feeds.
        """
        sizes, text = self.sizes, "\n".join(words)
        best, back = [-np.inf] * (len(text) + 1), [_BYTES] * (len(text) + 1)
        at, ends = 0, []
        for w in words:
            best[at] = 0.0
            ends.append(at + len(w))
            at += len(w) + 1
        for last, (size, i, score) in self.automaton.iter(text):
            end = last + 1
            s = best[end - size] + score
            if s > best[end]:
                best[end], back[end] = s, i
        out, start = [], 0
        for end in ends:
            ids, at = [], end
            while at > start:
                i = back[at]
                ids.append(i)
                at -= sizes[i]
            ids.reverse()
            out.append(array("i", ids).tobytes())
            start = end + 1
        return out

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """The young generation, with all ``words`` in it."""
        young, old, single = self.young, self.old, self.single
        missing = words.difference(young)
        new = missing.difference(old)
        young.update((w, old[w]) for w in missing.difference(new))
        plain = [w for w in new if single.issuperset(w)]
        for a, b in slices(plain, _TOGETHER):
            young.update(zip(plain[a:b], self.paths(plain[a:b]), strict=True))
        young.update((w, self.viterbi(w).tobytes()) for w in new.difference(plain))
        self.long = [w for w in new if len(w) > _LONG]
        return young

    def _age(self) -> None:
        """Let long pre-tokens go, and the old generation once the young one is full."""
        for w in self.long:
            del self.young[w]
        if len(self.young) > _KEEP:
            self.old, self.young = self.young, {}

    def _fall_back(self, text: str, best: array, back: array, done: int, upto: int) -> None:
        """Bytes for the characters after ``done`` that are no piece themselves."""
        for end in range(done + 1, upto + 1):
            if text[end - 1] not in self.single and (s := best[end - 1] + self.v.unknown) > best[end]:
                best[end], back[end] = s, _BYTES

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, int, float]]:
        """(ids, byte pieces, score) of each text; each distinct pre-token's path is found once."""
        words = [pre_tokens(t) for t in texts]
        known = self._known(set(chain.from_iterable(words)))
        out = []
        for own in words:
            ids = np.frombuffer(b"".join(map(known.__getitem__, own)), np.int32)
            out.append((ids, int(self.v.is_byte[ids].sum()), float(self.v.scores[ids].sum())))
        self._age()
        return out


def decode_ids(raw: list[bytes], ids) -> str:
    """Text of ids; the blank put in front of the first word is taken off, ids without bytes are skipped."""
    data = b"".join([raw[i] for i in ids])
    return data.removeprefix(b" ").decode("utf-8", "replace")


_WORKER: dict[int, Encoder] = {}


def _encoder(vocabulary: Pieces) -> Encoder:
    key = id(vocabulary)
    if key not in _WORKER or _WORKER[key].v is not vocabulary:
        _WORKER.clear()
        _WORKER[key] = Encoder(vocabulary)
    return _WORKER[key]


def encoder(vocabulary: Broadcast):
    """Column function: text -> struct(ids, n_byte_pieces, score)."""

    @F.pandas_udf("ids array<int>, n_byte_pieces int, score double")
    def encode(texts: pd.Series) -> pd.DataFrame:
        e, whole, rows = _encoder(vocabulary.value), texts.tolist(), []
        for a, b in slices(whole, 1_000_000):
            rows += e.encode(whole[a:b])
        return pd.DataFrame(rows, columns=["ids", "n_byte_pieces", "score"])

    return lambda text: encode(F.coalesce(text, F.lit("")))


def decoder(vocabulary: Broadcast):
    """Column function: ids -> text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        raw = vocabulary.value.raw
        return pd.Series([decode_ids(raw, ids.tolist()) for ids in rows], dtype=object)

    return lambda ids: decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, n_pieces, n_byte_pieces, score`` of every row."""
    bounded_batches(docs.sparkSession)
    vocabulary = shipped(docs.sparkSession, model)
    coded = docs.select(quoted(id_col).alias("id"), encoder(vocabulary)(quoted(text_col)).alias("e")).select("id", "e.*")
    return coded.select(F.col("id").alias(id_col), "ids", F.size("ids").alias("n_pieces"), "n_byte_pieces", "score")


def decode(coded: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """All columns of ``coded`` and ``text``, the decoded ids."""
    return coded.withColumn("text", decoder(shipped(coded.sparkSession, model))(F.col(ids_col)))
