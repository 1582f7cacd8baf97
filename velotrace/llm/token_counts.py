"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a block of texts form a trie, which is walked depth
first: in sorted order, with the nodes of the current path on a stack. A node
stands for a prefix and holds its best unigram score, the number of pieces on
that path, and the starts from which a piece may still reach further down; it
is computed once from the nodes above it, however many pre-tokens share the
prefix. The count at a pre-token's last node is stored, in a store of bounded
size that keeps frequent pre-tokens from block to block. A pre-token of over
200 characters shares no prefix worth keeping: it is counted by the same steps
on a path of bounded length, so text without blanks takes bounded memory.

Counts are those of the ``sentencepiece`` operator's encoding (same scores,
byte fallback and rule for ties), without any ids being made.

Defined results: null or empty text counts 0. Repeated rows get equal results;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, bounded_batches, quoted, slices
from .sentencepiece import DEFAULT_MODEL, Pieces, pre_tokens, shipped

_LONG, _KEEP = 200, 200_000
#: Nodes of a long pre-token's path after which those out of reach are let go.
_NODES = 65_536
_NEVER = float("-inf")


class CountTrie:
    """Counts of pre-tokens, by depth-first walks over the trie of those not met before."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.unknown, self.single = vocabulary.unknown, {p for p in vocabulary.pieces if len(p) == 1}
        # every prefix of a piece -> the score, where the prefix is a piece itself
        self.prefixes: dict[str, float] = {p[:n]: _NEVER for p in vocabulary.pieces for n in range(1, len(p))}
        self.prefixes |= {p: s for p, (_, s) in vocabulary.pieces.items()}
        self.longest = max(map(len, self.prefixes), default=1)
        self.store = Store(_KEEP)

    def walk(self, words: list[str]) -> list[int]:
        """Pieces of each of the sorted words."""
        prefixes, single, unknown = self.prefixes, self.single, self.unknown
        best, count, reach = [0.0], [0], [[]]  # the path's nodes; index 0 is the root
        out, last = [], ""
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], reach[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n, live = _NEVER, 0, []
                for start in (*reach[-1], end - 1):  # the longest piece first
                    score = prefixes.get(word[start:end])
                    if score is not None:
                        live.append(start)
                        if score + best[start] > top:
                            top, n = score + best[start], count[start] + 1
                if word[end - 1] not in single and unknown + best[end - 1] > top:
                    top, n = unknown + best[end - 1], count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                best.append(top)
                count.append(n)
                reach.append(live)
            out.append(count[-1])
            last = word
        return out

    def long_count(self, word: str) -> int:
        """Pieces of a long pre-token, by the same steps; only the nodes that a piece may still start from are kept."""
        prefixes, single, unknown = self.prefixes, self.single, self.unknown
        best, count, live, base = [0.0], [0], [], 0
        for end in range(1, len(word) + 1):
            top, n, now = _NEVER, 0, []
            for start in (*live, end - 1):
                score = prefixes.get(word[start:end])
                if score is not None:
                    now.append(start)
                    if score + best[start - base] > top:
                        top, n = score + best[start - base], count[start - base] + 1
            if word[end - 1] not in single and unknown + best[-1] > top:
                top, n = unknown + best[-1], count[-1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            live = now
            best.append(top)
            count.append(n)
            if len(best) > _NODES:
                gone = len(best) - self.longest - 1
                del best[:gone], count[:gone]
                base += gone
        return count[-1]

    def counts(self, texts: list[list[str]]) -> list[int]:
        """Pieces of each text, given its pre-tokens."""
        known, new = {}, []
        for w in set(chain.from_iterable(texts)):
            found = self.store.get(w)
            if found is None:
                new.append(w)
            else:
                known[w] = found
        short = sorted(w for w in new if len(w) <= _LONG)
        for w, n in zip(short, self.walk(short), strict=True):
            known[w] = n
            self.store.put(w, n)
        for w in new:
            if len(w) > _LONG:
                known[w] = self.long_count(w)
        return [sum(map(known.__getitem__, words)) for words in texts]


_WORKER: dict[int, CountTrie] = {}


def _trie(vocabulary: Pieces) -> CountTrie:
    key = id(vocabulary)
    if key not in _WORKER or _WORKER[key].v is not vocabulary:
        _WORKER.clear()
        _WORKER[key] = CountTrie(vocabulary)
    return _WORKER[key]


def counter(vocabulary: Broadcast):
    """Column function: text -> struct(n_tokens, n_pre_tokens)."""

    @F.pandas_udf("n_tokens long, n_pre_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        trie, rows, whole = _trie(vocabulary.value), [], texts.tolist()
        for a, b in slices(whole):
            words = [pre_tokens(t) for t in whole[a:b]]
            rows += zip(trie.counts(words), map(len, words), strict=True)
        return pd.DataFrame(rows, columns=["n_tokens", "n_pre_tokens"])

    return lambda text: count(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_pre_tokens`` of every row."""
    bounded_batches(docs.sparkSession)
    count = counter(shipped(docs.sparkSession, model))
    return docs.select(quoted(id_col).alias("id"), count(quoted(text_col)).alias("c")).select(F.col("id").alias(id_col), "c.*")
