"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are presence indicators of n-grams, hashed to ``BUCKETS``: 2-, 3- and
4-grams of the text's bytes, single words and pairs of words (lower case), and
1- to 4-grams of the stream that says of each word whether it is new, the same
as the one before or the same as the one before that. Each indicator is scaled
by its class log-count ratio, a linear hinge-loss model is fitted to the
scaled indicators by dual coordinate descent, and a logistic curve turns
margins into scores.

The log-count ratios come from all labelled training rows (counted per task,
summed by bucket in Spark; at most ``BUCKETS`` rows reach the driver). Only the hinge-loss fit uses a bounded sample: about ``sample_docs``
rows of each class, never more than twice as many, of at most ``sample_chars``
characters, chosen by a hash of id and text, so that copies of a text are
drawn each for itself.

Defined results: a null text is an empty one and is scored like any other;
rows whose label is null or not 0 or 1 are not learned from; without training
rows of both classes every score is 1 (nothing is known against any text).
Repeated rows get equal results; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, quoted

_BITS = 18
BUCKETS = 1 << _BITS
CUT = 0.3
#: Multipliers of the rolling byte hashes (odd constants of our own choice).
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BLOCK = 1 << 20


def _bytes_seen(raw: np.ndarray, seen: np.ndarray) -> None:
    for n in (2, 3, 4):
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1] * _MIX[0]
            for k in range(1, n):
                h += raw[k : len(raw) - n + 1 + k] * _MIX[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D + 2 * n)
            seen[h >> np.uint32(32 - _BITS)] = True


class _Words(dict):
    """Hashes of words, kept from text to text up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def _words_seen(words: list[str], seen: np.ndarray) -> None:
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint32, len(words))
    seen[h >> np.uint32(32 - _BITS)] = True
    pairs = (h[:-1] * _MIX[0]) ^ (h[1:] * _MIX[1])
    pairs ^= pairs >> np.uint32(15)
    seen[(pairs * _MIX[2]) >> np.uint32(32 - _BITS)] = True


def _repeats_seen(words: list[str], seen: np.ndarray) -> None:
    """1- to 4-grams of the signs 0 new, 1 as the last word, 2 as the last but one."""
    one = np.fromiter(map(eq, words[1:], words), bool, max(0, len(words) - 1))
    two = np.fromiter(map(eq, words[2:], words), bool, max(0, len(words) - 2))
    signs = np.zeros(len(words), np.uint8)
    signs[2:][two] = 2
    signs[1:][one] = 1
    code = np.zeros(len(words), np.int64)
    for n in (1, 2, 3, 4):
        if len(words) >= n:
            code = code[: len(words) - n + 1] * 3 + signs[n - 1 :]
            seen[(np.flatnonzero(np.bincount(code, minlength=1)) * 40503 + n * 7919) % BUCKETS] = True


def indicators(text: str | None) -> np.ndarray:
    """Sorted buckets of the n-grams that occur in a whole text."""
    seen = np.zeros(BUCKETS, bool)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for i in range(0, max(1, len(data)), _BLOCK):  # blocks overlap, so no n-gram is lost
        _bytes_seen(data[i : i + _BLOCK + 3].astype(np.uint32), seen)
    words = (text or "").lower().split()
    if words:
        _words_seen(words, seen)
        _repeats_seen(words, seen)
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Nbsvm:
    """Of every bucket the weight (log-count ratio times hinge weight) and the squared ratio; bias; logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    @classmethod
    def untrained(cls) -> Nbsvm:
        return cls(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, 0.0, 30.0)

    def margin(self, grams: np.ndarray) -> float:
        """Hinge margin of the scaled indicators brought to unit length."""
        return float(self.weights[grams].sum()) / max(1e-9, math.sqrt(self.squares[grams].sum())) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([self.margin(indicators(t)) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_count_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """From a (2, buckets) count of rows of class 0 and 1 in which each bucket occurs."""
    p = counts + alpha
    p = p / p.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights of unit-length scaled indicators; the bias is one more constant feature."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    values = [ratios[r] / max(1e-9, float(np.linalg.norm(ratios[r]))) for r in rows]
    square = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            gradient = signs[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margins).sum() + 0.01 * a, g.sum() + 0.01 * b])
        hess = np.array([[(h * margins**2).sum() + 0.01, (h * margins).sum()], [(h * margins).sum(), h.sum() + 0.01]])
        d = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    return max(a, 1e-3), b


def _bucket_counts(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for pdf in batches:
        for text, quality in zip(pdf["text"], pdf["quality"], strict=True):
            counts[int(quality), indicators(text)] += 1
    at = np.flatnonzero(counts.any(0))
    yield pd.DataFrame({"bucket": at.astype(np.int32), "low": counts[0, at], "high": counts[1, at]})


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 1500, sample_chars: int = 50_000) -> Nbsvm:
    """Fit on the rows of ``docs`` where ``use`` holds and ``labels`` has a label of 0 or 1."""
    label, doc = quoted(label_col), quoted(id_col)
    marks = labels.where(label.isin(0, 1) & doc.isNotNull()).groupBy(doc.alias("id")).agg(F.max(label).cast("int").alias("quality"))
    learned = docs.where(use).select(doc.alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    # labels grow with the corpus, so they are never broadcast, not even where they happen to be few
    rows = cut(learned.hint("merge").join(marks.hint("merge"), "id").select("id", "text", "quality"), "quality-rows")
    found = rows.mapInPandas(_bucket_counts, "bucket int, low long, high long").groupBy("bucket").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[:, found["bucket"].to_numpy()] = found["low"].to_numpy(), found["high"].to_numpy()
    short = rows.where(F.length("text") <= sample_chars).withColumn("h", F.xxhash64("id", "text"))
    of_class = {r["quality"]: r["count"] for r in short.groupBy("quality").count().collect()}
    if len(of_class) < 2:
        discard(rows)
        return Nbsvm.untrained()
    ratios = log_count_ratios(counts)
    sample = []
    for k, n in sorted(of_class.items()):
        chosen = short.where((F.col("quality") == k) & (F.pmod("h", F.lit(1_000_000)) < min(1.0, sample_docs / n) * 1_000_000))
        sample += chosen.select("h", "text", "quality").orderBy("h", "text").limit(2 * sample_docs).collect()
    sample.sort(key=lambda r: (r["h"], r["text"], r["quality"]))
    discard(rows)
    grams = [indicators(r["text"]) for r in sample]
    y = np.array([r["quality"] for r in sample], int)
    n1 = int(y.sum())
    if n1 in (0, len(y)):
        return Nbsvm.untrained()
    cost = 4.0 * np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))

    def fitted(at: np.ndarray) -> Nbsvm:
        w, bias = dual_coordinate_descent([grams[i] for i in at], 2.0 * y[at] - 1, ratios, cost[at])
        return Nbsvm(w * ratios, ratios**2, bias, 1.0, 0.0)

    # the logistic curve comes from one fold in five that its hinge fit has not seen
    fold = np.arange(len(y)) % 5 == 0
    rest, partial = np.flatnonzero(fold), fitted(np.flatnonzero(~fold))
    slope, shift = _logistic(np.array([partial.margin(grams[i]) for i in rest]), y[rest])
    model = fitted(np.arange(len(y)))
    # the sample holds the classes at other rates than the labelled rows do
    model.slope, model.shift = slope, shift + math.log(of_class[1] / of_class[0]) - math.log(n1 / (len(y) - n1))
    return model


def scorer(model: Nbsvm):
    """Column function: text -> score between 0 and 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return lambda text: score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Nbsvm, id_col: str = "doc_id", text_col: str = "text", least: float = CUT) -> DataFrame:
    """``id_col, score, predicted`` of every row; predicted is 1 where the score is at least ``least``."""
    scored = docs.select(quoted(id_col).alias(id_col), scorer(model)(quoted(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
