"""Language identification by a bidirectional GRU over bytes, trained in numpy.

The network reads the UTF-8 bytes of the whole lower-cased text: letters,
blanks, digits and punctuation, across words. A text is cut into windows of
``WINDOW`` bytes, and each window is read together with ``CONTEXT`` bytes
before and after it, which bring the states of both directions up but are not
counted; blanks stand before the start and after the end. Both directions
label every byte position with probabilities of the languages, and a
document's probabilities are the mean of those of all its positions.

Gates and candidate states are piecewise linear (a gate is its input plus one
half, held between 0 and 1; a candidate is held between -1 and 1), which keeps
the network cheap enough to read every byte.

Training: backpropagation through time with Adam on windows of a bounded
sample of labelled rows (``sample_docs`` per language as expected, texts of at
most ``sample_chars`` characters), chosen by a hash of id and text, the same
on every run; at most ``max_languages`` languages, the most frequent ones, are
learned. Prediction reads the text only.

Defined results: a null text, or one without letters (Unicode category L), is
``und`` with score 0, and so is every text when there is nothing to learn
from. Ties go to the first language in order. Repeated rows get equal results;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices

WINDOW, CONTEXT = 192, 24
UNKNOWN = "und"
#: Windows that the network reads at once; few enough for their states to stay in the processor's cache.
_AT_ONCE = 2048
#: Bytes of a window in training.
_TRAINED = 48


@dataclass
class ByteGru:
    """Weights: per direction a byte table (256, 3h) with its bias, and U (h, 3h); the head (2h, k) and its bias."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> ByteGru:
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w["U" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        w["V"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        w["c"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def _run(self, x: np.ndarray, d: str, states: np.ndarray, trace: list | None = None) -> None:
        """Fill ``states`` (steps, h, n) of one direction over bytes (steps, n)."""
        table, u = self.weights["E" + d], self.weights["U" + d]
        (steps, n), h = x.shape, u.shape[0]
        gates, candidate = np.ascontiguousarray(u[:, : 2 * h].T), np.ascontiguousarray(u[:, 2 * h :].T)
        x = x.astype(np.intp)
        s, a = np.zeros((h, n), table.dtype), np.empty((n, 3 * h), table.dtype)
        zr, g, rs, move = (np.empty((k * h, n), table.dtype) for k in (2, 1, 1, 1))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            table.take(x[t], 0, out=a, mode="clip")
            np.matmul(gates, s, out=zr)
            zr += a.T[: 2 * h]
            zr += 0.5
            np.clip(zr, 0, 1, out=zr)
            np.multiply(zr[h:], s, out=rs)
            np.matmul(candidate, rs, out=g)
            g += a.T[2 * h :]
            np.clip(g, -1, 1, out=g)
            if trace is not None:
                trace.append((t, s.copy(), zr.copy(), g.copy()))
            np.subtract(s, g, out=move)
            move *= zr[:h]
            s = np.add(move, g, out=states[t])

    def _both(self, x: np.ndarray, traces: dict | None = None) -> np.ndarray:
        """States (steps, 2h, n) of both directions."""
        h = self.weights["Uf"].shape[0]
        states = np.empty((x.shape[0], 2 * h, x.shape[1]), self.weights["Ef"].dtype)
        for d, part in (("f", states[:, :h]), ("b", states[:, h:])):
            self._run(x, d, part, None if traces is None else traces[d])
        return states

    def _labelled(self, both: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, n) from the states of both directions."""
        o = np.matmul(self.weights["V"].T, both)
        o += self.weights["c"][:, None]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o

    def probabilities(self, x: np.ndarray, aside: int = 0) -> np.ndarray:
        """(positions, languages, n) for windows in the columns of ``x`` (steps, n), but for ``aside`` steps at both ends."""
        return self._labelled(self._both(x)[aside : x.shape[0] - aside])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients by backpropagation through time."""
        w, traces = self.weights, {"f": [], "b": []}
        both = self._both(x, traces)
        p = self._labelled(both)
        steps, k, n = p.shape
        loss = -float(np.log(p[:, y, np.arange(n)] + 1e-9).mean())
        p[:, y, np.arange(n)] -= 1
        p /= n * steps
        g = {"V": np.einsum("thn,tkn->hk", both, p), "c": p.sum((0, 2))}
        down = np.matmul(w["V"], p)
        h, one_of = w["Uf"].shape[0], np.eye(256, dtype=p.dtype)
        for d, part in (("f", down[:, :h]), ("b", down[:, h:])):
            u = w["U" + d]
            gu, ge, back = np.zeros_like(u), np.zeros_like(w["E" + d]), np.zeros((h, n), p.dtype)
            for t, s, zr, c in reversed(traces[d]):
                z, r = zr[:h], zr[h:]
                ds = part[t] + back
                dc = ds * (1 - z) * (np.abs(c) < 1)
                drs = u[:, 2 * h :] @ dc
                dzr = np.concatenate([ds * (s - c), drs * s]) * ((zr > 0) & (zr < 1))
                gu[:, : 2 * h] += s @ dzr.T
                gu[:, 2 * h :] += (r * s) @ dc.T
                ge += one_of[x[t]].T @ np.concatenate([dzr, dc]).T
                back = ds * z + drs * r + u[:, : 2 * h] @ dzr
            g |= {"U" + d: gu, "E" + d: ge}
        return loss, g


def fit(texts: list[str], languages: list[str], hidden: int = 12, steps: int = 400, batch: int = 128, seed: int = 7) -> ByteGru:
    """Train on windows of labelled texts, drawn anew for every step, all languages alike."""
    rng = np.random.default_rng(seed)
    known = sorted(set(languages))
    model = ByteGru.fresh(known, hidden, rng)
    raw = [np.frombuffer(_framed(t, _TRAINED), np.uint8) for t in texts]
    of = [[r for r, lang in zip(raw, languages, strict=True) if lang == k] for k in known]
    if len(known) < 2:
        return model
    share = [np.cumsum([len(r) - _TRAINED for r in rows]) for rows in of]
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(known), size=batch)
        x = np.empty((_TRAINED, batch), np.uint8)
        for col, k in enumerate(y.tolist()):
            row = of[k][int(np.searchsorted(share[k], rng.integers(share[k][-1]), side="right"))]
            at = int(rng.integers(len(row) - _TRAINED + 1))
            x[:, col] = row[at : at + _TRAINED]
        _, g = model.gradients(x, y)
        rate = 0.01 * min(1, 3 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            model.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, use: Column, sample_docs: int = 300, sample_chars: int = 20_000, max_languages: int = 200, **options
) -> ByteGru:
    """Fit on a bounded sample of the rows of ``docs`` where ``use`` holds and the language is known.

    Every language contributes about ``sample_docs`` texts; at most twice that
    many per language come to the driver in all, and counts of at most
    ``max_languages`` languages.
    """
    rows = docs.where(use & quoted(lang_col).isNotNull() & (F.length(quoted(text_col)) <= sample_chars) & quoted(text_col).rlike(r"\p{L}")).select(
        quoted(text_col).alias("text"), quoted(lang_col).alias("lang"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("h")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return ByteGru([], {})
    rate = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample_docs / n))) for k, n in counts.items()))
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)
    sample = chosen.orderBy("h", "lang", "text").limit(2 * sample_docs * len(counts)).collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], **options)


def _framed(text: str, room: int) -> bytes:
    """Bytes of a text as the network reads it, with ``CONTEXT`` blanks around it and at least ``room`` bytes."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    return b" " * CONTEXT + raw + b" " * (CONTEXT + max(0, room - len(raw)))


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows with their context (windows, bytes), the text that each is from, and the positions of it that count."""
    parts, owner, counted = [], [], []
    whole = CONTEXT + WINDOW + CONTEXT
    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "surrogatepass")
        n = max(1, -(-len(raw) // WINDOW))
        framed = np.frombuffer(b" " * CONTEXT + raw + b" " * (CONTEXT + n * WINDOW - len(raw)), np.uint8)
        parts.append(np.lib.stride_tricks.sliding_window_view(framed, whole)[::WINDOW])
        owner.append(np.full(n, i))
        counted.append(np.minimum(WINDOW, len(raw) - WINDOW * np.arange(n)))
    return np.concatenate(parts), np.concatenate(owner), np.concatenate(counted)


def label(model: ByteGru, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts."""
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return pred, score
    spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for start, end in slices([texts[i] for i in spoken]):
        here = spoken[start:end]
        rows, owner, counted = _columns([texts[i] for i in here])
        totals = np.zeros((len(here), len(model.languages)))
        for k in range(0, len(rows), _AT_ONCE):
            p = model.probabilities(np.ascontiguousarray(rows[k : k + _AT_ONCE].T), CONTEXT)
            p *= (np.arange(WINDOW)[:, None] < counted[k : k + _AT_ONCE])[:, None]
            np.add.at(totals, owner[k : k + _AT_ONCE], p.sum(0).T)
        totals /= np.maximum(1, np.bincount(owner, counted, len(here)))[:, None]
        for i, p in zip(here, totals, strict=True):
            pred[i], score[i] = model.languages[int(p.argmax())], min(1.0, float(p.max()))
    return pred, score


def predictor(model: ByteGru):
    """Column function: text -> struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred, score = label(model, texts.tolist())
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return lambda text: predict(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""
    return docs.select(quoted(id_col).alias("id"), predictor(model)(quoted(text_col)).alias("r")).select(F.col("id").alias(id_col), "r.lang_pred", "r.score")
