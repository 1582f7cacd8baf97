"""Media columns: documents' bytes as WAV sound with spectral fingerprints.

A payload is stored without loss as unsigned 8-bit mono samples of a WAV file,
written and read by the wave module. From the samples that were read back come
short-time Fourier transforms (Hann window, double precision), the strongest
peak of every frame, and fingerprints of peak pairs: (frequency, later
frequency, distance in frames), each with the frame it starts at. Powers are
rounded to 3 digits before the strongest is taken, so that peaks which differ
by the rounding of sums alone are ties (the lower frequency wins).

Defined results: a null text is an empty one (64 zero bytes); equal texts have
equal values; repeated rows get equal results; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted

RATE, FRAME, HOP, REACH, UNIT = 8000, 128, 64, 3, 64
#: Frames transformed at once, to bound memory on long sounds.
_FRAMES = 4_000
_HANN = np.hanning(FRAME)


def pad(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + bytes(max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono expected")
        return f.readframes(f.getnframes())


def spectral_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): start frames and pair codes, in order of time.

    Each frame's strongest bin (ties: the lowest; the constant part is left
    out) is paired with those of the next ``REACH`` frames; silent frames have
    no peak. A code is ``f1 * 4096 + f2 * 16 + distance``.
    """
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.concatenate([x, np.full(FRAME - len(x), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    peaks = np.empty(len(frames), np.int32)
    for k in range(0, len(frames), _FRAMES):
        power = np.round(np.abs(np.fft.rfft((frames[k : k + _FRAMES] - 128.0) * _HANN, axis=1))[:, 1:], 3)
        best = power.argmax(1)
        peaks[k : k + _FRAMES] = np.where(power[np.arange(len(best)), best] > 0, best + 1, 0)
    times, codes = [], []
    for d in range(1, REACH + 1):
        a, b = peaks[:-d], peaks[d:]
        at = np.flatnonzero((a > 0) & (b > 0))
        times.append(at)
        codes.append(a[at] * 4096 + b[at] * 16 + d)
    t, c = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((c, t))
    return t[order], c[order]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media (the WAV file), peak_times, peak_codes`` of every row."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, media binary, peak_times array<int>, peak_codes array<int>")
    def store(texts: pd.Series) -> pd.DataFrame:
        out = {"n_bytes": [], "media": [], "peak_times": [], "peak_codes": []}
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            media = to_wav(pad(raw))
            times, codes = spectral_pairs(from_wav(media))
            for name, value in zip(out, (len(raw), media, times, codes), strict=True):
                out[name].append(value)
        return pd.DataFrame(out)

    return docs.select(quoted(id_col).alias("id"), store(F.coalesce(quoted(text_col), F.lit(""))).alias("m")).select(F.col("id").alias(id_col), "m.*")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of :func:`media_columns`' values, the payload read back from the stored form.

    ``feature`` is the number of pairs and the SHA-256 of their times and
    codes as little-endian 32-bit integers, cut to 32 digits.
    """

    @F.pandas_udf(
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    def digest(media: pd.Series, times: pd.Series, codes: pd.Series) -> pd.DataFrame:
        rows = []
        for m, t, c in zip(media, times, codes, strict=True):
            payload = from_wav(m)
            both = np.asarray(t, "<i4").tobytes() + np.asarray(c, "<i4").tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{len(t)}:{hashlib.sha256(both).hexdigest()[:32]}"))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    stored = media_columns(docs, id_col, text_col)
    told = stored.select(quoted(id_col).alias("id"), "n_bytes", digest("media", "peak_times", "peak_codes").alias("d"))
    return told.select(F.col("id").alias(id_col), "n_bytes", "d.*")
