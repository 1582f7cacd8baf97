"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is normalised, turned by a random orthogonal matrix and reduced to
signs: its code is a corner x of the unit cube's sphere, stored with the
correction factor f = <x, a>. For any b the value <x, b> / f estimates <a, b>
without bias (over the rotations), and the part of a that x does not hold
bounds its error: with certainty

    <a, b>  <=  f <x, b> + sqrt(1 - f^2) sqrt(1 - <x, b>^2),

and with the confidence of ``eps`` standard errors within
sqrt((1 - f^2) / f^2) eps / sqrt(d - 1) of the estimate. A pair whose upper
bound stays under the threshold is settled by its code; every other pair is
recomputed exactly in double precision. By default the bound is the certain
one, so no link is lost; with ``eps`` it is the narrower one.

All pairs of a label are covered, in blocks: the distinct vectors of a label
(and dimension) are dealt into blocks of about ``block_values`` numbers, each
pair of blocks is one group of a grouped pandas call, and what leaves it is one
row per vector with links there: how many rows it links with, and the least
vector of its component within the two blocks. So no pair is ever a row, a
task holds two blocks whatever the input, and a crowded label is many tasks.
The work is that of a join within a label: half the square of its distinct
vectors, at one multiplication of small numbers by matrix product a pair.

Identical vectors of a label are collapsed first (told apart by 128 bits of
hash), so copies are never paired.

Defined results: a null label, and a vector that is null, empty, zero or holds
null or non-finite components, links with nothing (its own component, kept).
Vectors of different length do not link. Repeated ids are repeated rows: each
counts as another vector. Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, quoted

SEED = 20240607
#: Numbers of a block of vectors (4,096 vectors of 64).
BLOCK_VALUES = 1 << 18
#: Rows of a block whose estimates are made at once, and pairs that are recomputed at once.
_ROWS, _PAIRS = 256, 1 << 15
#: Rounding of single-precision estimates must not settle a pair.
_SLACK = 1e-4


def rotation(dim: int) -> np.ndarray:
    """The random orthogonal matrix of a dimension (the same on every machine)."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(vectors) -> np.ndarray:
    """Vectors of one length, brought to unit length in double precision whatever their scale."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of turned unit vectors, packed to bits, and the correction factors <x, a>."""
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def upper_bounds(packed: np.ndarray, factor: np.ndarray, turned: np.ndarray, eps: float | None = None) -> np.ndarray:
    """(codes, vectors) upper bounds of the inner products, certain or within ``eps`` standard errors."""
    d = turned.shape[1]
    corners = np.unpackbits(packed, axis=1)[:, :d].astype(np.float32) * np.float32(2 / math.sqrt(d)) - np.float32(1 / math.sqrt(d))
    inner = corners @ turned.T.astype(np.float32)
    f = factor[:, None].astype(np.float32)
    if eps is None:
        return f * inner + np.sqrt(np.maximum(0, 1 - f * f)) * np.sqrt(np.maximum(0, 1 - inner * inner))
    return inner / f + np.sqrt(np.maximum(0, 1 - f * f)) / f * eps / math.sqrt(max(1, d - 1))


class _Forest:
    """Least member of every component, in one array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        for r in roots[1:].tolist():
            self.root[self.root == r] = roots[0]


def block_links(left: dict, right: dict | None, threshold: float, eps: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(others, root) of the rows of ``left`` followed by those of ``right``; without ``right``, of ``left`` by itself.

    A block has ``vec`` (a matrix of unit vectors), ``code``, ``factor`` and
    ``copies``. ``others`` are the copies of the rows that a row links with,
    ``root`` is the first row of its component.
    """
    other = left if right is None else right
    n, shift = len(left["vec"]), 0 if right is None else len(left["vec"])
    size = n if right is None else n + len(right["vec"])
    others, forest = np.zeros(size, np.int64), _Forest(size)
    turned = other["vec"] @ rotation(other["vec"].shape[1]).T
    for k in range(0, n, _ROWS):
        near = upper_bounds(left["code"][k : k + _ROWS], left["factor"][k : k + _ROWS], turned, eps) >= threshold - _SLACK
        if right is None:  # each pair once, none with itself
            near &= np.arange(len(other["vec"])) > np.arange(k, k + len(near))[:, None]
        i, j = np.nonzero(near)
        for p in range(0, len(i), _PAIRS):
            a, b = i[p : p + _PAIRS] + k, j[p : p + _PAIRS]
            linked = np.einsum("ij,ij->i", left["vec"][a], other["vec"][b]) >= threshold
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            others[:n] += np.bincount(a, other["copies"][b], n).astype(np.int64)
            others[shift : shift + len(other["vec"])] += np.bincount(b, left["copies"][a], len(other["vec"])).astype(np.int64)
            for row, start, end in zip(*_runs(a), strict=True):
                forest.join(row, b[start:end] + shift)
    return others, forest.root


def _runs(a: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values of a sorted array with the start and end of their runs."""
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    return a[starts].tolist(), starts.tolist(), np.append(starts[1:], len(a)).tolist()


def _encode():
    @F.pandas_udf("code binary, factor double")
    def encode(vectors: pd.Series) -> pd.DataFrame:
        code, factor = [None] * len(vectors), np.zeros(len(vectors))
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            packed, factor[at] = codes(unit_vectors(vectors.iloc[at]) @ rotation(d).T)
            for row, i in enumerate(at.tolist()):
                code[i] = packed[row].tobytes()
        return pd.DataFrame({"code": code, "factor": factor})

    return encode


def _linker(threshold: float, eps: float | None):
    def block(pdf: pd.DataFrame) -> dict:
        return {
            "vec": unit_vectors(pdf["vec"]),
            "code": np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1),
            "factor": pdf["factor"].to_numpy(),
            "copies": pdf["copies"].to_numpy(),
        }

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "rid"], ignore_index=True)
        first = int((pdf["block"] == pdf["low"]).sum())
        one, two = pdf.iloc[:first], pdf.iloc[first:]
        if pdf["low"].iloc[0] != pdf["high"].iloc[0] and (one.empty or two.empty):
            return pd.DataFrame({"rid": [], "others": [], "root": []}, dtype=np.int64)
        others, root = block_links(block(one), None if two.empty else block(two), threshold, eps)
        at = np.flatnonzero(others)
        rid = pdf["rid"].to_numpy()
        return pd.DataFrame({"rid": rid[at], "others": others[at], "root": rid[root[at]]})

    return link


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    eps: float | None = None,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``id_col, n_links, component_id, kept``: one row per input row."""
    sound = (
        F.col("vec").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    on = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).alias("vec"), quoted(label_col).alias("label"))
    alone = rows.where(~on)
    # -0.0 and 0.0 compare equal, so they are made equal before hashing
    usable = rows.where(on).withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
    usable = usable.withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "label", "vec"))
    # one row per distinct vector of a label: members fold into counts before the shuffle
    reps = usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    coded = reps.withColumn("c", _encode()("vec")).select("h1", "h2", "rep", "copies", "label", "vec", "c.*")
    coded = cut(coded.withColumn("rid", F.monotonically_increasing_id()), "embedding-codes")

    kinds = coded.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    kinds = kinds.select("label", "dim", F.ceil(F.col("n") * F.col("dim") / block_values).cast("int").alias("blocks"))
    kinds = cut(kinds, "embedding-kinds")  # written, so that its size decides how it is joined
    dealt = coded.select("rid", "copies", "label", "vec", "code", "factor", F.size("vec").alias("dim")).join(kinds, ["label", "dim"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("*", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"))
    slim = dealt.select("label", "dim", "low", "high", "block", "rid", "copies", "vec", "code", "factor")
    linked = slim.groupBy("label", "dim", "low", "high").applyInPandas(_linker(threshold, eps), "rid long, others long, root long")
    linked = cut(linked, "embedding-links")

    degree = linked.groupBy("rid").agg(F.sum("others").alias("others"))
    roots = connected_components(linked.select(F.col("rid").alias("a"), F.col("root").alias("b")), "embedding-components")
    known = (
        coded.select("rid", "rep", "copies", "h1", "h2")
        .join(roots.select(F.col("vertex").alias("rid"), F.col("root").alias("top")), "rid", "left")
        .join(degree, "rid", "left")
        .withColumn("top", F.coalesce("top", "rid"))
    )
    least = known.groupBy("top").agg(F.min("rep").alias("component_id"))
    told = known.join(least, "top").select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    found = usable.select("id", "h1", "h2").join(told, ["h1", "h2"])
    found = found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return found.unionByName(
        alone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    )
