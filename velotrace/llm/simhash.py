"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A 64-bit fingerprint is cut into three blocks of 21, 21 and 22 bits. Two
fingerprints at Hamming distance 3 or less differ in at most 2 bits of some
pair of blocks, and two points at distance 2 or less meet at a common point
within half that radius of both. So every fingerprint emits, for each of the
three pairs of blocks, all variants within one flipped bit (129 rows); equal
variants shuffle together, and each colliding pair is verified on all 64 bits.
Every link comes from such a ball: half of radius 3 is no whole number, so the
blocks first lower the radius to 2. Distinct fingerprints only take part, so
exact copies cost nothing, and they are dealt out by number before they emit
their variants, as a few megabytes of them become many rows.

A variant shared by more than ``max_bucket`` fingerprints is not paired up.
Its fingerprints go through the ball of the whole 64 bits instead: all within
one bit, and within two for odd parity (of two at distance 3 exactly one has
odd parity). All points within one bit of a centre lie within 2 of each other,
and points two bits from it within 3 of each of them, so linking everything at
a centre to its least inner member is exact, needs no pairs, and a centre has
at most 2,081 members whatever the input.

Defined results: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer than ``shingle`` words
make one shingle; tied bits are 0; repeated rows share their group; a null id
never becomes a component id unless its group has no other. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, quoted

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCKS = ((0, 21), (21, 42), (42, 64))
RADIUS = 3
#: Shingles whose bits are counted at once, to bound memory on long texts.
_CHUNK = 100_000
#: Fingerprints whose variants one task emits, as expected (129 rows of 16 bytes each).
_EMIT = 20_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of a whole text over XXH64 (seed 42) word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = spans[k : k + _CHUNK]
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in part), np.uint64, len(part)).astype(">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp``: the fingerprint of every whole text as a signed long."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(quoted(id_col).alias("id"), simhash(F.coalesce(quoted(text_col), F.lit(""))).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants() -> list[tuple[int, int]]:
    """(mask, flip) of the 129 variants; a fixed tag in the block left out tells the tables apart."""
    out = []
    for left_out, tag in zip(range(3), (0x15555, 0xAAAAA, 0x3C3C3), strict=True):
        low, high = _BLOCKS[left_out]
        mask = ((1 << 64) - 1) ^ ((1 << high) - (1 << low))
        out += [(_signed(mask), _signed((tag << low) ^ flip)) for flip in [0] + [1 << j for j in range(64) if not low <= j < high]]
    return out


def _links(members: np.ndarray) -> list[dict[str, int]]:
    """Spanning links of the verified pairs of one small bucket."""
    fps = np.unique(np.asarray(members, np.int64)).view(np.uint64)
    root = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= RADIUS) + i + 1).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append({"a": int(fps[i].view(np.int64)), "b": int(fps[j].view(np.int64))})
    return out


def links(fps: DataFrame, max_bucket: int = 256) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints of ``fp`` within distance 3.

    Not all pairs: a spanning set of each bucket's verified pairs, which has
    the same components.
    """
    flips = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m, f in _variants()])
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.select("fp").repartition(max(width, -(-fps.count() // _EMIT)), "fp")
    keyed = dealt.select("fp", F.explode(flips).alias("v")).select("fp", F.expr("(fp & v.m) ^ v.f").alias("key"))
    # most variants are alone: drop them after one sort, before anything is gathered
    by_key = "PARTITION BY key ORDER BY fp"
    shared = keyed.selectExpr("key", "fp", f"lag(fp) OVER ({by_key}) AS before", f"lead(fp) OVER ({by_key}) AS after")
    shared = cut(shared.where("before IS NOT NULL OR after IS NOT NULL").select("key", "fp"), "simhash-buckets")
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > max_bucket).select("key")

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def pairs_of(buckets: pd.Series) -> pd.Series:
        return pd.Series([_links(members) for members in buckets], dtype=object)

    small = (
        shared.join(large, "key", "left_anti")
        .groupBy("key")
        .agg(F.collect_list("fp").alias("members"))
        .select(F.explode(pairs_of("members")).alias("p"))
        .select("p.a", "p.b")
    )
    crowded = shared.join(large, "key", "left_semi").select("fp").distinct()
    return small.unionByName(ball_links(crowded)).distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """Exact links by the ball of the whole 64 bits, without pairs (see the module text)."""
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    near = fps.selectExpr("fp", f"explode(concat(array(0L), {one})) AS f", "true AS inner")
    far = fps.where("bit_count(fp) % 2 = 1").selectExpr("fp", f"explode({two}) AS f", "false AS inner")
    at = near.unionByName(far).select(F.expr("fp ^ f").alias("key"), "fp", "inner")
    hub = at.selectExpr("fp", "min(CASE WHEN inner THEN fp END) OVER (PARTITION BY key) AS hub")
    return hub.where("hub IS NOT NULL AND hub <> fp").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bucket: int = 256
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest id reachable over links between
    fingerprints that differ in at most 3 bits.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    known = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-known")
    components = connected_components(links(known.select("fp"), max_bucket), "simhash-components")
    rooted = known.join(components.select(F.col("vertex").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
