"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths (one row per distinct length) is brought to
the driver, where dynamic programming chooses the upper bounds of at most
``n_buckets`` buckets that minimise the padding of all texts exactly. The
histogram's size is proven, not assumed: D distinct lengths need texts of at
least 0 + 1 + ... + (D - 1) tokens in all, so a corpus of T tokens has fewer
than sqrt(2 T) + 1 of them (10^13 tokens: under 4.5 million rows of two
numbers), and no text can be longer than Spark's 2^31 - 1 bytes.

Inside a bucket every text takes the bucket's bound, and a batch holds as many
texts as the token budget allows (at least one). Ranks inside a bucket come
from counts of hash slices, so no bucket is sorted in one task: every slice
ranks its own rows and adds the counts of the slices before it.

Defined results: null or empty text, and a null ``length``, has length 0 and
goes to the first bucket; a negative length is an error; a text longer than the budget is a batch of its own kind (as many texts as fit,
at least one); ties and repeated rows are ordered by a hash of id and length,
and repeated rows take places of their own. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted

#: Rows of a hash slice, as expected.
SLICE_ROWS = 5_000


def word_count(text: Column) -> Column:
    """Length of a text in words parted by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """(length, texts) of each distinct length, in order."""
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("texts")).toArrow()
    return sorted(zip(rows["n_tokens"].to_pylist(), rows["texts"].to_pylist(), strict=True))


def best_bounds(cells: list[tuple[int, int]], n_buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding in all.

    ``cost(i, j)``, the padding of cells i..j-1 in one bucket, has the property
    that best split points never move back as j grows, so each of the
    ``n_buckets`` rounds divides and conquers: O(buckets * cells * log cells).
    At equal padding the earliest split stays.
    """
    if not cells:
        return []
    # whole numbers, so that sums are exact up to 2^63 tokens
    top = np.array([c[0] for c in cells], np.int64)
    texts = np.array([c[1] for c in cells], np.int64)
    count = np.concatenate(([0], np.cumsum(texts)))
    total = np.concatenate(([0], np.cumsum(texts * top)))
    m = len(cells)
    ends = np.arange(m + 1)
    never = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, never)
    best[0] = 0
    splits = []
    for _ in range(min(n_buckets, m)):
        after, where = np.full(m + 1, never), np.zeros(m + 1, np.int64)
        after[0] = 0
        todo = [(1, m, 0, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = ends[first : min(last, mid - 1) + 1]
            cost = best[i] + top[mid - 1] * (count[mid] - count[i]) - (total[mid] - total[i])
            k = int(cost.argmin())
            after[mid], where[mid] = cost[k], i[k]
            todo += [(low, mid - 1, first, int(i[k])), (mid + 1, high, int(i[k]), last)]
        splits.append(where)
        best = after
    bounds, j = [], m
    for where in reversed(splits):
        if j == 0:
            break
        bounds.append(int(cells[j - 1][0]))
        j = int(where[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_buckets: int = 16,
    token_budget: int = 65_536,
    length: Column | None = None,
) -> DataFrame:
    """``id_col, n_tokens, bucket, bucket_len, batch_id, slot`` of every row.

    ``length`` is the token count of a row (words of ``text_col`` if not
    given). Batches are numbered from 0 inside each bucket, slots from 0
    inside each batch.
    """
    # counted once; what follows reads ids and lengths only
    tokens = word_count(quoted(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    lengths = cut(docs.select(quoted(id_col).alias("id"), tokens.alias("n_tokens")), "packing-lengths")
    cells = histogram(lengths)
    if cells and cells[0][0] < 0:
        raise ValueError("a length is negative")
    bounds = best_bounds(cells, n_buckets) or [0]
    sizes = [0] * len(bounds)
    for longest, texts in cells:
        sizes[bisect.bisect_left(bounds, longest)] += texts
    about = F.array(*[F.struct(F.lit(b).cast("long").alias("bound"), F.lit(i).alias("bucket"), F.lit(max(1, -(-n // SLICE_ROWS))).alias("slices")) for i, (b, n) in enumerate(zip(bounds, sizes, strict=True))])
    own = F.element_at(F.filter(about, lambda x: x["bound"] >= F.col("n_tokens")), 1)
    placed = lengths.withColumn("b", own).select("id", "n_tokens", F.col("b.bucket").alias("bucket"), F.col("b.bound").alias("bucket_len"), F.col("b.slices").alias("slices"))
    placed = placed.withColumn("h", F.xxhash64("id", "n_tokens")).withColumn("slice", F.pmod("h", F.col("slices")))
    before = (
        placed.groupBy("bucket", "slice")
        .agg(F.count("*").alias("n"))
        .selectExpr("bucket", "slice", "sum(n) OVER (PARTITION BY bucket ORDER BY slice) - n AS before")
    )
    ranked = placed.withColumn("own", F.expr("row_number() OVER (PARTITION BY bucket, slice ORDER BY h, n_tokens, id) - 1"))
    rank = ranked.join(before, ["bucket", "slice"]).withColumn("rank", F.col("own") + F.col("before"))
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return rank.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("rank") / room).cast("long").alias("batch_id"),
        F.pmod("rank", room).cast("long").alias("slot"),
    )

