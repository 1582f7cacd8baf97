"""Prefix trie of conversations, summed up over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns; its members are the
conversations that begin with it. A prefix is known by its depth and the XOR of
two 64-bit hashes of every (position, turn digest) in it, so all prefixes come
from one running XOR, no prefix text is built, and a parent's key is its
child's with the last turn taken out again.

Every node's largest child (most members, then the smallest id) is its heavy
one; the others are light. A chain of heavy children is a path, and as a light
child has at most half of its parent's members, there are at most log2(members)
light steps above any node. Rounds go from the paths with most light steps
above them to the root's: each sums the rows of its paths from the end to the
top, and what a path's top holds is added, pre-aggregated, to the node it hangs
from, which lies on a path of the next round.

No conversation, path or node is held in one task: positions are counted within
ranges of the sorted turns, with what earlier ranges hold of a conversation
added; running values are taken in chunks of ``CHUNK`` rows, with those of
earlier chunks carried in. What is carried is one row a chunk.

Defined results: null role or text is empty; rows with a null conversation id
belong to no conversation; null turns come first; rows of one conversation and
turn are ordered by the SHA-256 of role and text, so repeated rows are turns
like any other; empty tables have no node, not even a root. Columns of other
names are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, quoted

#: Rows of a conversation or path whose running values are taken in one window.
CHUNK = 4096
KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, n_bytes``: every turn's place in its conversation (from 1), SHA-256 of role and text, bytes of text."""
    role, text = F.coalesce(quoted(role_col), F.lit("")), F.coalesce(quoted(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(quoted(conv_col).isNotNull()).select(
        quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")
    )
    # the range is written with the rows, so that it stays the same however often they are read
    ranged = cut(rows.repartitionByRange("conv_id", "turn", "digest", "row").withColumn("range", F.spark_partition_id()), "trie-turns")
    here = Window.partitionBy("conv_id", "range").orderBy("turn", "digest", "row")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range began in another: at most one row a range
    begun = ranged.groupBy("conv_id", "range").count().withColumn("before", F.sum("count").over(earlier)).where("before > 0").drop("count")
    numbered = ranged.withColumn("k", F.row_number().over(here)).join(F.broadcast(begun), ["conv_id", "range"], "left")
    return numbered.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_bytes")


def regrow(own: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: rebuilt turns (as :func:`turns` gives them), and ``conv_id, length`` of each.

    Conversation c takes the first h turns of conversation c - c % ``every``
    (all if fewer, none if there is none), and its own turns after its first h;
    h is the unsigned CRC-32 of c in decimals, modulo ``most``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = (
        own.where((F.col("pos") < most) & (F.col("conv_id") % every == 0))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("head"))
    )
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    taken = F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), h.cast("int")))
    told = cut(convs.join(heads, "base", "left").select("conv_id", "n", taken.alias("taken")), "trie-heads")
    short = told.where(F.size("taken") < h).select("conv_id", (h - F.size("taken")).alias("missing"))
    after = own.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "digest", "n_bytes")
    before = told.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.digest", "t.n_bytes")
    lengths = told.select("conv_id", (F.size("taken") + F.greatest(F.col("n") - h, F.lit(0))).alias("length"))
    return before.unionByName(after), lengths


def _running(df: DataFrame, group: list[str], place: str, values: dict[str, tuple[str, Column]], down: bool = False) -> DataFrame:
    """Running aggregates of every row of ``group`` in the order of ``place`` (from the last row back if ``down``).

    ``values`` names each: (aggregate function, its argument). Groups of any
    size: windows are chunks, and the aggregate of all earlier chunks joins in.
    """
    step = F.col(place).desc() if down else F.col(place)
    chunk = F.col("chunk").desc() if down else F.col("chunk")
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "bit_xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0))), "max": F.greatest}
    call = {"sum": F.sum, "bit_xor": F.bit_xor, "max": F.max}
    chunked = df.withColumn("chunk", F.floor(F.col(place) / CHUNK))
    within = Window.partitionBy(*group, "chunk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*group, "chunk").agg(*[call[f](x).alias(c) for c, (f, x) in values.items()])
    carried = totals.select(*group, "chunk", F.lag(F.lit(True)).over(Window.partitionBy(*group).orderBy(chunk)).alias("later"), *[call[f](c).over(across).alias(f"{c}_carried") for c, (f, _) in values.items()])
    carried = carried.where("later").drop("later")
    rows = chunked.select("*", *[call[f](x).over(within).alias(f"{c}_here") for c, (f, x) in values.items()]).join(carried, [*group, "chunk"], "left")
    return rows.select(*df.columns, *[join[f](F.col(f"{c}_here"), F.col(f"{c}_carried")).alias(c) for c, (f, _) in values.items()])


def trie(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of ``rows`` (``conv_id, pos, digest, n_bytes``) and ``lengths`` (``conv_id, length``).

    Nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (bytes of last turns that members after the first share,
    over the subtree) and the key ``k1, k2``. Ends: the key of the node at which
    each conversation ends, and its id as ``end_id``. A conversation without
    turns is a member of the root alone.
    """
    members = cut(_members(rows), "trie-members")
    last = members.join(lengths, (members["conv_id"] == lengths["conv_id"]) & (members["depth"] == lengths["length"]))
    root = [F.lit(0).cast("long").alias(c) for c in KEY]
    ends = last.select(*KEY, members["conv_id"].alias("end_id")).unionByName(lengths.where("length = 0").select(*root, F.col("conv_id").alias("end_id")))
    nodes = _nodes(members, lengths)
    paths = _paths(members, nodes)
    rounds, add, deepest = [], None, paths.agg(F.max("level").alias("n")).first()["n"]
    for level in range(deepest if deepest is not None else -1, -1, -1):
        now = paths.where(F.col("level") == level)
        if add is not None:
            now = now.join(add, KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_added", F.lit(0)) for c in ("leaves", "saved")})
            now = now.drop("leaves_added", "saved_added")
        summed = _running(now, ["h0", "h1", "h2"], "depth", {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))}, down=True)
        rounds.append(cut(summed, f"trie-round-{level}"))
        top = rounds[-1].where((F.col("depth") == F.col("h0")) & (F.col("depth") > 0))
        add = top.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.sum("n_leaves").alias("leaves_added"), F.sum("saved_tokens").alias("saved_added")
        )
    done = paths.withColumns({"n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long")}).limit(0)
    for one in rounds:
        done = done.unionByName(one)
    discard(nodes)
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"), ends


def _members(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, n_bytes``: the node of every prefix of every conversation, and its parent's key."""
    hashed = rows.select("conv_id", F.col("pos").cast("long").alias("depth"), "n_bytes", F.xxhash64("pos", "digest").alias("x1"), F.xxhash64(F.lit("other"), "pos", "digest").alias("x2"))
    keyed = _running(hashed, ["conv_id"], "depth", {"k1": ("bit_xor", F.col("x1")), "k2": ("bit_xor", F.col("x2"))})
    return keyed.select("conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "n_bytes")


def _nodes(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node, with its parent's smallest member, its number of children and whether it is a light child."""
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    bare = cut(
        members.groupBy(*KEY)
        .agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes"))
        .unionByName(root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", none.alias("p1"), none.alias("p2"), zero.alias("n_bytes"))),
        "trie-bare",
    )
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = bare.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n_convs")).alias("n"), "conv_id")).alias("heavy"))
    known = bare.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.conv_id").alias("heavy_id"))
    placed = known.drop("heavy").join(parents, ["depth", "p1", "p2"], "left")
    out = cut(
        placed.select(
            *KEY, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children",
            ((F.col("depth") > 0) & (F.col("conv_id") != F.col("heavy_id"))).alias("light"),
            (F.col("n_children") == 0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        ),
        "trie-nodes",
    )
    discard(bare)
    return out


def _paths(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the key of their path's top (``h0, h1, h2``) and the number of light steps above them (``level``)."""
    light = nodes.where("light").select(*KEY, F.lit(True).alias("is_light"))
    flagged = members.select("conv_id", *KEY).join(light, KEY, "left")
    top = F.when(F.col("is_light"), F.struct("depth", "k1", "k2"))
    seen = _running(flagged, ["conv_id"], "depth", {"level": ("sum", F.col("is_light").isNotNull().cast("long")), "top": ("max", top)})
    zero = F.lit(0).cast("long")
    at = seen.select("conv_id", "depth", "level", *[F.coalesce(F.col(f"top.{c}"), zero).alias(h) for c, h in zip(KEY, ("h0", "h1", "h2"), strict=True)])
    root = nodes.where("depth = 0").select("conv_id", "depth", zero.alias("level"), zero.alias("h0"), zero.alias("h1"), zero.alias("h2"))
    # the smallest member of a node passes through it: its row is the node's
    return cut(nodes.drop("light").join(at.unionByName(root), ["conv_id", "depth"]), "trie-paths", "level")


def end_digests(ends: DataFrame) -> DataFrame:
    """Key and ``ends_sha256``: SHA-256 of the decimal ids that end at a node, ascending and comma-joined.

    The ids of a node stream sorted through one hasher, as the digest asks for
    one sequence; a task holds a batch of them.
    """

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            keys, ids, done = batch[KEY].to_numpy(), list(map(str, batch["end_id"].tolist())), []
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(ids)]
            for a, b in pairwise(starts):
                now, text = tuple(keys[a].tolist()), ",".join(ids[a:b])
                if now == key:
                    text = "," + text
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(text.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    rows = ends.repartition(*KEY).sortWithinPartitions(*KEY, "end_id")
    return rows.mapInPandas(hashed, "depth long, k1 long, k2 long, ends_sha256 string")
