"""The conversation trie against plain loops: nulls, ties, repeats, long conversations, clashing names, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from velotrace.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth string, digest string, `k1` string"


def rows():
    rng, out = random.Random(2), []
    for c in list(range(60)) + [105, 106, 1_000_000_007]:
        for t in range(rng.choice([1, 2, 3, 4, 9, 14])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "tschüß"])))
    out += [(7, None, "user", "null turn"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (9, 0, "user", "twice"), (9, 0, "user", "twice"), (None, 0, "user", "no conversation")]
    out += [(200, t, "user", f"long {t}") for t in range(60)] + [(201, t, "user", f"long {t}") for t in range(40)] + [(-6, 0, "user", "below zero")]
    return out


def plain(table):
    own = defaultdict(list)
    for c, t, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children[k]
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below)
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    }


@pytest.mark.parametrize("chunk", [4096, 7])
def test_trie(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    table = rows()
    random.Random(chunk).shuffle(table)
    spark.createDataFrame([(*r, "p", "d", "x", "k") for r in table], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_trie(spark, str(tmp_path)).collect()
    want = plain(table)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_turnless_conversations_meet_at_the_root(spark, tmp_path):
    alone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    table = [(c, 0, "user", "gone") for c in alone]
    spark.createDataFrame([(*r, "p", "d", "x", "k") for r in table], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.op11_conversation_trie(spark, str(tmp_path)).collect()] == list(plain(table)) == [(alone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_trie(spark, str(tmp_path)).count() == 0


def test_light_steps_are_few(spark):
    """A path's members at least halve at every light step, so rounds are logarithmic."""
    table = [(c, t, "user", f"{c >> (6 - t)}") for c in range(64) for t in range(7)]
    own = conversation_trie.turns(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("length"))
    members = conversation_trie.cut(conversation_trie._members(own), "test-members")
    paths = conversation_trie._paths(members, conversation_trie._nodes(members, lengths))
    assert paths.agg(F.max("level")).first()[0] == 6
    nodes, _ = conversation_trie.trie(own, lengths)
    assert {(r["depth"], r["n_convs"], r["n_leaves"]) for r in nodes.collect()} == {(0, 64, 64)} | {(d, 2 ** (7 - d), 2 ** (7 - d)) for d in range(1, 8)}
