"""Byte-level BPE against the library whose results it must give, and a plain merge loop."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velotrace.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def loop(ranks, word):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_is_the_plain_loop(vocabulary):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdeth in\xc3\xa9\xe6") for _ in range(rng.randrange(1, 70))) for _ in range(600)] + [b"a" * 1000, b"\xff" * 9, b"x", b"abcab" * 500]
    for word, ids in zip(words, byte_bpe.merge(vocabulary, words), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == loop(vocabulary.ranks, word)


def test_ties_go_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258}
    v = byte_bpe.Vocabulary(ranks, r"\S+|\s+")
    assert np.frombuffer(byte_bpe.merge(v, [b"aaab"])[0], np.int32).tolist() == loop(ranks, b"aaab") == [256, 257]
    assert np.frombuffer(byte_bpe.merge(v, [b"aaaaa"])[0], np.int32).tolist() == loop(ranks, b"aaaaa") == [256, 256, 97]


def test_as_the_library(vocabulary, library, monkeypatch):
    rng = random.Random(7)
    texts = ["", " ", "a  b", "aaaa" * 200, " " * 3000, "x\n \n y", "it's we'll 'S", "\x1c\x1d a", "é" * 333, "日本語のテキスト" * 30, "<|endoftext|> is text", "Ünï\x00 \U0001f600\U0001f600"]
    texts += ["".join(rng.choice("ab c\n'std1é.,漢 \t") for _ in range(rng.randrange(300))) for _ in range(300)]
    want = [library.encode_ordinary(t) for t in texts]
    encoder = byte_bpe.Encoder(vocabulary)
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert [ids.tolist() for ids in encoder.encode(texts)] == want  # from the store
    monkeypatch.setattr(byte_bpe, "_PART", 5)  # every text in parts
    monkeypatch.setattr(byte_bpe, "_TOGETHER", 64)
    monkeypatch.setattr(byte_bpe, "_WIDE", 8)
    assert [ids.tolist() for ids in byte_bpe.Encoder(vocabulary).encode(texts)] == want


def test_tables(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "two words", "c"), (3, "two words", "c"), (None, "no id", None), (4, "unbroken" * 4_000, "d"), (5, "many short words " * 9_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumn("ids", F.lit("clash"))
    coded = byte_bpe.encode(docs)
    assert coded.columns == ["doc_id", "ids", "n_tokens"]
    got = {(r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in coded.collect()}
    assert coded.count() == len(rows)
    assert got == {(i, tuple(w := library.encode_ordinary(t or "")), len(w)) for i, t, _ in rows}
    back = byte_bpe.decode(coded.withColumn("Decoded", F.lit(1)))
    assert back.columns[-1] == "decoded_1"
    assert {(r["doc_id"], bytes(r["decoded_1"])) for r in back.collect()} == {(i, (t or "").encode()) for i, t, _ in rows}
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "`i.d` array<int>"), ids_col="i.d").first()["decoded"] == b""
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_a_step_climbs_once(vocabulary, monkeypatch):
    """The leaves that a merge sets are carried up together, and leave every node the least of those below."""
    words, calls, climb = [b"segment tree", b"leftmost pair"], [], byte_bpe._set

    def watched(tree, rows, at, keys, width):
        climb(tree, rows, at, keys, width)
        calls.append(len(rows))
        assert (tree[:, 1:width] == np.minimum(tree[:, 2 : 2 * width : 2], tree[:, 3 : 2 * width : 2])).all()

    monkeypatch.setattr(byte_bpe, "_set", watched)
    merged = [np.frombuffer(ids, np.int32).tolist() for ids in byte_bpe.merge(vocabulary, words)]
    assert merged == [loop(vocabulary.ranks, w) for w in words]
    assert len(calls) == max(len(w) - len(ids) for w, ids in zip(words, merged, strict=True))
