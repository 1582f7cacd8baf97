"""Ranked search against scoring every document: nulls, ties, copies, long texts, joins that shuffle, empty tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from velotrace.llm import lexical_search

DOCS = "doc_id long, text string, item_id string, score string, term string, tid string, `rank` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, n_all = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    counts = [(i, len(t), Counter(t)) for i, t in split]
    df, out = Counter(x for _, _, c in counts for x in c), []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for row, (i, n, c) in enumerate(counts):
            m, score = 75 + (25 * n * n_docs) // max(n_all, 1), 0
            for x, q in asked.items():
                if c[x]:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, row))
        out += [(item, r, docs[row][0], -s) for r, (s, _, _, row) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(None, "no id w3 w5 w9"), (5000, None), (5001, ""), (5002, " \t.,"), (5003, "Ünï-CÖDE É w1\x00w2 日本語"), (5004, "w7 " * 3000)]
    docs += [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 10, 40, 200])))) for i in range(700)]
    docs += [(6000 + i, docs[40][1]) for i in range(300)] + [(41, docs[41][1])] * 2
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30])))) for i in range(25)]
    items += [(100, None), (101, "nothing-of-this appears"), (102, "w0"), (103, "w0 w0 W1"), (None, "w5 w9 w120"), (104, dict(docs)[40]), (4, "w3 code É"), (105, "w399"), (106, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("shuffled", [False, True])
def test_every_document_scored(spark, monkeypatch, shuffled):
    docs, items = made()
    monkeypatch.setattr(lexical_search, "CHAMPIONS", 25)
    if shuffled:
        monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", 0)
        monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lexical_search, "_CHUNK", 10)
    d = spark.createDataFrame([(*r, "i", "s", "t", "x", "r") for r in docs], DOCS).repartition(3)
    got = lexical_search.search(d, spark.createDataFrame([(*r, "d", "r") for r in items], "item_id long, text string, doc_id string, row string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 20)


def test_tiers_are_left_early(spark):
    """Items with rare terms are proven before the last tier, and the index holds every posting once."""
    docs, items = made()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    numbers, n = lexical_search.numbered(lexical_search.item_terms(q)[1])
    index = lexical_search.build(d, lexical_search.cut(numbers, "test-numbers"), n)
    asked = {x for _, t in items for x in terms(t)}
    df = Counter(x for _, t in docs for x in set(terms(t)) if x in asked)
    tiers = {r["tier"]: r["count"] for r in index.postings.groupBy("tier").count().collect()}
    assert sum(tiers.values()) == sum(df.values())
    assert len(tiers) > 2
    rest = index.postings.join(index.terms, "tid").where("tier > 0").groupBy("tid").agg(F.max("factor").alias("most"), F.first("rest").alias("rest"))
    assert rest.where("most <> rest").count() == 0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("false")), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        assert lexical_search.search(d, q).collect() == []
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == plain([(1, "a b")], [(1, "a")], 20)
