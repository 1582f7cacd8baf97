"""The corpus pipeline on the smallest tables, stage by stage, against what the stages promise."""

import base64
import random
import string
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from velotrace.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "1 2 3", None, "s", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 1"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and docs.count() <= before, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
        if name == "language_id":
            assert docs.where(F.col("doc_id") >= 10**9).count() == 0
        if name == "line_dedup":
            assert kept[-1] == kept[-2] and docs.where(F.length("text") != F.col("n_chars")).count() == 0
    fps = [simhash.fingerprint(r["text"]) for r in docs.collect()]
    assert len(fps) > 100 and all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == kept[-1]


def test_language_stage(spark):
    """Misfiled texts go (letter noise may: the network gives much of it a clear language); clean texts, bilingual ones and those of unknown or unlearned language stay."""
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = docs.where("length(text) BETWEEN 1500 AND 4000").orderBy("doc_id").collect()
    of = {k: [r["text"] for r in long if r["lang"] == k][:12] for k in ("en", "de", "fr")}
    noise = ["".join(rng.choice("0123456789abcdef") for _ in range(2000)) for _ in range(20)] + [base64.b64encode(rng.randbytes(1500)).decode() for _ in range(20)]
    noise += [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 10))) for _ in range(300)) for _ in range(20)]
    clean = [(t, k) for k in of for t in of[k]] + [(t, None) for t in of["de"]] + [("Ist und der den.", "de")] + [(a[:1500] + "\n" + b[:1500], "en") for a, b in zip(of["en"], of["de"], strict=False)]
    wrong = [(t, "fr") for t in of["en"][:5]] + [(t, "en") for t in of["de"][:5]]
    made = [(10**6 + i, t, k) for i, (t, k) in enumerate(clean)] + [(2 * 10**6 + i, t, None) for i, t in enumerate(noise)] + [(3 * 10**6 + i, t, k) for i, (t, k) in enumerate(wrong)]
    held = next(i for i in range(4 * 10**6, 5 * 10**6) if zlib.crc32(str(i).encode()) % 5 == 0)
    made.append((held, of["de"][0], "not learned"))
    given = docs.unionByName(spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in made], docs.schema))
    left = Counter(r["doc_id"] // 10**6 for r in corpus_pipeline.identify_language(spark, given, SF).select("doc_id").collect())
    assert left[0] >= 0.995 * docs.count() and left[1] == len(clean)
    assert left[3] == 0 and left[4] == 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 100


def test_near_copies_by_row(spark):
    """Null ids and different texts under one id are judged each for itself; one row of each group stays."""
    long = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"term{i * 7}" for i in range(300))
    third = " ".join(f"item{i * 3}" for i in range(300))
    rows = [(5, long), (3, long), (5, other), (None, third), (None, third), (None, long), (9, None), (8, ""), (7, long), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    left = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, long), (5, other), (None, third), (8, "")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def _wide(docs):
    clash = ("row", "_row", "kept", "rank", "found", "_found", "score", "_score", "_doc", "doc", "n_lines", "kept_text", "lines", "id", "v")
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in clash], F.create_map(F.lit("k"), "source").alias("m")), clash


def test_stages_with_clashing_columns(spark):
    """Extra columns of any name come out of every stage with the values they had."""
    docs, clash = _wide(spark.read.parquet(f"{SF}/documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = docs.collect()
    assert len(rows) > 100 and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in clash) and all(r["m"] == {"k": r["source"]} for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_stages_on_empty_and_odd_tables(spark):
    docs, _ = _wide(spark.read.parquet(f"{SF}/documents.parquet"))
    for table in (docs.limit(0), docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")), docs.limit(2).withColumn("text", F.lit(None).cast("string"))):
        table = spark.createDataFrame(table.collect(), table.schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= table.count()


def test_one_of_repeated_rows_is_always_the_same(spark):
    rows = [(1, "a b c d e f", lang, "s", 0) for lang in ("de", "en", "fr", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    left = {tuple(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(order, schema).repartition(3), SF).first()) for order in (rows, rows[::-1])}
    assert len(left) == 1
