"""Queries over the corpus tables, one for each operator, and their SQL where there is any."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, embedding_dedup, language_id, lexical_search, license_scan, line_dedup, media, packing, quality, sentencepiece, simhash, token_counts
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = license_scan.scan(_table(spark, sf_dir, "documents"))
    return hits.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece.encode(_table(spark, sf_dir, "documents"))
    return sentencepiece.decode(coded).select(
        "doc_id", "n_pieces", "n_byte_pieces", "score", F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, "doc_id", "text", "lang", ~held_out("doc_id"))
    predict = language_id.predictor(model)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(F.col("text")).alias("r")).select("doc_id", "held_out", "r.*")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality.scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lengths = conversation_trie.regrow(conversation_trie.turns(_table(spark, sf_dir, "conversations")))
    nodes, ends = conversation_trie.trie(rows, lengths)
    told = nodes.join(conversation_trie.end_digests(ends), conversation_trie.KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents")))
    ids_sha256 = F.sha2(byte_bpe.little_endian("ids"), 256).alias("ids_sha256")
    return coded.select("doc_id", "n_tokens", ids_sha256, F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_packing, op3_simhash, op4_line_dedup, op5_sentencepiece, op6_embedding_dedup, op7_token_counts, op8_language_id, op9_media, op10_quality, op11_conversation_trie, op12_lexical_search, op13_byte_bpe)
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_conversation_trie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
  SELECT c, n, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
), rebuilt AS (
  SELECT s.c, o.p, o.role, o.text FROM sized s JOIN own o ON o.c = s.base AND o.p <= s.h
  UNION ALL
  SELECT s.c, o.p - s.h + least(s.h, coalesce(b.n, 0)), o.role, o.text
  FROM sized s JOIN own o ON o.c = s.c AND o.p > s.h LEFT JOIN sized b ON b.c = s.base
), prefixes AS (
  SELECT c, p AS d, text, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY p) AS k,
         p = max(p) OVER (PARTITION BY c) AS last
  FROM rebuilt
  UNION ALL
  SELECT c, 0, '', [], c NOT IN (SELECT c FROM rebuilt) FROM sized
), nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(strlen(text)) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes x WHERE x.d = n.d + 1 AND x.k[:n.d] = n.k) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[:n.d - 1]
)
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
       sum(b.saved)::BIGINT AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked b ON b.d >= a.d AND b.k[:a.d] = a.k
GROUP BY ALL
""",
    "op12_lexical_search": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_all FROM split),
asked AS (
  SELECT item_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM split)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, sized GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT AS score
  FROM held JOIN weighed USING (term) JOIN asked USING (term), sized GROUP BY ALL
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
""",
    "op6_embedding_dedup": r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN degree d ON e.vec_id = d.a
""",
}
