"""Ranked lexical search over a tiered index.

A term's contribution to a document is its weight times a saturating factor of
its occurrences and the document's length, all in whole numbers, and a
document's score sums the contributions of the item's terms. The index holds
every posting of every term that any item asks for, in tiers: tier 0 has each
term's ``CHAMPIONS`` postings of highest impact and the whole lists of rare
terms; each further tier adds the whole lists of terms up to twice as frequent,
and the last one has the rest. A term whose list a tier does not hold has a
residual bound there: the highest impact among its postings left out.

All items start at tier 0. There a document's known contributions bound its
score from below, and with the residual bounds of its unknown terms from above.
The ``k`` best by lower bound are scored exactly, and the least of those scores
is a floor under the item's result. If an item's residual bounds together are
below the floor, no document outside the tier's postings can be in its result:
the item is proven, and the documents whose upper bound reaches the floor are
scored exactly and ranked. An item without that proof falls through to the next
tier; the last tier leaves nothing out and proves every item. Nothing is cut
off: equal scores at the edge are all scored and ordered by id.

Postings of a term, documents of an item and copies of a text may be any share
of the rows: lists are read as rows, sums are pre-aggregated, and the best k
are taken within tasks before they are shuffled. The items' terms are sent to
the workers only if they are ``BROADCAST_TERMS`` at most, and small tables are
broadcast only below ``BROADCAST_ROWS``; beyond that, joins shuffle.

Defined results: a null text has no term; a document without terms counts
nowhere; each row of the items is searched for itself and reported under its
id, null or repeated ids too; each row of the documents is a document, null
ids come last among equals, and rows equal in score and id in the order in
which they were read. Without documents or items the result is empty. Other
columns are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, quoted

K = 20
#: Postings of highest impact that tier 0 holds of a frequent term, and the number of further tiers: a term's whole list is in
#: tier 0 if at most 1 of 2**TIERS documents has it, in the last if more than half of them have.
CHAMPIONS, TIERS = 128, 5
BROADCAST_TERMS, BROADCAST_ROWS = 300_000, 300_000
#: Factors (0 to 1,000,000) that count as one when a term's champions are chosen.
_STEP = 1024
#: Bytes of a text whose words are held at once.
_CHUNK = 1 << 22
#: Fixed values of term rules: bytes of letters, digits and everything beyond ASCII stay, A-Z become a-z, all others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: str | None) -> tuple[int, Counter]:
    """Number of a text's terms with repeats, and how often each (as UTF-8) occurs."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    n, found, start = 0, Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + _CHUNK)
        words = data[start : end if end >= 0 else len(data)].split()
        n += len(words)
        found.update(words)
        start = end if end >= 0 else len(data)
    return n, found


@dataclass
class Index:
    """``docs``: row, doc_id, n. ``terms``: tid, df, w, list_tier, rest. ``postings``: row, tid, factor, and its tier."""

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    _hits: DataFrame
    factor: str

    def hits(self, rows: DataFrame) -> DataFrame:
        """``row, tid, factor`` of all terms of the documents in ``rows``."""
        found = self._hits.join(rows, "row", "left_semi")
        return _exploded(found).select("row", "tid", F.expr(self.factor).alias("factor"))


def _exploded(stored: DataFrame) -> DataFrame:
    """``row, n, tid, tf``: a row a posting."""
    return stored.select("row", "n", F.explode(F.arrays_zip("tids", "tfs")).alias("p")).select("row", "n", F.col("p.tids").alias("tid"), F.col("p.tfs").cast("long").alias("tf"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``item, item_id`` of every row, and ``item, term, qtf`` of its terms."""

    @F.pandas_udf("terms array<string>, qtfs array<long>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        rows = [term_counts(t)[1] for t in texts]
        return pd.DataFrame({"terms": [[w.decode("utf-8", "surrogatepass") for w in c] for c in rows], "qtfs": [list(c.values()) for c in rows]})

    read = cut(items.select(F.monotonically_increasing_id().alias("item"), quoted(id_col).alias("item_id"), counted(F.coalesce(quoted(text_col), F.lit(""))).alias("t")), "search-items")
    asked = read.select("item", F.explode(F.arrays_zip("t.terms", "t.qtfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.qtfs").alias("qtf"))
    return read.select("item", "item_id"), asked


def numbered(asked: DataFrame) -> tuple[DataFrame, int]:
    """``term, tid`` of the distinct terms asked for, and how many they are; a term's number is a hash that no other of them has."""
    seed = 0
    while True:
        terms = asked.select("term").distinct().withColumn("tid", F.xxhash64(F.lit(seed), "term"))
        n = terms.agg(F.count("*").alias("n"), F.count_distinct("tid").alias("tids")).first()
        if n["n"] == n["tids"]:
            return terms, n["n"]
        seed += 1


def _stored(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n, tids, tfs``: of every document, the terms that are asked for."""
    spark, text = docs.sparkSession, F.coalesce(quoted(text_col), F.lit(""))
    bounded_batches(spark)
    if n_terms <= BROADCAST_TERMS:
        shipped = spark.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass"): r["tid"] for r in terms.collect()})

        @F.pandas_udf("n long, tids array<long>, tfs array<int>")
        def counted(texts: pd.Series) -> pd.DataFrame:
            known, rows = shipped.value, []
            for t in texts:
                n, found = term_counts(t)
                asked = [(known[w], c) for w, c in found.items() if w in known]
                rows.append((n, [t for t, _ in asked], [c for _, c in asked]))
            return pd.DataFrame(rows, columns=["n", "tids", "tfs"])

        read = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("doc_id"), counted(text).alias("c"))
        return cut(read.select("row", "doc_id", "c.*"), "search-documents")

    @F.pandas_udf("n long, terms array<string>, tfs array<int>")
    def counted_all(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, found = term_counts(t)
            rows.append((n, [w.decode("utf-8", "surrogatepass") for w in found], list(found.values())))
        return pd.DataFrame(rows, columns=["n", "terms", "tfs"])

    read = cut(docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("doc_id"), counted_all(text).alias("c")).select("row", "doc_id", "c.*"), "search-all")
    each = read.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    kept = each.join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("tid", "tf")).alias("p"))
    return cut(read.drop("terms", "tfs").join(kept.select("row", F.col("p.tid").alias("tids"), F.col("p.tf").alias("tfs")), "row", "left"), "search-documents")


def build(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The tiered index of the terms given, over all documents."""
    stored = _stored(docs, terms, n_terms, id_col, text_col)
    size = stored.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_all = size["n"], size["l"] or 1
    factor = f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {n_docs}) div {n_all}))"
    hits = _exploded(stored).select("row", "tid", F.expr(factor).alias("factor"))
    # how many postings have which factor; a term has at most 1,000,000 / _STEP rows, whatever its list
    counts = hits.groupBy("tid", F.expr(f"factor div {_STEP}").alias("step")).agg(F.count("*").alias("n"), F.max("factor").alias("most"))
    best_first = Window.partitionBy("tid").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("so_far") > CHAMPIONS
    stats = (
        counts.withColumn("so_far", F.sum("n").over(best_first))
        .groupBy("tid")
        .agg(F.sum("n").alias("df"), F.min(F.when(~left, F.col("step"))).alias("bar"), F.max(F.when(left, F.col("most"))).alias("rest"))
    )
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    told = cut(stats.select("tid", "df", weight.alias("w"), _list_tier(n_docs).alias("list_tier"), "bar", F.coalesce("rest", F.lit(0)).alias("rest")), "search-terms")
    champion = F.col("factor") >= F.coalesce("bar", F.lit(1 << 40)) * _STEP
    placed = hits.join(_small(told.select("tid", "bar", "list_tier"), n_terms), "tid").select("row", "tid", F.col("factor").cast("int").alias("factor"), F.when(champion, F.lit(0)).otherwise(F.col("list_tier")).alias("tier"))
    return Index(stored.select("row", "doc_id", "n"), told, cut(placed, "search-postings", "tier"), stored, factor)


def _list_tier(n_docs: int) -> Column:
    """0 if at most 1 of 2**TIERS documents has a term, one more for each doubling beyond."""
    return reduce(operator.add, [F.when(F.col("df") * (1 << (TIERS - t)) > n_docs, 1).otherwise(0) for t in range(TIERS)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _best(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of every item; tasks keep their own first k before they are shuffled."""
    first = Window.partitionBy("item").orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of every item with a score above 0, equal scores by id."""
    named, asked = item_terms(items, item_col, item_text_col)
    terms, n_terms = numbered(asked)
    terms = cut(terms, "search-numbers")
    index = build(docs, terms, n_terms, id_col, text_col)
    wanted = cut(asked.join(terms, "term").join(index.terms, "tid").select("item", "tid", "qtf", "w", "list_tier", "rest"), "search-wanted")
    n_wanted = wanted.count()
    open_, n_open = wanted.select("item").distinct(), n_wanted
    found = []
    for tier in range(TIERS + 1):
        if not n_open:
            break
        mine = wanted.join(_small(open_, n_open), "item", "left_semi")
        unknown = F.when(F.col("list_tier") > tier, F.col("qtf") * F.col("w") * F.col("rest")).otherwise(0)
        residual = mine.groupBy("item").agg(F.sum(unknown).alias("residual"))
        held = index.postings.where(F.col("tier") <= tier).join(_small(mine, n_wanted), "tid")
        sums = held.groupBy("item", "row").agg(F.sum(F.col("qtf") * F.col("w") * F.col("factor")).alias("score"), F.sum(unknown).alias("seen"))
        partial = cut(sums.where("score > 0"), f"search-partial-{tier}")
        first = _exact(index, wanted, n_wanted, _best(partial, k, "row").select("item", "row"))
        floor = first.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))
        told = cut(residual.join(floor, "item", "left").select("item", "residual", F.coalesce("floor", F.lit(0)).alias("floor")), f"search-told-{tier}")
        is_proven = (F.col("residual") < F.col("floor")) | (F.col("residual") == 0)
        reach = partial.join(_small(told.where(is_proven), n_wanted), "item").where(F.col("score") + F.col("residual") - F.col("seen") >= F.col("floor"))
        scored = _exact(index, wanted, n_wanted, reach.select("item", "row")).where("score > 0").join(index.docs.select("row", "doc_id"), "row")
        found.append(cut(_best(scored, k, F.asc_nulls_last("doc_id"), "row"), f"search-found-{tier}"))
        discard(partial)
        open_ = told.where(~is_proven).select("item")
        n_open = open_.count()
    done = found[0] if found else None
    if done is None:
        kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
        done = docs.sparkSession.createDataFrame([], f"item long, rank int, doc_id {kind}, score long")
    for one in found[1:]:
        done = done.unionByName(one)
    return done.join(named, "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _exact(index: Index, wanted: DataFrame, n_wanted: int, pairs: DataFrame) -> DataFrame:
    """``item, row, score``: the exact score of every pair."""
    pairs = cut(pairs, "search-pairs")
    n = pairs.count()
    rows = _small(pairs.select("row").distinct(), n)
    own = index.hits(rows).join(_small(pairs, n), "row").join(_small(wanted, n_wanted), ["item", "tid"])
    return own.groupBy("item", "row").agg(F.sum(F.col("qtf") * F.col("w") * F.col("factor")).alias("score"))
