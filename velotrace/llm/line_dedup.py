"""Line-level deduplication with DataFrame operations only.

Lines are exploded with their position, normalised and hashed to 128 bits
(two independent 64-bit hashes), once: the hashed lines are written and read
for all that follows. Distinct documents per hash are counted in two steps,
first by hash and document, so the rows of a line that is found everywhere are
dealt over all tasks. The keys over the threshold are written as a table of
their own, so that Spark broadcasts it where it is small (by its size) and
splits the rows of a crowded key by its skew join where it is not. The
positions to drop are gathered per document and the text is put together again
from the positions that stay. Texts move once, with no line exploded.

Defined results: null or empty text is one empty line; rows that share an id
count as one document; a row with a null id keeps all its lines and counts for
no document; repeated rows get equal results. Empty tables give empty results.
All columns are carried whatever their names; those that are added by
:func:`drop_repeated_lines` take another name where theirs is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, quoted

#: The white space that is stripped at both ends of a line.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_BLANK))
    # lower() alters A-Z only where all characters take one byte
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``doc, t, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points.

    ``t`` hashes the text, so rows that share an id keep positions of their own.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    return (
        docs.where(quoted(id_col).isNotNull() & (F.length(text) >= min_chars))
        .select(quoted(id_col).alias("doc"), F.xxhash64(text).alias("t"), F.posexplode(_lines(quoted(text_col))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``doc, t, gone``: for each text with lines to drop, their positions."""
    lines = cut(hashed_lines(docs, id_col, text_col, min_chars), "line-hashes")
    by_doc = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    repeated = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    repeated = cut(repeated.select("h1", "h2", "keeper"), "line-repeats")
    return (
        lines.join(repeated, ["h1", "h2"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "t")
        .agg(F.collect_list("pos").alias("gone"))
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """All rows and columns of ``docs``, then ``kept_text, n_lines, n_dropped``.

    A key (see :func:`line_key`) of at least ``min_chars`` code points found in
    at least ``min_docs`` documents loses all its lines but those of the
    largest id that holds it. A new column whose name ``docs`` has already
    takes the next free one (``n_lines_1``); their places are the last three.
    """
    doc, t, gone, lines = free_names(docs, "doc", "t", "gone", "lines")
    added = free_names(docs, "kept_text", "n_lines", "n_dropped")
    text = F.coalesce(quoted(text_col), F.lit(""))
    found = repeated_lines(docs, id_col, text_col, min_chars, min_docs).toDF(doc, t, gone)
    joined = docs.join(found, (quoted(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(t)), "left")
    # split once: inside transform() the expression would run again for every line
    split = joined.withColumn(lines, _lines(quoted(text_col)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return split.select(
        *map(quoted, docs.columns),
        kept.alias(added[0]),
        F.size(lines).cast("long").alias(added[1]),
        F.coalesce(F.size(F.array_distinct(gone)), F.lit(0)).cast("long").alias(added[2]),
    )
