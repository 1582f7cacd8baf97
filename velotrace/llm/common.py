"""Helpers shared by the corpus operators: shared tables, components, batches.

Nothing here collects rows: the driver sees counts and checksums only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all work runs on one machine (tests) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the columns ``by``, and read it back.

    The result has no lineage behind it, is computed once however often it is
    used, and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest vertex reachable from every vertex that has an edge.

    ``edges`` holds two comparable columns ``a`` and ``b``; self loops, repeats
    and both directions are allowed. Returns ``vertex, root`` with one row per
    vertex of a proper edge (a vertex without one is its own root). Alternates
    large-star and small-star rounds; each round is written to the shared
    folder, and only a count and a checksum of it reach the driver. Minima are
    pre-aggregated before each shuffle, written and joined back: by broadcast
    where the written table is small, else by a join whose crowded keys Spark
    splits, so a hub is never held in one task.
    """
    now = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    seen = _checksum(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), f"{name}-low")
        # large star: neighbours above a vertex move to the least of its neighbourhood
        large = (
            both.join(low, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        # small star: a vertex and its neighbours below it move to the least of them
        large = cut(large, f"{name}-large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-least")
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        after = cut(small, name)
        found = _checksum(after)
        for done in (now, low, large, least):
            discard(done)
        now = after
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def quoted(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: Sequence[str], budget: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``budget`` characters, to bound working memory."""
    start, used = 0, 0
    for i, text in enumerate(texts):
        if used and used + len(text) > budget:
            yield start, i
            start, used = i, 0
        used += len(text)
    if start < len(texts):
        yield start, len(texts)


def held_out(id_col: str):
    """True where crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Let Arrow batches of this session hold ``most`` bytes at most, to bound the memory of Python workers.

    For operators whose workers hold several times their batch. A smaller
    setting stays; the setting is read when a query runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    now = int(size) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


class Store:
    """Bounded memory of a worker: two generations of at most ``cap`` entries.

    An entry that is used again moves to the young generation, so frequent
    ones stay when the old generation is let go.
    """

    def __init__(self, cap: int):
        self.cap, self.young, self.old = cap, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.cap:
            self.old, self.young = self.young, {}
        self.young[key] = value
