"""Incremental indexing of decoded recordings: only files not seen before, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.maintain import newest, upsert_activities

#: Parts of the activity table; each batch rewrites those that its files fall into.
BUCKETS = 256


def index_available(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Merge all sessions that have arrived since the last run into the activity table at ``target``.

    The stream's checkpoint remembers which files were read; ``buckets`` must
    stay the same for a table.
    """
    arrived = spark.readStream.schema(schema).parquet(source)
    merge = lambda batch, number: merge_batch(batch, number, target, buckets)
    arrived.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_batch(batch: DataFrame, number: int, target: str, buckets: int = BUCKETS) -> None:
    """Write the buckets of a batch's files anew, as version ``number`` beside the older ones.

    A batch reads older versions only, so one that is repeated after a failure
    gives the same table. Readers take the versions that carry Spark's mark of
    a finished write, so they never see part of a batch. Parts replaced by
    batches before this one are deleted, so that readers have one batch's time.
    """
    spark = batch.sparkSession
    new = newest(batch, "file_path", "imported_s").withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
        parts = _newest_parts(spark, target, number)
        old = _read(spark, target, [p for b, p in parts.items() if b in touched])
        rows = new.drop("bucket")
        merged = rows if old is None else upsert_activities(old, rows)
        if touched:
            merged.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number:010d}")
    finally:
        new.unpersist()
    _delete_replaced(spark, target, parts, number)


def latest_version(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table as the newest parts give it, or as it was before a batch; None where there is none."""
    return _read(spark, target, list(_newest_parts(spark, target, before).values()))


def _finished(spark: SparkSession, version: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _parts(spark: SparkSession, target: str, before: int | None) -> list[tuple[int, int]]:
    """(version, bucket) of all parts of finished versions."""
    versions = [v for v in _folders(spark, target, "version=") if (before is None or v < before) and _finished(spark, f"{target}/version={v:010d}")]
    return [(v, b) for v in versions for b in _folders(spark, f"{target}/version={v:010d}", "bucket=")]


def _newest_parts(spark: SparkSession, target: str, before: int | None) -> dict[int, str]:
    return {b: f"{target}/version={v:010d}/bucket={b}" for v, b in _parts(spark, target, before)}


def _read(spark: SparkSession, target: str, parts: list[str]) -> DataFrame | None:
    return spark.read.parquet(*parts) if parts else None


def _delete_replaced(spark: SparkSession, target: str, newest_before: dict[int, str], number: int) -> None:
    for v, b in _parts(spark, target, number):
        path = f"{target}/version={v:010d}/bucket={b}"
        if path != newest_before[b]:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def sessions_by_gap(samples: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Live effort runs: samples of an activity no further apart than ``gap``, as session windows under a watermark."""
    return (
        samples.withWatermark("ts", late)
        .groupBy("activity_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n"), F.avg("power").alias("avg_power"))
        .select("activity_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n", "avg_power")
    )
