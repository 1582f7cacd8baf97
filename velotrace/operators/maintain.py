"""Keyed maintenance of stored tables as batch merges."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Folders whose recordings are not indexed.
SKIPPED = (".git", "node_modules", ".venv", "venv", "__pycache__")


def list_recordings(spark: SparkSession, root: str, suffix: str = ".fit") -> DataFrame:
    """``path, length, modificationTime`` of recordings below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return recordings(files.select("path", "length", "modificationTime"), suffix)


def recordings(files: DataFrame, suffix: str = ".fit") -> DataFrame:
    inside = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return files.where(F.lower("path").endswith(suffix) & ~F.col("path").rlike(f"(^|/)({inside})/"))


def read_decoded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Decoded sessions with nested ``records`` as one row per record, numbered by ``record_index``.

    The schema says what is read: fields that a file lacks, in sessions or
    records, are NULL, and others are passed over. A session without records
    has no row.
    """
    nested = spark.read.schema(schema).parquet(path)
    rest = [c for c in nested.columns if c != "records"]
    return nested.select(*rest, F.posexplode("records").alias("record_index", "record")).select(*rest, "record_index", "record.*")


def index_new(files: DataFrame, activities: DataFrame) -> DataFrame:
    """Files whose path no activity has."""
    return files.join(activities.select("file_path"), "file_path", "left_anti")


def newest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one of the largest ``by``; a NULL ``by`` comes before all others."""
    known = F.struct(F.col(by).isNotNull().alias("known"), F.col(by).alias("by"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), known).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), patch: bool = False) -> DataFrame:
    """Merge by key. New rows win, but ``keep`` columns stay as stored and ``fill`` columns only fill gaps.

    With ``patch`` a NULL in a new row leaves the stored value. A column that
    ``new`` lacks stays as stored and is NULL in rows that come.
    """
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.join(n, on, "full_outer")
    given, out = F.coalesce("_new", F.lit(False)), []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys or c in fill or c not in new.columns:
            out.append(F.coalesce(a, b).alias(c))
        elif c in keep:
            out.append(F.when(F.col("_old"), a).otherwise(b).alias(c))
        elif patch:
            out.append(F.coalesce(b, a).alias(c))
        else:
            out.append(F.when(given, b).otherwise(a).alias(c))
    return joined.select(*out)


def upsert_activities(old: DataFrame, new: DataFrame) -> DataFrame:
    """By file path, the newest import of a batch first; stored masses and manual rates stay."""
    return upsert(old, newest(new, "file_path", "imported_s"), ["file_path"], keep=("manual_avg_hr", "manual_max_hr", "activity_id"), fill=("rider_mass_kg", "bike_mass_kg"))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "activity_id") -> DataFrame:
    """Rows of the keys in ``new`` replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_wheel_samples(old: DataFrame, imported: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples of imported activities go; those with a computable ratio come."""
    kept = old.join(imported.select("activity_id").distinct(), "activity_id", "left_anti")
    return kept.unionByName(samples.where("ratio IS NOT NULL"))


def latest_patch(patches: DataFrame, key: str, by: str) -> DataFrame:
    """Fold a log of patches: per column the last value given."""
    fields = [c for c in patches.columns if c not in (key, by)]
    return patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c in fields])


def _edited(activities: DataFrame, edits: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns of edited activities replaced, also by NULL; a column that ``edits`` lacks stays."""
    own = [c for c in columns if c in edits.columns]
    e = edits.select("activity_id", *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_edit"))
    joined = activities.join(e, "activity_id", "left")
    return joined.withColumns({c: F.when(F.col("_edit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in own}).select(*activities.columns)


def override_activity_hr(activities: DataFrame, analyses: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual mean and highest rates set; the analyses of the edited activities go."""
    return _edited(activities, edits, ("manual_avg_hr", "manual_max_hr")), analyses.join(edits.select("activity_id"), "activity_id", "left_anti")


def set_activity_mass(activities: DataFrame, edits: DataFrame) -> DataFrame:
    """Rider's and bike's masses of the edited activities, NULL allowed."""
    return _edited(activities, edits, ("rider_mass_kg", "bike_mass_kg"))


def add_missing_columns(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that are not there yet, as name -> (type, default)."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(d).cast(t) for n, (t, d) in columns.items() if n.lower() not in have})


def write_logs(logs: DataFrame, path: str) -> None:
    """JSON rows, a folder per day of ``ts`` (UTC session), so that reading and pruning touch whole folders."""
    logs.withColumn("log_date", F.to_date("ts")).write.mode("append").partitionBy("log_date").json(path)


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log rows with their ``log_date``; a filter on it reads the folders of those days only. A broken line has its text in ``broken``, all else NULL."""
    lines = spark.read.schema("value string, log_date date").text(path)
    parsed = F.from_json("value", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    return lines.select(parsed.alias("r"), "log_date").select("r.*", "log_date")


def drop_log_days(spark: SparkSession, path: str, days: int, today: datetime.date) -> list[str]:
    """Delete the folders of days more than ``days`` before ``today``; 0 days keep everything. Returns the days that went."""
    if not days:
        return []
    oldest = (today - datetime.timedelta(days)).isoformat()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name, _, day = status.getPath().getName().partition("=")
        if name == "log_date" and day < oldest and files.delete(status.getPath(), True):
            gone.append(day)
    return sorted(gone)


def prune_logs(logs: DataFrame, days: int, now) -> DataFrame:
    """Rows within the retention; 0 days keep everything."""
    return logs if days == 0 else logs.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def index_report(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def patch_log_rows(patches: DataFrame, key: str, by: str) -> DataFrame:
    """Running state after each patch."""
    w = W.partitionBy(key).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    fields = [c for c in patches.columns if c not in (key, by)]
    return patches.select(key, by, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in fields])
