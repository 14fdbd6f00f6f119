"""The events table, its ledger of processed batches, telemetry logs and alert files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import prepare
from tidewatch.sources.schemas import EVENTS

# fixed values: column order of the telemetry logs
LOG_COLUMNS = {
    "residual": ["Timestamp", "Source_IP", "Residual", "Velocity", "Acceleration"],
    "stealth": ["Timestamp", "Source_IP", "IAT_mean", "SA_ratio"],
    "spatial": ["Timestamp", "Target_Port", "Jaccard_Score"],
    "dns": ["Timestamp", "Source_IP", "Domain", "Entropy"],
}
KEPT_ALERTS = 1000


def write_events(events: DataFrame, path: str, batch_id: int) -> None:
    """Stores one batch, partitioned by date and batch.

    A replayed batch overwrites exactly its own partitions, so a restart leaves no
    duplicates; one that compaction has taken up already is left as it is. Rows without
    time, source or verdict are refused.
    """
    if batch_id <= compacted_upto(events.sparkSession, path):
        return
    rows = events.select(
        F.col("time"),
        "source_ip",
        "analyzer",
        F.coalesce("is_host_ip", F.lit(False)).alias("is_host_ip"),
        "velocity",
        "acceleration",
        "iat_mean",
        "sa_ratio",
        "jaccard_score",
        "entropy_shannon",
        "probability",
        "prediction",
    )
    required = [F.col(c).isNotNull() for c in ("time", "source_ip", "probability", "prediction")]
    complete = required[0] & required[1] & required[2] & required[3]
    checked = rows.filter(F.when(complete, True).otherwise(F.raise_error(F.lit("incomplete event row"))))
    (
        checked.withColumns({"date": F.to_date("time"), "ingest_batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "ingest_batch_id")
        .parquet(path)
    )


def folder_of(spark: SparkSession, path: str):
    """File system and path object of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def numbered_folders(spark: SparkSession, path: str, key: str) -> dict[int, object]:
    """The folders `key=<number>` below `path`, by number."""
    files, folder = folder_of(spark, path)
    found = [status.getPath() for status in files.listStatus(folder)] if files.exists(folder) else []
    named = [p for p in found if p.getName().startswith(f"{key}=")]
    return {int(p.getName().removeprefix(f"{key}=")): p for p in named}


def segments(path: str) -> str:
    """Where the compacted batches of an events table are."""
    return f"{path}_segments"


def compacted_upto(spark: SparkSession, path: str) -> int:
    """The last batch that is read from a segment; below every batch if there is none."""
    return max(numbered_folders(spark, segments(path), "upto"), default=-(2**63))


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """The events of the batches that no segment holds yet."""
    prepare(spark)
    stored = spark.read.schema(f"{EVENTS}, date date").parquet(path)
    bound = compacted_upto(spark, path)
    return stored.filter(F.col("ingest_batch_id") > bound) if bound > -(2**63) else stored


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with their date partition; filter on `date` next to `time` to prune.

    A batch comes from a segment or from its own files, never from both: one bound, read
    once, decides for the whole plan. A segment that appears later does not change it.
    """
    prepare(spark)
    stored = spark.read.schema(f"{EVENTS}, date date").parquet(path)
    bound = compacted_upto(spark, path)
    if bound == -(2**63):
        return stored
    packed = spark.read.schema(f"{EVENTS}, date date, upto bigint").parquet(segments(path))
    return stored.filter(F.col("ingest_batch_id") > bound).unionByName(
        packed.filter(F.col("upto") <= bound).drop("upto")
    )


def since(start: Column) -> Column:
    """Time filter that also prunes date partitions."""
    return (F.col("date") >= F.to_date(start)) & (F.col("time") >= start)


def append_ledger(batches: DataFrame, path: str) -> None:
    batches.select("ingest_batch_id").write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema("ingest_batch_id bigint").parquet(path)


def append_log(rows: DataFrame, kind: str, path: str, fmt: str = "parquet") -> None:
    """Appends telemetry rows in the column order of that log."""
    writer = rows.select(*LOG_COLUMNS[kind]).write.mode("append").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_once(rows: DataFrame, folder: str, batch_id: int, fmt: str = "parquet") -> bool:
    """Adds a micro-batch to a folder of batches, whole or not at all; False if it is there.

    The files are written aside and come into the folder by one rename, so a reader of the
    folder never sees a part of a batch, and a replayed batch is neither written nor seen a
    second time.
    """
    spark = rows.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, aside = paths(f"{folder}/batch={batch_id}"), f"{folder}_unfinished/batch={batch_id}"
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    rows.write.mode("overwrite").format(fmt).save(aside)
    files.mkdirs(target.getParent())
    if not files.rename(paths(aside), target):
        raise OSError(f"batch {batch_id} could not be moved to {folder}")
    return True


def newest_alerts(alerts: DataFrame, n: int = KEPT_ALERTS) -> DataFrame:
    """The rows an alert file may hold; a fixed small number."""
    return alerts.orderBy(F.desc("time"), "source_ip").limit(n)


def rotate_alerts(alerts: DataFrame, path: str, n: int = KEPT_ALERTS) -> None:
    """Writes the newest alert lines to a new text folder, oldest first."""
    newest_alerts(alerts, n).orderBy("time", "source_ip").select("line").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def write_training_batch(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def drop_expired(spark: SparkSession, path: str, as_of: Column, days: int) -> list[str]:
    """Removes the date partitions that lie wholly before the retention period.

    Directories are removed and nothing is rewritten: the files of kept days stay as they
    are, and what the first kept day holds of the time before is left to `since`. The days of
    segments go the same way; an emptied segment stays as a mark of its bound. Returns the
    removed dates.
    """
    start = as_of - F.make_dt_interval(days=F.lit(days))
    first = spark.range(1).select(F.to_date(start).cast("string")).first()[0]
    files, folder = folder_of(spark, path)
    expired = set()
    for parent in [folder, *numbered_folders(spark, segments(path), "upto").values()]:
        for stored in [status.getPath() for status in files.listStatus(parent)]:
            name = stored.getName()
            if name.startswith("date=") and name.removeprefix("date=") < first:
                files.delete(stored, True)
                expired.add(name.removeprefix("date="))
    return sorted(expired)
