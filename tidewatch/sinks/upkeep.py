"""Small files of the events table packed into segments, while readers go on.

The table is written batch by batch, a folder per date and batch. A segment holds many
batches with one folder per date, so that a year of ten-second batches does not become
millions of files. It appears by one rename, and its name gives the last batch in it: a
reader that knows the segment takes those batches from there, a reader that does not takes
them from their own folders. Batch numbers must rise, as those of a streaming query do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sinks.events import compacted_upto, folder_of, numbered_folders, read_loose, segments


def settled_upto(batches: DataFrame, ledger: DataFrame, last: int) -> int | None:
    """The largest batch up to `last` before which, itself included, every batch is in the
    ledger; None if there is none.

    `batches` and `ledger` have an `ingest_batch_id`. Two numbers reach the driver.
    """
    stored = batches.filter(F.col("ingest_batch_id") <= last).select("ingest_batch_id").distinct()
    done = ledger.select("ingest_batch_id").distinct().withColumn("_done", F.lit(True))
    marked = stored.join(done, "ingest_batch_id", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    waiting = marked.agg(F.min(F.when(~F.col("_done"), F.col("ingest_batch_id")))).scalar()
    before = F.col("_done") & (waiting.isNull() | (F.col("ingest_batch_id") < waiting))
    return marked.agg(F.max(F.when(before, F.col("ingest_batch_id")))).first()[0]


def compact_events(spark: SparkSession, path: str, ledger: DataFrame, last: int) -> int | None:
    """Packs the processed batches up to `last` into a segment; the bound, or None.

    Only batches that the ledger holds are packed, so sanitation never has to open a
    segment. `last` must lie before the batches that a restarted stream may write again.
    Rows keep all columns, their batch included, and are sorted by it inside the files.
    Rebalancing cuts a large date over several tasks and puts small ones together. A run that
    fails leaves nothing that a reader sees, and the next run starts anew.
    """
    loose = read_loose(spark, path)
    bound = settled_upto(loose, ledger, last)
    if bound is None:
        return None
    aside, target = f"{path}_unfinished/upto={bound}", f"{segments(path)}/upto={bound}"
    (
        loose.filter(F.col("ingest_batch_id") <= bound)
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "ingest_batch_id", "time", "source_ip")
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(aside)
    )
    files, home = folder_of(spark, segments(path))
    files.mkdirs(home)
    if not files.rename(folder_of(spark, aside)[1], folder_of(spark, target)[1]):
        raise OSError(f"segment {bound} could not be moved to {segments(path)}")
    return bound


def drop_compacted(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes the folders of batches that a segment holds; how many.

    The batches of the `keep` newest segments keep their own folders, for readers that
    planned before those segments came. Folders of dates stay until retention takes them, as
    a new batch may be on its way into one.
    """
    bounds = sorted(numbered_folders(spark, segments(path), "upto"))
    passed = bounds[: len(bounds) - keep]
    if not passed:
        return 0
    files, folder = folder_of(spark, path)
    removed = 0
    for date in [status.getPath() for status in files.listStatus(folder)]:
        if not date.getName().startswith("date="):
            continue
        batches = numbered_folders(spark, date.toString(), "ingest_batch_id")
        for batch in [b for b in batches if b <= passed[-1]]:
            removed += bool(files.delete(batches[batch], True))
    return removed
