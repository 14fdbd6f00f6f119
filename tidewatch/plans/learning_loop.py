"""Stored events to a new classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.operators import learning, models
from tidewatch.session import stage_path
from tidewatch.sinks.events import append_ledger, read_ledger, read_loose, write_training_batch
from tidewatch.sources.schemas import FEATURE_COLUMNS


def sanitize(
    spark: SparkSession,
    events_path: str,
    ledger_path: str,
    batch_path: str,
    as_of: Column,
    p: Profile,
    host: learning.Hosts | DataFrame = None,
) -> bool:
    """One sanitation run; False when no confident row was waiting.

    The batch is written before the ledger, so a run that fails in between selects the
    same rows again. Segments hold processed batches only and are not opened.
    `host` is an address, a condition on the events or a table of trusted hosts.
    """
    ledger = read_ledger(spark, ledger_path)
    events = learning.waiting_only(read_loose(spark, events_path), ledger)
    if isinstance(host, DataFrame):
        events, host = learning.with_hosts(events, host)
    batch = learning.sanitized_batch(events, ledger, as_of, p, host)
    marks = learning.processed_batches(events, ledger, as_of, p, host)
    if batch.isEmpty():
        return False
    write_training_batch(batch.select(*FEATURE_COLUMNS, "label"), batch_path)
    append_ledger(marks, ledger_path)
    return True


def training_set(
    historical: DataFrame,
    events: DataFrame,
    as_of: Column,
    p: Profile,
    host: learning.Hosts | DataFrame = None,
) -> DataFrame:
    """History and recent confident events, balanced one to one.

    Balancing reads the rows several times, so they are written to a stage table first.
    Rows get an identity out of their content, so the sample does not depend on how the
    input is partitioned.
    """
    spark = events.sparkSession
    if isinstance(host, DataFrame):
        events, host = learning.with_hosts(events, host)
    recent = learning.adaptive_rows(events, as_of, p, host)
    rows = learning.union_labelled(historical, recent)
    path = stage_path(spark, "training-rows")
    rows.withColumn("id", F.concat_ws("|", *FEATURE_COLUMNS, "label")).write.parquet(path)
    return learning.balanced(spark.read.parquet(path), "id", p)


def retrain(
    historical: DataFrame,
    events: DataFrame,
    as_of: Column,
    p: Profile,
    root: str,
    version: int,
    host: learning.Hosts | DataFrame = None,
    iterations: int = 500,
) -> str | None:
    """Trains and publishes a classifier; None while benign rows are too few."""
    rows = training_set(historical, events, as_of, p, host)
    if rows.isEmpty():
        return None
    classifier = models.fit_classifier(rows, models.ADAPTIVE_LAYERS, iterations)
    return models.publish(classifier, root, version)
