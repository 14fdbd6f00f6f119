"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pins the session time zone, so windows align the same way everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and stage tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder, which is remembered for the session.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def stage_path(spark: SparkSession, name: str) -> str:
    """A path for a new stage table that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later jobs neither compute it
    again nor depend on the executors that did."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
