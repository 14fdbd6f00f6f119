"""What the corpus operators share: staging, keys and word boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage_path

# fixed values: the white space of the contracts, and a word as the rest
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back; `settings` hold for that write.

    That cuts the lineage at a table which survives lost executors. The shuffle files
    that the write needed are released when it ends, so the disk holds one phase of a
    long operator at a time. Row numbers belong into `df`: numbered after the reread, rows
    would get other numbers in each job whose scan is split otherwise.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    wanted = {CLEANUP_KEY: "true", **(settings or {})}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column, modulus: int) -> Column:
    """The document's fold: crc32 of its id as text, modulo `modulus` (null without an id)."""
    return F.crc32(doc_id.cast("string")) % modulus
