"""Confident events to balanced, scaled training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.operators.scalars import row_of
from tidewatch.sources.schemas import FEATURE_COLUMNS

SEED = 42


Hosts = str | Column | None


def _is_host(host: str | Column) -> Column:
    return F.col("source_ip") == host if isinstance(host, str) else host


def confident(p: Profile, host: Hosts = None) -> Column:
    """Very likely benign, very likely an attack, or the host itself.

    `host` is an address, or a condition such as the one of `with_hosts`.
    """
    sure = (F.col("probability") <= p.safe_probability) | (
        F.col("probability") >= p.confident_probability
    )
    return sure if host is None else sure | _is_host(host)


def relabelled(host: Hosts = None) -> Column:
    label = F.col("prediction").cast("int")
    return label if host is None else F.when(_is_host(host), 0).otherwise(label)


def with_hosts(events: DataFrame, hosts: DataFrame) -> tuple[DataFrame, Column]:
    """Events joined to a table of trusted hosts, and the condition that a row is of one.

    The table (`source_ip`, repeated rows count once) may have any size; sources that are
    null are no host.
    """
    known = hosts.select("source_ip").distinct().withColumn("_trusted", F.lit(True))
    return events.join(known, "source_ip", "left"), F.coalesce("_trusted", F.lit(False))


def _training_rows(events: DataFrame, host: Hosts, extra: Sequence[str] = ()) -> DataFrame:
    return events.select(
        *extra, "source_ip", *FEATURE_COLUMNS, relabelled(host).alias("label")
    )


def unprocessed(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose ingest batch is not in the ledger of processed batches."""
    done = ledger.select("ingest_batch_id").distinct()
    return events.join(done, "ingest_batch_id", "left_anti")


def waiting_only(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """The same events with a filter on the batches that are not in the ledger.

    Where the batch is a partition of the table, their numbers come from the partitions
    alone, and no file of a processed batch is opened. The numbers of the batches since the
    last run reach the driver.
    """
    batches = unprocessed(events.select("ingest_batch_id").distinct(), ledger)
    return events.filter(F.col("ingest_batch_id").isin([r[0] for r in batches.collect()]))


def _pending(events: DataFrame, ledger: DataFrame, as_of: Column) -> DataFrame:
    """Unprocessed events of the batches that end by the snapshot time.

    A batch that reaches beyond it waits as a whole for a later snapshot, so that no row
    of it is marked unseen or selected twice.
    """
    waiting = unprocessed(events, ledger)
    ended = waiting.groupBy("ingest_batch_id").agg(F.max("time").alias("last")).filter(F.col("last") <= as_of)
    return waiting.join(ended.select("ingest_batch_id"), "ingest_batch_id", "left_semi")


def sanitized_batch(
    events: DataFrame, ledger: DataFrame, as_of: Column, p: Profile, host: Hosts = None
) -> DataFrame:
    """Confident unprocessed rows of the batches up to the snapshot, with their labels."""
    pending = _pending(events, ledger, as_of)
    return _training_rows(pending.filter(confident(p, host)), host, ("time",))


def processed_batches(events: DataFrame, ledger: DataFrame, as_of: Column, p: Profile, host: Hosts = None) -> DataFrame:
    """Batches to add to the ledger: every unprocessed one that ends by the snapshot.

    Nothing is marked when no confident row was selected.
    """
    pending = _pending(events, ledger, as_of)
    selected = pending.agg(F.coalesce(F.max(confident(p, host)), F.lit(False)).alias("any")).scalar()
    return pending.filter(selected).select("ingest_batch_id").distinct()


def later_than(events: DataFrame, start: Column) -> Column:
    """Time filter that also prunes date partitions where `events` has them."""
    later = F.col("time") > start
    return later & (F.col("date") >= F.to_date(start)) if "date" in events.columns else later


def adaptive_rows(
    events: DataFrame, as_of: Column, p: Profile, host: Hosts = None
) -> DataFrame:
    """Confident rows of the last days, processed or not."""
    since = as_of - F.make_dt_interval(days=F.lit(p.lookback_days))
    recent = events.filter(later_than(events, since) & confident(p, host))
    return _training_rows(recent, host, ("time",))


def union_labelled(*sets: DataFrame) -> DataFrame:
    """Bag union of labelled feature rows."""
    columns = [*FEATURE_COLUMNS, "label"]
    stacked = sets[0].select(*columns)
    for other in sets[1:]:
        stacked = stacked.unionByName(other.select(*columns))
    return stacked


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def order_key(identity: Column, seed: int = SEED) -> Column:
    """Reproducible random order: the hash of the seed and the row identity."""
    return F.md5(F.concat(F.lit(f"{seed}-"), identity.cast("string")))


def smallest_n(df: DataFrame, key: Column, ties: Column, n: Column) -> DataFrame:
    """The `n` rows with the smallest hash `key`, for any size of `n`.

    Rows are counted per leading 16 bits of the hash. Buckets that fit entirely are kept
    without sorting; only the bucket where the quota ends is ranked. No row set passes
    through one task.
    """
    bucket = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")
    keyed = df.withColumn("_key", key).withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.greatest(F.lit(0), F.least(F.col("_size"), n - (F.sum("_size").over(upto) - F.col("_size"))))
    # 16 bits: at most 65,536 short rows, ordered here and broadcast below
    quotas = sizes.select("_bucket", "_size", quota.alias("_quota")).filter(F.col("_quota") > 0)

    whole = quotas.filter(F.col("_quota") == F.col("_size")).select("_bucket")
    partial = quotas.filter(F.col("_quota") < F.col("_size")).select("_bucket", "_quota")
    ranked = keyed.join(F.broadcast(partial), "_bucket").withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", ties)),
    )
    return (
        keyed.join(F.broadcast(whole), "_bucket", "left_semi")
        .unionByName(ranked.filter(F.col("_rank") <= F.col("_quota")).drop("_quota", "_rank"))
        .drop("_key", "_bucket")
    )


def balanced(df: DataFrame, identity: str, p: Profile, seed: int = SEED) -> DataFrame:
    """All benign rows and as many attacks, or nothing while benign rows are too few."""
    benign = df.filter(F.col("label") == 0)
    attacks = df.filter(F.col("label") == 1)
    n_benign = benign.agg(F.count(F.lit(1))).scalar()
    kept = smallest_n(attacks, order_key(F.col(identity), seed), F.col(identity), n_benign)
    return benign.unionByName(kept).filter(n_benign >= p.min_benign)


def shuffled(df: DataFrame, identity: str, seed: int = SEED) -> DataFrame:
    """Rows in hash order."""
    return df.orderBy(order_key(F.col(identity), seed), identity)


def in_test_split(identity: Column, percent: int = 20, seed: int = SEED) -> Column:
    """Hash split: the same rows are held out whatever the partitioning."""
    number = F.conv(F.substring(order_key(identity, seed), 1, 8), 16, 10).cast("bigint")
    return number % 100 < percent


def scaling_stats(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """One row: mean and population deviation per column."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )


def scaled(df: DataFrame, stats: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Standardised columns; a constant column is only centred."""

    row = row_of(stats)

    def one(c: str) -> Column:
        std = row[f"std_{c}"]
        return (F.col(c) - row[f"mean_{c}"]) / F.when(std == 0, 1.0).otherwise(std)

    return df.withColumns({c: one(c) for c in columns})
