"""Small ordered reports over events, alerts and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import rules


def latest_events(events: DataFrame, n: int = 5) -> DataFrame:
    return (
        events.select("time", "source_ip", "probability", "prediction")
        .orderBy(F.desc("time"), "source_ip")
        .limit(n)
    )


def attacks(events: DataFrame) -> DataFrame:
    """All attacks, newest first."""
    return (
        events.filter(F.col("prediction") == 1)
        .select("time", "source_ip", "probability")
        .orderBy(F.desc("time"), "source_ip")
    )


def latest_per_source(events: DataFrame) -> DataFrame:
    """Newest event of each source, by partial aggregation instead of ordering."""
    return (
        events.groupBy("source_ip")
        .agg(F.max_by(F.struct("time", "probability", "prediction"), "time").alias("last"))
        .select("source_ip", "last.time", "last.probability", "last.prediction")
    )


def event_counts(events: DataFrame, pending: DataFrame) -> DataFrame:
    """Number of events and of unprocessed events, as one row."""
    return events.agg(F.count(F.lit(1)).alias("events")).withColumn(
        "unprocessed", pending.agg(F.count(F.lit(1))).scalar()
    )


def last_alerts(alert_lines: DataFrame, n: int = 10) -> DataFrame:
    return alert_lines.orderBy(F.desc("time"), "source_ip").limit(n)


def latest_velocity(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Velocity of the newest log row, 0.0 for an empty log."""
    return log.agg(
        F.coalesce(F.max_by("velocity", F.struct(ts, "source_ip")), F.lit(0.0)).alias("velocity")
    )


def threshold_flags(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "fast": F.col("velocity") > rules.VELOCITY_LINE,
            "jerky": F.col("acceleration") > rules.ACCELERATION_LINE,
        }
    )


def threat_bands(events: DataFrame) -> DataFrame:
    """Events per display band."""
    return events.groupBy(rules.threat_band(F.col("probability")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("probability") >= rules.BAND_MARK).alias("above_mark"),
    )


def retained(events: DataFrame, as_of, days: int) -> DataFrame:
    """Events inside the retention period; prunes date partitions where there are any."""
    start = as_of - F.make_dt_interval(days=F.lit(days))
    kept = events.filter(F.col("time") >= start)
    return kept.filter(F.col("date") >= F.to_date(start)) if "date" in events.columns else kept
