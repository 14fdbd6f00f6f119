"""Packets to stored events, as batch runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions import rules
from tidewatch.operators import features, scoring
from tidewatch.operators.volumetric import EntropyModel
from tidewatch.session import stage_path
from tidewatch.sinks.events import read_events, write_events
from tidewatch.sources.tables import dns_queries, only_transport

Score = Callable[[DataFrame], DataFrame]


def detect(
    packets: DataFrame,
    p: Profile,
    model: EntropyModel,
    score: Score,
    hosts: Sequence[str] | DataFrame = (),
    state: DataFrame | None = None,
) -> DataFrame:
    """Event rows of one batch of packets; `score` adds the classifier probability."""
    packets = only_transport(packets)
    windows = features.window_features(packets, dns_queries(packets), p, model)
    return scoring.verdicts(score(windows), p, hosts, state)


def score_by_day(
    scored: DataFrame, events_path: str, p: Profile, hosts: Sequence[str] | DataFrame = ()
) -> DataFrame:
    """Scores a long history one day after the other and stores its events.

    The posterior depends on order, so days follow each other, and within a day a source
    has at most one row per evaluation window. The state between days is a table of one
    row per source in the shared folder: a failed run repeats one day, not all of them.
    Returns the state after the last day.
    """
    spark = scored.sparkSession
    day = F.to_date("time")
    days = [r["day"] for r in scored.select(day.alias("day")).distinct().orderBy("day").collect()]
    state = spark.createDataFrame([], scoring.STATE)
    for current in days:
        rows = scored.filter(day == F.lit(current))
        batch_id = current.toordinal()
        write_events(scoring.verdicts(rows, p, hosts, state), events_path, batch_id)
        stored = read_events(spark, events_path).filter(
            (F.col("date") == F.lit(current)) & (F.col("ingest_batch_id") == batch_id)
        )
        fresh = scoring.posterior_state(stored.withColumn("quiet", rules.quiet(p)))
        path = stage_path(spark, "posterior-state")
        scoring.merge_state(state, fresh).write.parquet(path)
        state = spark.read.schema(scoring.STATE).parquet(path)
    return state
