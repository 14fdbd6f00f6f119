"""Guardrails, sequential posterior, verdicts and alerts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions import rules
from tidewatch.functions.network import epoch_seconds
from tidewatch.operators.ordering import fold_stream
from tidewatch.sources.schemas import FEATURE_COLUMNS

LOOPBACK = "127.0.0.1"
STATE = "source_ip string, posterior double, seen double"


def without_hosts(df: DataFrame, hosts: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Leaves out the monitoring hosts and the loopback address.

    `hosts` are a few addresses or a table of any size with a `source_ip`.
    """
    if isinstance(hosts, DataFrame):
        others = df.filter(F.col("source_ip") != LOOPBACK)
        return others.join(hosts.select("source_ip"), "source_ip", "left_anti").select(*df.columns)
    return df.filter(~F.col("source_ip").isin(LOOPBACK, *hosts))


class Posterior:
    """The running posterior of one source: state is (posterior, time of the last update)."""

    def __init__(self, p: Profile):
        self.base, self.decay, self.step_seconds, self.gap = p.base_prior, p.decay, p.step_seconds, p.gap_seconds

    def start(self, at: float, probability: float, skip: bool, posterior: float | None, seen: float | None):
        return (self.base if posterior is None else posterior), seen

    def step(self, state, at: float, probability: float, skip: bool, *_):
        """Rows that are skipped or have no probability leave the state alone and give null."""
        if skip or probability is None:
            return state, None
        prior, seen = state
        if seen is not None and at - seen > self.gap:
            prior = max(prior * self.decay ** math.floor((at - seen) / self.step_seconds), self.base)
        a = min(max(probability, 1e-5), 1.0 - 1e-5)
        attack, normal = a * prior, (1.0 - a) * (1.0 - prior)
        posterior = attack / (attack + normal)
        return (posterior, at), posterior


def sequential_posterior(rows: DataFrame, p: Profile, state: DataFrame | None = None) -> DataFrame:
    """Adds the running posterior of each source; skipped rows get null.

    `rows` has one row per source and evaluation window, with `probability` and a
    boolean `skip`. The fold depends on order, so a source's rows pass one task one by
    one, but as a stream: it holds one state, whatever the length of the history.
    Histories are continued period by period with `state` (source_ip, posterior, seen).
    """
    columns = rows.columns
    timed = rows.withColumn("_at", epoch_seconds(F.col("time")).cast("double"))
    if state is None:
        timed = timed.withColumns({c: F.lit(None).cast("double") for c in ("_posterior", "_seen")})
    else:
        before = state.select("source_ip", F.col("posterior").alias("_posterior"), F.col("seen").alias("_seen"))
        timed = timed.join(before, "source_ip", "left")
    update = Posterior(p)
    inputs = ["_at", "probability", "skip", "_posterior", "_seen"]
    order = ["_at", *[c for c in columns if c != "source_ip"]]
    return fold_stream(timed, "source_ip", order, inputs, update.start, update.step, "posterior").select(
        *columns, "posterior"
    )


def verdicts(
    scored: DataFrame,
    p: Profile,
    hosts: Sequence[str] | DataFrame = (),
    state: DataFrame | None = None,
) -> DataFrame:
    """Event rows out of classifier probabilities.

    Order of the rules: host out, quiet rows pass with probability 0 and leave the
    posterior alone, guardrails lift the probability, the posterior decides.
    """
    lifted = F.when(
        rules.guardrail(p), F.greatest(F.col("probability"), F.lit(p.boost))
    ).otherwise(F.col("probability"))
    rows = without_hosts(scored, hosts).select(
        "time", "source_ip", *FEATURE_COLUMNS, lifted.alias("probability"), rules.quiet(p).alias("skip")
    )
    posterior = F.coalesce("posterior", F.lit(0.0))
    return sequential_posterior(rows, p, state).select(
        "time",
        "source_ip",
        F.lit("aggregated").alias("analyzer"),
        F.lit(False).alias("is_host_ip"),
        *FEATURE_COLUMNS,
        posterior.alias("probability"),
        F.when(posterior >= p.attack_posterior, 1).otherwise(0).alias("prediction"),
        F.col("skip").alias("quiet"),
    )


def posterior_state(events: DataFrame) -> DataFrame:
    """Last posterior and time of each source, to carry into the next batch."""
    return (
        events.filter(~F.col("quiet"))
        .groupBy("source_ip")
        .agg(
            F.max_by("probability", "time").alias("posterior"),
            epoch_seconds(F.max("time")).alias("seen"),
        )
    )


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest state per source."""
    return (
        old.select("source_ip", "posterior", "seen")
        .unionByName(new.select("source_ip", "posterior", "seen"))
        .groupBy("source_ip")
        .agg(F.max_by("posterior", "seen").alias("posterior"), F.max("seen").alias("seen"))
    )


def alerts(events: DataFrame, p: Profile) -> DataFrame:
    """Alert lines of the events that are certain enough."""
    line = F.format_string(
        "[%s] ALERT: Malicious Traffic from %s (Prob: %.2f%%)",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss"),
        F.col("source_ip"),
        F.col("probability") * 100,
    )
    return events.filter(
        (F.col("prediction") == 1) & (F.col("probability") >= p.alert_posterior)
    ).select("time", "source_ip", "probability", line.alias("line"))
