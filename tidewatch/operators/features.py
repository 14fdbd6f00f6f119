"""One feature row per source and evaluation window, out of four analyzers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions.entropy import domain_entropy
from tidewatch.functions.network import mean_gap, syn_ack_ratio
from tidewatch.operators.flows import flow_rows, packet_summary
from tidewatch.operators.spatial import similarity_per_source
from tidewatch.operators.volumetric import EntropyModel, flow_kinematics

UNKNOWN = "Unknown"


def stealth_features(flows: DataFrame) -> DataFrame:
    return flows.select(
        F.col("window_start").alias("ts"),
        "source_ip",
        F.lit("stealth").alias("analyzer"),
        "syn_count",
        "ack_count",
        "iat_sum",
        "iat_count",
    )


def flow_features(flows: DataFrame, p: Profile, model: EntropyModel) -> DataFrame:
    """Both analyzers of the flow rows in one pass.

    As two branches, each would prune other columns and the packets would be read and
    aggregated once per branch.
    """
    moving = flow_kinematics(flows, p.trailing_rows, model, p.renyi_alpha)
    volumes = ["velocity", "acceleration"]
    counters = ["syn_count", "ack_count", "iat_sum", "iat_count"]
    kinds = dict(moving.dtypes)

    def row(analyzer: str, own: list[str]) -> Column:
        metrics = [
            (F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c)
            for c in (*volumes, *counters)
        ]
        return F.struct(F.lit(analyzer).alias("analyzer"), *metrics)

    return moving.select(
        F.col("window_start").alias("ts"),
        "source_ip",
        F.inline(F.array(row("volumetric", volumes), row("stealth", counters))),
    )


def spatial_features(similarity: DataFrame) -> DataFrame:
    return similarity.select(
        F.col("window_start").alias("ts"),
        "source_ip",
        F.lit("spatial").alias("analyzer"),
        "jaccard_score",
    )


def dns_features(queries: DataFrame) -> DataFrame:
    """Entropy of every queried name; blank names are left out."""
    return queries.filter(F.coalesce("domain", F.lit("")) != "").select(
        "ts",
        F.coalesce("source_ip", F.lit(UNKNOWN)).alias("source_ip"),
        F.lit("dns").alias("analyzer"),
        domain_entropy(F.col("domain")).alias("entropy_shannon"),
    )


def unify(*branches: DataFrame) -> DataFrame:
    """Stacks the analyzers into one wide table, absent metrics are null."""
    stacked = branches[0]
    for branch in branches[1:]:
        stacked = stacked.unionByName(branch, allowMissingColumns=True)
    return stacked


def roll_up(features: DataFrame, p: Profile, ts: str = "ts") -> DataFrame:
    """Features per source and evaluation window.

    The analyzers meet in one conditional aggregation, so four inputs need one shuffle
    and every side may be missing. Ratios are taken of the sums. A source seen only with
    an unknown analyzer still gets a row of zeros.
    """

    def of(analyzer: str, column: str) -> Column:
        return F.when(F.col("analyzer") == analyzer, F.coalesce(column, F.lit(0)))

    def highest(analyzer: str, column: str) -> Column:
        return F.coalesce(F.max(of(analyzer, column)), F.lit(0.0)).alias(column)

    def total(column: str) -> Column:
        return F.coalesce(F.sum(of("stealth", column)), F.lit(0)).alias(column)

    # whole microseconds, so that the sum does not depend on the order of the rows
    gap_us = F.round(of("stealth", "iat_sum") * 1e6).cast("bigint")
    gap_sum = F.coalesce(F.sum(gap_us), F.lit(0)) / F.lit(1e6)

    return (
        features.filter(F.col("source_ip") != UNKNOWN)
        .groupBy(F.window(ts, f"{p.evaluation_seconds} seconds").alias("window"), "source_ip")
        .agg(
            highest("volumetric", "velocity"),
            highest("volumetric", "acceleration"),
            highest("spatial", "jaccard_score"),
            highest("dns", "entropy_shannon"),
            total("syn_count"),
            total("ack_count"),
            gap_sum.alias("iat_sum"),
            total("iat_count"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("time"),
            "source_ip",
            "velocity",
            "acceleration",
            mean_gap(F.col("iat_sum"), F.col("iat_count")).alias("iat_mean"),
            syn_ack_ratio(F.col("syn_count"), F.col("ack_count")).alias("sa_ratio"),
            "jaccard_score",
            "entropy_shannon",
        )
    )


def window_features(
    packets: DataFrame, queries: DataFrame, p: Profile, model: EntropyModel
) -> DataFrame:
    """Packets and DNS queries to evaluation-window features; packets are read once."""
    summary = packet_summary(packets, p)
    return roll_up(
        unify(
            flow_features(flow_rows(summary, p), p, model),
            spatial_features(similarity_per_source(summary, p)),
            dns_features(queries),
        ),
        p,
    )


def evaluated_entities(features: DataFrame) -> DataFrame:
    """Number of distinct sources per evaluation window."""
    return features.groupBy("window_start").agg(
        F.count_distinct("source_ip").alias("entities")
    )
