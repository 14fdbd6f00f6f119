"""Message streams: subscription, dispatch by topic, JSON decoding with defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import prepare
from tidewatch.sources.schemas import DNS_MESSAGE, FEATURE_MESSAGE, FLOW_MESSAGE, SIGNATURE_MESSAGE

# fixed values: topic names
FLOW_TOPIC = "live-network-flows"
SIGNATURE_TOPIC = "spatial-minhash-signatures"
DNS_TOPIC = "dns-queries"
FEATURE_TOPIC = "unified-features-topic"

MESSAGES = "topic string, key string, value string, timestamp timestamp"
CORRUPT = "_corrupt"
UNKNOWN = "Unknown"


def kafka_options(servers: str, topics: Sequence[str]) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
    }


def subscribe(
    spark: SparkSession, fmt: str, options: Mapping[str, str], path: str | None = None
) -> DataFrame:
    """A stream of (topic, key, value, timestamp).

    `fmt` is "kafka" on a cluster with that connector, or a file format whose files hold
    the same columns.
    """
    prepare(spark)
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load().select(
            "topic",
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            "timestamp",
        )
    return reader.schema(MESSAGES).load(path)


def of_topic(messages: DataFrame, topic: str) -> DataFrame:
    return messages.filter(F.col("topic") == topic)


def _parsed(messages: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return messages.withColumn("m", F.from_json("value", f"{schema}, {CORRUPT} string", options))


def is_malformed() -> Column:
    return F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull()


def malformed(messages: DataFrame, schema: str) -> DataFrame:
    """Messages that do not parse, for a side output."""
    return _parsed(messages, schema).filter(is_malformed()).drop("m")


def decode_flows(messages: DataFrame) -> DataFrame:
    """Flow messages; a missing counter is 0 and a missing source is Unknown."""
    good = _parsed(messages, FLOW_MESSAGE).filter(~is_malformed())
    return good.select(
        F.col("timestamp").alias("window_start"),
        F.coalesce("m.Source_IP", F.lit(UNKNOWN)).alias("source_ip"),
        F.col("m.T_vol").alias("t_vol"),
        F.col("m.N_req").alias("n_req"),
        F.col("m.S_len").alias("s_len"),
        F.coalesce("m.U_ports", F.lit(0)).alias("unique_ports"),
        F.coalesce("m.syn_count", F.lit(0)).alias("syn_count"),
        F.coalesce("m.ack_count", F.lit(0)).alias("ack_count"),
        F.coalesce("m.iat_sum", F.lit(0.0)).alias("iat_sum"),
        F.coalesce("m.iat_count", F.lit(0)).alias("iat_count"),
    )


def decode_signatures(messages: DataFrame) -> DataFrame:
    """Signature messages; an empty signature or a missing or zero port is left out.

    Senders write the hashes as whole numbers or as floats, and the sources as a list or
    as their number.
    """
    good = _parsed(messages, SIGNATURE_MESSAGE).filter(~is_malformed())
    return good.filter(
        (F.coalesce("m.target_port", F.lit(0)) != 0) & (F.size(F.coalesce("m.signature", F.array())) > 0)
    ).select(
        F.timestamp_seconds("m.timestamp").alias("window_start"),
        F.col("m.target_port").alias("target_port"),
        F.col("m.signature").cast("array<bigint>").alias("signature"),
        F.coalesce("m.source_ips", F.array().cast("array<string>")).alias("source_ips"),
        F.coalesce("m.n_sources", F.size("m.source_ips").cast("bigint"), F.lit(0)).alias("n_sources"),
    )


def _dns_queries() -> Column:
    return F.from_json("value", DNS_MESSAGE, {"mode": "PERMISSIVE"})


def malformed_dns(messages: DataFrame) -> DataFrame:
    """DNS messages that do not parse, or hold an entry that does not, for a side output."""
    entries = F.coalesce(_dns_queries(), F.array(F.lit(None)).cast(DNS_MESSAGE))
    return messages.filter(F.exists(entries, lambda e: e.isNull()))


def decode_dns(messages: DataFrame) -> DataFrame:
    """One row per query of each DNS message; `malformed_dns` has the messages left out."""
    return messages.select(F.inline(F.filter(_dns_queries(), lambda e: e.isNotNull()))).select(
        F.timestamp_seconds("timestamp").alias("ts"),
        F.coalesce("source_ip", F.lit(UNKNOWN)).alias("source_ip"),
        F.coalesce("domain", F.lit("")).alias("domain"),
    )


def decode_features(messages: DataFrame) -> DataFrame:
    """Feature messages as one wide row with nullable metrics."""
    good = _parsed(messages, FEATURE_MESSAGE).filter(~is_malformed())
    return good.select(
        F.col("timestamp").alias("ts"),
        F.coalesce("m.source_ip", F.lit(UNKNOWN)).alias("source_ip"),
        F.coalesce("m.analyzer", F.lit("unknown")).alias("analyzer"),
        "m.metrics.*",
    )
