"""Keyed JSON messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.network import epoch_seconds
from tidewatch.operators.flows import flow_messages
from tidewatch.sources.messages import DNS_TOPIC, FEATURE_TOPIC, FLOW_TOPIC, SIGNATURE_TOPIC

_METRICS = {
    "volumetric": ["velocity", "acceleration"],
    "stealth": ["syn_count", "ack_count", "iat_sum", "iat_count"],
    "spatial": ["jaccard_score"],
    "dns": ["entropy_shannon"],
}


def _message(topic: str, key: Column, value: Column, ts: Column) -> list[Column]:
    return [
        F.lit(topic).alias("topic"),
        key.cast("string").alias("key"),
        value.alias("value"),
        ts.alias("timestamp"),
    ]


def encode_flows(flows: DataFrame) -> DataFrame:
    """Flow rows as JSON, keyed by source; rows with an invalid address are left out."""
    rows = flow_messages(flows)
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "window_start"]))
    return rows.select(*_message(FLOW_TOPIC, F.col("Source_IP"), body, F.col("window_start")))


def encode_signatures(signatures: DataFrame) -> DataFrame:
    """Signatures as JSON, keyed by port.

    The sources of a window stay in their own table: they have no size bound, and the
    reader of the scores joins them by window and port.
    """
    body = F.to_json(
        F.struct(
            epoch_seconds(F.col("window_start")).alias("timestamp"),
            "target_port",
            F.size("signature").alias("k_size"),
            "signature",
            "n_sources",
        )
    )
    return signatures.select(
        *_message(SIGNATURE_TOPIC, F.col("target_port"), body, F.col("window_start"))
    )


def encode_dns(queries: DataFrame) -> DataFrame:
    """DNS queries as one JSON array per query.

    Readers unpack the array, so how many queries share a message makes no difference
    to them; one per message needs no grouping.
    """
    entry = F.struct(epoch_seconds(F.col("ts")).alias("timestamp"), "source_ip", "domain")
    return queries.select(
        *_message(DNS_TOPIC, F.lit(None), F.to_json(F.array(entry)), F.col("ts"))
    )


def encode_features(features: DataFrame, analyzer: str) -> DataFrame:
    """Feature rows of one analyzer as JSON, keyed by source."""
    body = F.to_json(
        F.struct(
            "source_ip",
            F.lit(analyzer).alias("analyzer"),
            F.struct(*_METRICS[analyzer]).alias("metrics"),
        )
    )
    return features.select(*_message(FEATURE_TOPIC, F.col("source_ip"), body, F.col("ts")))


def publish_batch(messages: DataFrame, fmt: str, options: Mapping[str, str], path: str | None = None) -> None:
    """Writes messages to the broker, or appends them to a message table."""
    writer = messages.write.format(fmt).options(**options)
    writer.save() if fmt == "kafka" else writer.mode("append").save(path)


def publish_stream(
    messages: DataFrame, fmt: str, options: Mapping[str, str], checkpoint: str, path: str | None = None
) -> StreamingQuery:
    """Streams messages out; the checkpoint makes a restart continue where it stopped."""
    writer = (
        messages.writeStream.format(fmt)
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return writer.start() if fmt == "kafka" else writer.start(path)
