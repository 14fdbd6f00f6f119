"""Similarity of the sources that hit one port in consecutive capture windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions.network import TCP, ipv4_to_long
from tidewatch.operators.flows import capture_window

# fixed values: modulus and seed of the hash family, marker of an idle signature
PRIME = 4294967311
SEED = 42
IDLE = -1

SPINE_CHUNK = 4096
FLOOD_SALTS = 32  # keys that the sources of one window and port are split over


def coefficients(k: int) -> list[tuple[int, int]]:
    """The k (a, b) pairs, drawn in order from one seeded generator."""
    draw = np.random.RandomState(SEED)
    a = draw.randint(1, PRIME, size=k, dtype=np.int64)
    b = draw.randint(0, PRIME, size=k, dtype=np.int64)
    return [(int(x), int(y)) for x, y in zip(a, b)]


def address_hash(ip: Column, a: Column, b: Column) -> Column:
    """(a * ip + b) mod PRIME without overflow: the address is taken in 16-bit halves."""
    high = (F.shiftright(ip, 16) * a) % PRIME
    return (high * 65536 + ip.bitwiseAND(65535) * a + b) % PRIME


def port_sources(packets: DataFrame, p: Profile) -> DataFrame:
    """Distinct TCP sources per capture window and target port."""
    return (
        packets.filter((F.col("proto") == TCP) & (F.col("dst_port") == p.target_port))
        .groupBy(
            capture_window(p.capture_seconds),
            F.col("dst_port").alias("target_port"),
            F.col("src_ip").alias("source_ip"),
        )
        .agg(F.count(F.lit(1)).alias("packets"))
        .select(F.col("window.start").alias("window_start"), "target_port", "source_ip")
    )


def signatures(sources: DataFrame, p: Profile) -> DataFrame:
    """MinHash signature and number of sources per window and port.

    One row of k running minima per window and port and task, on the map side as well, so a
    flooded port costs k comparisons a source and k numbers a task.
    """
    ip = F.col("ip")
    minima = [
        F.min(address_hash(ip, F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))).alias(f"h{i}")
        for i, (a, b) in enumerate(coefficients(p.minhash_size))
    ]
    hashes = [F.coalesce(f"h{i}", F.lit(IDLE).cast("bigint")) for i in range(p.minhash_size)]
    return (
        sources.withColumn("ip", ipv4_to_long(F.col("source_ip")))
        .groupBy("window_start", "target_port")
        .agg(F.count(F.lit(1)).alias("n_sources"), *minima)
        .select("window_start", "target_port", "n_sources", F.array(*hashes).alias("signature"))
    )


def is_idle(signature: Column) -> Column:
    return F.forall(signature, lambda h: h == IDLE)


def matching_positions(current: Column, previous: Column) -> Column:
    return F.size(
        F.filter(F.zip_with(current, previous, lambda x, y: x == y), lambda same: same)
    ).cast("bigint")


def jaccard_verdict(current: Column, previous: Column, threshold: float = 0.70) -> Column:
    """Estimated similarity of two signatures, idle when either holds no source."""
    idle = previous.isNull() | is_idle(current) | is_idle(previous)
    matches = F.when(idle, 0).otherwise(matching_positions(current, previous))
    score = matches / F.size(current).cast("double")
    return F.struct(
        (~idle & (score >= threshold)).alias("is_botnet"),
        score.alias("jaccard_score"),
        matches.alias("matches"),
        F.when(idle, "idle")
        .when(score >= threshold, "potentially malicious")
        .otherwise("benign")
        .alias("status"),
    )


def signature_similarity(sigs: DataFrame, first_window: Column, p: Profile) -> DataFrame:
    """Compares each signature with the one of the window just before.

    A window without sources has an idle signature, so only the adjacent window can
    score. Each signature is therefore sent to its own window and to the next one, where
    the two meet; one busy port spreads over all its windows. Nothing is reported for
    the first capture window.
    """
    step = F.make_dt_interval(secs=F.lit(p.capture_seconds))
    start = F.col("window_start")
    sent = sigs.select(
        "target_port",
        F.inline(
            F.array(
                F.struct(start.alias("window_start"), F.col("n_sources").alias("n_sources"),
                         F.col("signature").alias("signature"),
                         F.lit(None).cast("array<bigint>").alias("previous_signature")),
                F.struct((start + step).alias("window_start"), F.lit(None).cast("bigint").alias("n_sources"),
                         F.lit(None).cast("array<bigint>").alias("signature"),
                         F.col("signature").alias("previous_signature")),
            )
        ),
    )
    met = (
        sent.groupBy("target_port", "window_start")
        .agg(
            F.max("n_sources").alias("n_sources"),
            F.max("signature").alias("signature"),
            F.max("previous_signature").alias("previous_signature"),
        )
        .filter(F.col("n_sources").isNotNull())
    )
    verdict = jaccard_verdict(F.col("signature"), F.col("previous_signature"), p.jaccard_threshold)
    few = F.col("n_sources") < p.min_sources
    return (
        met.filter(F.col("window_start") > first_window)
        .withColumn("v", verdict)
        .select(
            "window_start",
            "target_port",
            "n_sources",
            F.when(few, 0.0).otherwise(F.col("v.jaccard_score")).alias("jaccard_score"),
            F.when(few, 0).otherwise(F.col("v.matches")).alias("matches"),
            (~few & F.col("v.is_botnet")).alias("is_botnet"),
            F.when(few, "too few sources").otherwise(F.col("v.status")).alias("status"),
        )
    )


def first_capture_window(packets: DataFrame, p: Profile) -> Column:
    """Start of the earliest capture window, as a scalar."""
    return (
        packets.agg(F.min("ts").alias("ts"))
        .select(F.window("ts", f"{p.capture_seconds} seconds")["start"])
        .scalar()
    )


def sources_of(summary: DataFrame, p: Profile) -> DataFrame:
    """`port_sources` from a `packet_summary`."""
    return (
        summary.filter((F.col("proto") == TCP) & (F.col("dst_port") == p.target_port))
        .select("window_start", F.col("dst_port").alias("target_port"), F.col("src_ip").alias("source_ip"))
        .distinct()
    )


def similarity_per_source(summary: DataFrame, p: Profile) -> DataFrame:
    """The score of a window and port, once for every source that hit it; `summary` is a
    `packet_summary`."""
    sources = sources_of(summary, p)
    first = summary.agg(F.min("window_start")).scalar()
    scores = signature_similarity(signatures(sources, p), first, p)
    # all sources of a flood meet one score: they are split by address, the score is repeated
    sources = sources.withColumn("_salt", F.pmod(F.hash("source_ip"), F.lit(FLOOD_SALTS)))
    scores = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FLOOD_SALTS - 1))))
    return sources.join(scores, ["window_start", "target_port", "_salt"]).select(
        "window_start", "target_port", "source_ip", "jaccard_score"
    )


def similarity_log(packets: DataFrame, p: Profile) -> DataFrame:
    """One log line per window after the first, idle windows included with score 0."""
    scores = signature_similarity(
        signatures(port_sources(packets, p), p), first_capture_window(packets, p), p
    )
    step_us = p.capture_seconds * 1_000_000
    first_us = F.unix_micros(F.window("low", f"{p.capture_seconds} seconds")["start"])
    # numbers of the windows, in chunks so that no single row holds them all
    spine = (
        packets.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
        .select(first_us.alias("first_us"), F.unix_micros("high").alias("last_us"))
        .withColumn("count", F.floor((F.col("last_us") - F.col("first_us")) / step_us))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("count") / SPINE_CHUNK))))
        .withColumn(
            "n",
            F.explode(
                F.sequence(
                    F.col("chunk") * SPINE_CHUNK,
                    F.least(F.col("count"), (F.col("chunk") + 1) * SPINE_CHUNK - 1),
                )
            ),
        )
        .filter(F.col("n") > 0)
        .select(
            F.timestamp_micros(F.col("first_us") + F.col("n") * step_us).alias("window_start"),
            F.lit(p.target_port).alias("target_port"),
        )
    )
    return spine.join(scores, ["window_start", "target_port"], "left").select(
        "window_start", "target_port", F.coalesce("jaccard_score", F.lit(0.0)).alias("jaccard_score")
    )
