"""Packets to per-source flow rows, one row per source and capture window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions.network import (
    ACK,
    SYN,
    TCP,
    guarded_ratio,
    has_flag,
    is_valid_ip,
)
from tidewatch.session import staged
from tidewatch.sources.tables import only_transport

FLOW_KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]
MICROS = 1_000_000


def capture_window(seconds: int, ts: str = "ts") -> Column:
    """Tumbling event-time window."""
    return F.window(ts, f"{seconds} seconds").alias("window")


def _volumes(p: Profile) -> list[Column]:
    seconds = F.lit(float(p.capture_seconds))
    return [
        (F.col("bytes") / seconds).alias("t_vol"),
        (F.col("packets") / seconds).alias("n_req"),
        guarded_ratio(F.col("bytes"), F.col("packets")).alias("s_len"),
    ]


def window_totals(packets: DataFrame, p: Profile) -> DataFrame:
    """Bytes per second, packets per second and mean length of each capture window.

    TCP and UDP packets count.
    """
    return (
        only_transport(packets).groupBy(capture_window(p.capture_seconds))
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("packets"))
        .select(F.col("window.start").alias("window_start"), *_volumes(p))
    )


def packet_summary(packets: DataFrame, p: Profile) -> DataFrame:
    """One row per flow, protocol and capture window, as a stage table.

    It holds all that the analyzers ask of packets, so they are read and shuffled once.
    """
    flags = F.col("tcp_flags")
    return staged(
        packets.groupBy(capture_window(p.capture_seconds), *FLOW_KEY, "proto")
        .agg(
            F.sum("length").alias("bytes"),
            F.min(F.unix_micros("ts")).alias("first_us"),
            F.max(F.unix_micros("ts")).alias("last_us"),
            F.count(F.lit(1)).alias("packets"),
            F.count_if(has_flag(flags, SYN)).alias("syn_count"),
            F.count_if(has_flag(flags, ACK)).alias("ack_count"),
        )
        .select(F.col("window.start").alias("window_start"), *FLOW_KEY, "proto",
                "bytes", "first_us", "last_us", "packets", "syn_count", "ack_count"),
        "packet-summary",
    )


def totals_of(summary: DataFrame, p: Profile) -> DataFrame:
    """`window_totals` from the summary."""
    sums = only_transport(summary).groupBy("window_start").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return sums.select("window_start", *_volumes(p))


def tcp_flows_of(summary: DataFrame) -> DataFrame:
    """`flow_summaries` from the summary."""
    return tcp_packets(summary).drop("proto", "bytes")


def tcp_packets(packets: DataFrame) -> DataFrame:
    """TCP packets whose transport header could be read."""
    return packets.filter((F.col("proto") == TCP) & F.col("dst_port").isNotNull())


def flow_summaries(packets: DataFrame, p: Profile) -> DataFrame:
    """One row per TCP flow and capture window.

    The gaps between consecutive packets of a window add up to last - first, so the
    packets themselves need no ordering and a flow that sends most of the traffic
    shrinks to one row per map task before the shuffle.
    """
    flags = F.col("tcp_flags")
    return (
        tcp_packets(packets)
        .groupBy(capture_window(p.capture_seconds), *FLOW_KEY)
        .agg(
            F.min(F.unix_micros("ts")).alias("first_us"),
            F.max(F.unix_micros("ts")).alias("last_us"),
            F.count(F.lit(1)).alias("packets"),
            F.count_if(has_flag(flags, SYN)).alias("syn_count"),
            F.count_if(has_flag(flags, ACK)).alias("ack_count"),
        )
        .select(F.col("window.start").alias("window_start"), *FLOW_KEY,
                "first_us", "last_us", "packets", "syn_count", "ack_count")
    )


def with_previous_packet(summaries: DataFrame, p: Profile) -> DataFrame:
    """Adds the last packet time of the flow before this window, if still remembered.

    State older than the TTL is dropped when a window closes, so a packet is forgotten
    once it is more than the TTL older than the start of the current window. That bounds
    the look-back in time: each flow is cut into long slices, and only windows whose last
    packet can still matter are copied into the next slice.
    """
    ttl_us = p.flow_ttl_seconds * MICROS
    span = 16 * (p.flow_ttl_seconds + p.capture_seconds) * MICROS
    start_us = F.unix_micros("window_start")
    home = F.floor(start_us / span)
    reaches_next = F.col("last_us") >= (home + 1) * span - ttl_us
    spread = summaries.withColumn(
        "_slice", F.explode(F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    by_flow = Window.partitionBy(*FLOW_KEY, "_slice").orderBy("window_start")
    previous = F.lag("last_us").over(by_flow)
    return (
        spread.withColumn("_previous", previous)
        .filter(F.col("_slice") == home)
        .withColumn(
            "previous_us", F.when(start_us - F.col("_previous") <= ttl_us, F.col("_previous"))
        )
        .drop("_slice", "_previous")
    )


def flow_gaps(summaries: DataFrame, p: Profile) -> DataFrame:
    """Adds the sum (microseconds) and number of inter-arrival gaps per flow and window."""
    crossing = F.col("first_us") - F.col("previous_us")
    return with_previous_packet(summaries, p).select(
        "*",
        (F.col("last_us") - F.col("first_us") + F.coalesce(crossing, F.lit(0))).alias("gap_us"),
        (F.col("packets") - 1 + F.when(F.col("previous_us").isNotNull(), 1).otherwise(0)).alias(
            "gap_count"
        ),
    )


def source_counters(summaries: DataFrame, p: Profile) -> DataFrame:
    """Distinct ports, SYN and ACK counts and gap counters per source and window."""
    return (
        flow_gaps(summaries, p)
        .groupBy("window_start", F.col("src_ip").alias("source_ip"))
        .agg(
            F.count_distinct("dst_port").alias("unique_ports"),
            F.sum("syn_count").alias("syn_count"),
            F.sum("ack_count").alias("ack_count"),
            (F.sum("gap_us") / F.lit(float(MICROS))).alias("iat_sum"),
            F.sum("gap_count").alias("iat_count"),
        )
    )


def flow_rows(summary: DataFrame, p: Profile) -> DataFrame:
    """Flow rows: the window volumes next to the counters of each TCP source; `summary` is a
    `packet_summary`.

    Both sides are aggregates; no broadcast is forced, the optimizer broadcasts the
    totals only where their measured size allows it.
    """
    return source_counters(tcp_flows_of(summary), p).join(totals_of(summary, p), "window_start").select(
        "window_start",
        "source_ip",
        "t_vol",
        "n_req",
        "s_len",
        "unique_ports",
        "syn_count",
        "ack_count",
        "iat_sum",
        "iat_count",
    )


def flow_messages(flows: DataFrame) -> DataFrame:
    """Flow rows under their message names, rows with an invalid address left out."""
    return flows.filter(is_valid_ip(F.col("source_ip"))).select(
        "window_start",
        F.col("source_ip").cast("string").alias("Source_IP"),
        F.col("t_vol").cast("double").alias("T_vol"),
        F.col("n_req").cast("double").alias("N_req"),
        F.col("s_len").cast("double").alias("S_len"),
        F.col("unique_ports").cast("bigint").alias("U_ports"),
        F.col("syn_count").cast("bigint").alias("syn_count"),
        F.col("ack_count").cast("bigint").alias("ack_count"),
        F.col("iat_sum").cast("double").alias("iat_sum"),
        F.col("iat_count").cast("bigint").alias("iat_count"),
    )


def packet_gaps(packets: DataFrame, p: Profile) -> DataFrame:
    """Every remembered inter-arrival gap of every TCP flow.

    Packets are ordered inside one (flow, window); the packet before the window comes
    from the window summaries.
    """
    tcp = tcp_packets(packets).withColumns(
        {
            "_us": F.unix_micros("ts"),
            "window_start": F.window("ts", f"{p.capture_seconds} seconds")["start"],
        }
    )
    inside = Window.partitionBy(*FLOW_KEY, "window_start").orderBy("_us", "packet_id")
    ordered = tcp.withColumn("_lag", F.lag("_us").over(inside))
    # only flows that come back have a previous window, the others match nothing
    carried = (
        with_previous_packet(flow_summaries(packets, p), p)
        .filter(F.col("previous_us").isNotNull())
        .select(*FLOW_KEY, "window_start", "previous_us")
    )
    return (
        ordered.join(carried, [*FLOW_KEY, "window_start"], "left")
        .withColumn("_before", F.coalesce("_lag", "previous_us"))
        .filter(F.col("_before").isNotNull())
        .select(
            "packet_id",
            "window_start",
            F.col("src_ip").alias("source_ip"),
            "src_port",
            "dst_ip",
            "dst_port",
            ((F.col("_us") - F.col("_before")) / F.lit(float(MICROS))).alias("iat"),
        )
    )


def gap_spread(packets: DataFrame, p: Profile) -> DataFrame:
    """Mean and population deviation of the gaps per source and window."""
    return (
        packet_gaps(packets, p)
        .groupBy("window_start", "source_ip")
        .agg(F.avg("iat").alias("iat_mean"), F.stddev_pop("iat").alias("iat_std"))
    )


def bidirectional_flows(packets: DataFrame, p: Profile) -> DataFrame:
    """Flow rates with both directions folded together.

    TCP and UDP packets count. Addresses and ports are ordered independently of each other.
    """
    return (
        only_transport(packets).groupBy(
            capture_window(p.capture_seconds),
            F.least("src_ip", "dst_ip").alias("ip_a"),
            F.greatest("src_ip", "dst_ip").alias("ip_b"),
            F.least("src_port", "dst_port").alias("port_a"),
            F.greatest("src_port", "dst_port").alias("port_b"),
            "proto",
        )
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("packets"))
        .select(
            F.col("window.start").alias("window_start"),
            "ip_a",
            "ip_b",
            "port_a",
            "port_b",
            "proto",
            (F.col("bytes") / F.lit(float(p.capture_seconds))).alias("flow_byts_s"),
            (F.col("packets") / F.lit(float(p.capture_seconds))).alias("flow_pkts_s"),
            guarded_ratio(F.col("bytes"), F.col("packets")).alias("pkt_len_mean"),
        )
    )
