"""Link-layer frames to packet headers, as native binary expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.folds import let
from tidewatch.functions.network import TCP, UDP, long_to_ipv4

# fixed values: link types, ether types and header sizes
ETHERNET = 1
LOOPBACK = (0, 108)
COOKED = 113
IPV4_TYPE = 0x0800
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)
ETHERNET_HEADER = 14
COOKED_HEADER = 16
LOOPBACK_HEADER = 4
VLAN_TAG = 4
DNS_HEADER = 12
MAX_NAME = 255
MAX_LABELS = 127


def number(data: Column, offset: Column, size: int) -> Column:
    """Unsigned big-endian number at a 0-based offset, null past the end."""
    part = F.substring(data, offset + 1, F.lit(size))
    value = F.conv(F.hex(part), 16, 10).cast("bigint")
    return F.when(F.octet_length(data) >= offset + size, value)


def _ethernet_ip_offset(frame: Column) -> Column:
    """Offset of the IPv4 header behind an Ethernet header with up to two VLAN tags."""
    at = [F.lit(ETHERNET_HEADER + VLAN_TAG * k) for k in range(3)]
    kinds = [number(frame, offset - 2, 2) for offset in at]
    tagged = [kind.isin(*VLAN_TYPES) for kind in kinds]
    return (
        F.when(kinds[0] == IPV4_TYPE, at[0])
        .when(tagged[0] & (kinds[1] == IPV4_TYPE), at[1])
        .when(tagged[0] & tagged[1] & (kinds[2] == IPV4_TYPE), at[2])
    )


def _ip_offset(frame: Column, linktype: Column) -> Column:
    first = number(frame, F.lit(0), 1)
    raw_ip = (F.shiftright(first, 4) == 4) & (first.bitwiseAND(15) >= 5)
    return (
        F.when(linktype == ETHERNET, _ethernet_ip_offset(frame))
        .when(linktype.isin(*LOOPBACK), F.lit(LOOPBACK_HEADER))
        .when(
            linktype == COOKED,
            F.when(number(frame, F.lit(COOKED_HEADER - 2), 2) == IPV4_TYPE, F.lit(COOKED_HEADER)),
        )
        .when(raw_ip & (F.octet_length(frame) >= 20), F.lit(0))
        .otherwise(_ethernet_ip_offset(frame))
    )


def question_name(data: Column, offset: Column) -> Column:
    """Name of length-prefixed labels; null when it is cut off or compressed."""

    def walk(name: Column) -> Column:
        start = F.struct(
            F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"), F.lit(0).alias("end")
        )

        def label(s: Column, _: Column) -> Column:
            def take(n: Column) -> Column:
                text = F.substring(name, (s["at"] + 2).cast("int"), n.cast("int")).cast("string")
                joined = F.when(s["text"] == "", text).otherwise(F.concat(s["text"], F.lit("."), text))
                whole = F.octet_length(name) >= s["at"] + 1 + n
                return (
                    F.when(n == 0, F.struct(s["at"], s["text"], F.lit(1).alias("end")))
                    .when(
                        n.isNull() | (n > 63) | ~whole,
                        F.struct(s["at"], s["text"], F.lit(-1).alias("end")),
                    )
                    .otherwise(
                        F.struct((s["at"] + 1 + n).alias("at"), joined.alias("text"), s["end"])
                    )
                )

            return F.when(s["end"] != 0, s).otherwise(let(number(name, s["at"], 1), take))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(MAX_LABELS)), start, label)
        return let(done, lambda d: F.when((d["end"] == 1) & (d["text"] != ""), d["text"]))

    return let(F.substring(data, offset + 1, F.lit(MAX_NAME)), walk)


def decode_frames(frames: DataFrame) -> DataFrame:
    """Packet headers of a (packet_id, ts, linktype, frame) table.

    Frames without a readable IPv4 header and packets other than TCP and UDP are dropped.
    A later fragment or a cut transport header keeps its size but has no ports.
    """
    frame = F.col("frame")
    ip = F.col("_ip")
    transport = F.col("_transport")
    size = F.octet_length(frame)
    located = frames.withColumn("_ip", _ip_offset(frame, F.col("linktype"))).filter(ip.isNotNull())
    parsed = located.select(
        "packet_id",
        "ts",
        "frame",
        (ip + number(frame, ip, 1).bitwiseAND(15) * 4).cast("int").alias("_transport"),
        (number(frame, ip, 1).bitwiseAND(15) >= 5).alias("_sane"),
        (number(frame, ip + 6, 2).bitwiseAND(0x1FFF) == 0).alias("_first_fragment"),
        number(frame, ip + 9, 1).cast("int").alias("proto"),
        long_to_ipv4(number(frame, ip + 12, 4)).alias("src_ip"),
        long_to_ipv4(number(frame, ip + 16, 4)).alias("dst_ip"),
    ).filter(F.col("_sane") & F.col("proto").isin(TCP, UDP) & (size >= transport))

    header = F.when(F.col("proto") == TCP, 20).otherwise(8)
    readable = F.col("_first_fragment") & (size >= transport + header)
    dns = transport + 8
    is_query = (
        (F.col("proto") == UDP)
        & (F.col("dst_port") == 53)
        & (number(frame, dns + 2, 1).bitwiseAND(0x80) == 0)
        & (number(frame, dns + 4, 2) > 0)
    )
    with_ports = parsed.withColumns(
        {
            "src_port": F.when(readable, number(frame, transport, 2)).cast("int"),
            "dst_port": F.when(readable, number(frame, transport + 2, 2)).cast("int"),
            "tcp_flags": F.when(
                F.col("proto") == TCP, F.when(readable, number(frame, transport + 13, 1))
            )
            .otherwise(0)
            .cast("int"),
        }
    )
    return with_ports.select(
        "packet_id",
        "ts",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "proto",
        "tcp_flags",
        size.alias("length"),
        F.when(is_query, question_name(frame, dns + DNS_HEADER)).alias("qname"),
    )
