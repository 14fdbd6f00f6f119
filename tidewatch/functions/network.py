"""Column builders for addresses, TCP flags, ratios and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP = 6
UDP = 17
SYN = 0x02
ACK = 0x10

# fixed value: ratio reported when a source sends SYN without any ACK
SYN_ONLY_RATIO = 999.0

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H16 = r"[0-9A-Fa-f]{1,4}"
_LS32 = rf"({_H16}:{_H16}|{_IPV4})"


def _ipv6_pattern() -> str:
    """RFC 4291 text forms: all groups, or one '::' for a run of zero groups."""
    forms = [rf"({_H16}:){{6}}{_LS32}"]
    for left in range(7):
        # `left` groups before '::', so at most 7 - left groups after it
        head = "" if left == 0 else rf"({_H16}:){{{left - 1}}}{_H16}"
        tails = []
        for right in range(7 - left + 1):
            if right == 0:
                tails.append("")
            elif right == 1:
                tails.append(_H16)
            else:
                tails.append(rf"({_H16}:){{{right - 2}}}{_LS32}")
        forms.append(head + "::(" + "|".join(tails) + ")")
    forms.append(rf"({_H16}:){{6}}{_H16}::")
    return "(" + "|".join(forms) + r")(%[^%]+)?"


IPV4_REGEX = rf"^{_IPV4}$"
IPV6_REGEX = rf"^{_ipv6_pattern()}$"


def is_valid_ip(ip: Column) -> Column:
    return ip.rlike(IPV4_REGEX) | ip.rlike(IPV6_REGEX)


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to its unsigned 32-bit number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = reduce(
        lambda acc, i: acc * 256 + parts[i].cast("bigint"), range(1, 4), parts[0].cast("bigint")
    )
    return F.when(ip.rlike(IPV4_REGEX), number)


def long_to_ipv4(number: Column) -> Column:
    octets = [
        F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)
    ]
    return F.concat_ws(".", *octets)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def syn_ack_ratio(syn: Column, ack: Column) -> Column:
    return (
        F.when(ack > 0, syn.cast("double") / ack)
        .when(syn > 0, F.lit(SYN_ONLY_RATIO))
        .otherwise(0.0)
    )


def mean_gap(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count).otherwise(0.0)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(0.0)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def seconds_of_day(ts: Column) -> Column:
    """Microsecond-exact time of day, in seconds."""
    return F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / F.lit(1_000_000.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
