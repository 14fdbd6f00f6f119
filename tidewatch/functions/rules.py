"""Signature rules, guardrails and display bands as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.functions.network import clip


def port_scan(ports: Column, p: Profile) -> Column:
    return ports > p.port_scan_ports


def syn_flood(ratio: Column, p: Profile) -> Column:
    return ratio > p.syn_flood_ratio


def slowloris(iat_mean: Column, iat_std: Column, p: Profile) -> Column:
    """Slow and regular gaps; no spread at all means no traffic."""
    return (iat_std > p.slow_floor) & (iat_mean > p.slow_mean) & (iat_std < p.slow_std)


def stealth_label(
    ports: Column, ratio: Column, iat_mean: Column, iat_std: Column, p: Profile
) -> Column:
    return (
        F.when(port_scan(ports, p), "Stealth Port Scan (Reconnaissance Phase)")
        .when(syn_flood(ratio, p), "Stealth SYN Flood (State Exhaustion)")
        .when(slowloris(iat_mean, iat_std, p), "Slowloris (Application-Layer DoS)")
        .otherwise("Normal")
    )


def guardrail(p: Profile) -> Column:
    return (
        (F.col("sa_ratio") > p.guard_ratio)
        | (F.col("velocity") > p.guard_velocity)
        | (F.col("acceleration") > p.guard_acceleration)
        | (F.col("jaccard_score") >= p.jaccard_threshold)
        | (F.col("entropy_shannon") >= p.guard_entropy)
    )


def quiet(p: Profile) -> Column:
    return (
        (F.col("velocity") == 0)
        & (F.col("acceleration") == 0)
        & (F.col("iat_mean") == 0)
        & (F.col("sa_ratio") <= p.quiet_ratio)
        & (F.col("jaccard_score") == 0)
        & (F.col("entropy_shannon") < p.quiet_entropy)
    )


def adjust_prior(probability: Column, prior: float = 0.01) -> Column:
    """Moves a probability learnt on balanced classes to the real attack prior."""
    q = clip(probability, 1e-6, 1.0 - 1e-6)
    attack = q * F.lit(prior)
    return attack / (attack + (F.lit(1.0) - q) * F.lit(1.0 - prior))


# fixed values: dashboard thresholds
VELOCITY_LINE = 0.65
ACCELERATION_LINE = 0.80
BAND_LOW = 0.5
BAND_HIGH = 0.85
BAND_MARK = 0.95


def threat_band(probability: Column) -> Column:
    return (
        F.when(probability < BAND_LOW, "low").when(probability < BAND_HIGH, "elevated").otherwise("high")
    )
