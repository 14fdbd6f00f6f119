"""Durations and thresholds of the detection steps."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE = 60
HOUR = 3600
DAY = 86400


@dataclass(frozen=True)
class Profile:
    """One set of parameters; the defaults are the live settings."""

    # windows and state
    capture_seconds: int = 2
    evaluation_seconds: int = 10
    flow_ttl_seconds: int = 60
    state_ttl_seconds: int = 7 * DAY  # of event time; streams forget sources and ports silent for longer
    target_port: int = 80
    minhash_size: int = 128
    trailing_rows: int = 5
    offline_rows: int = 20
    renyi_alpha: int = 10

    # sequential posterior
    base_prior: float = 0.01
    decay: float = 0.95
    gap_seconds: int = 15
    step_seconds: int = 10

    # stealth labels
    port_scan_ports: int = 50
    syn_flood_ratio: float = 10.0
    slow_mean: float = 3.0
    slow_std: float = 0.5
    slow_floor: float = 0.0001

    # guardrails, quiet rule and verdict
    guard_ratio: float = 10.0
    guard_velocity: float = 3.0
    guard_acceleration: float = 3.0
    guard_entropy: float = 3.0
    jaccard_threshold: float = 0.70
    min_sources: int = 3
    quiet_ratio: float = 1.2
    quiet_entropy: float = 2.5
    boost: float = 0.95
    attack_posterior: float = 0.85
    alert_posterior: float = 0.90
    dga_entropy: float = 2.5

    # learning loop
    safe_probability: float = 0.15
    confident_probability: float = 0.85
    lookback_days: int = 7
    retention_days: int = 30
    min_benign: int = 1000


LIVE = Profile()

# The test tables hold one packet every few minutes, so the same steps run with
# wider windows and lower thresholds.
SPARSE = Profile(
    capture_seconds=6 * HOUR,
    evaluation_seconds=DAY,
    flow_ttl_seconds=3 * DAY,
    state_ttl_seconds=400 * DAY,
    gap_seconds=2 * DAY,
    step_seconds=DAY,
    port_scan_ports=2,
    slow_mean=1.5 * DAY,
    slow_std=0.75 * DAY,
    jaccard_threshold=0.15,
    guard_velocity=1.0,
    guard_acceleration=1.6,
    lookback_days=14,
    min_benign=50,
)
