"""Explicit schemas of messages, tables and files."""

from __future__ import annotations

FLOW_MESSAGE = (
    "Source_IP string, T_vol double, N_req double, S_len double, U_ports bigint, "
    "syn_count bigint, ack_count bigint, iat_sum double, iat_count bigint"
)

SIGNATURE_MESSAGE = (
    "timestamp double, target_port int, k_size int, signature array<double>, "
    "source_ips array<string>, n_sources bigint"
)

DNS_MESSAGE = "array<struct<timestamp: double, source_ip: string, domain: string>>"

FEATURE_MESSAGE = (
    "source_ip string, analyzer string, metrics struct<velocity: double, acceleration: double, "
    "syn_count: bigint, ack_count: bigint, iat_sum: double, iat_count: bigint, "
    "jaccard_score: double, entropy_shannon: double>"
)

EVENTS = (
    "time timestamp, source_ip string, analyzer string, is_host_ip boolean, "
    "velocity double, acceleration double, iat_mean double, sa_ratio double, "
    "jaccard_score double, entropy_shannon double, probability double, prediction int, "
    "ingest_batch_id bigint"
)

# order matters: the classifier reads the features in this order
FEATURE_COLUMNS = [
    "velocity",
    "acceleration",
    "iat_mean",
    "sa_ratio",
    "jaccard_score",
    "entropy_shannon",
]
