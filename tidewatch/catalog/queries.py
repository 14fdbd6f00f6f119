"""One function per query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.inputs import LINE_ORDER, line_series, numbered_lines
from tidewatch.catalog.parameters import (
    AS_OF,
    DYNAMIC_SIZE,
    FLOW_MODEL,
    HOST,
    LEDGER_UNTIL,
    LINE_MEAN,
    LINE_MODEL,
    LINE_SIGMA,
    RETENTION_DAYS,
    SPIKE_THRESHOLD,
    TRUSTED,
    logistic_score,
)
from tidewatch.config import SPARSE
from tidewatch.functions import entropy, network, rules
from tidewatch.operators import (
    evaluate,
    features,
    flows,
    learning,
    models,
    reports,
    scoring,
    spatial,
    spikes,
    volumetric,
)
from tidewatch.operators.ordering import number_rows
from tidewatch.operators.scalars import row_of
from tidewatch.plans import evaluation, learning_loop, offline
from tidewatch.session import stage_path
from tidewatch.sinks import events as event_sink
from tidewatch.sinks import messages as message_sink
from tidewatch.sources import files, frames, messages
from tidewatch.sources.schemas import FEATURE_COLUMNS
from tidewatch.sources.tables import (
    dns_queries,
    events_as_packets,
    only_transport,
    read_table,
    with_qname,
)
from tidewatch.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
# means and deviations of large values, where the order of summation shows in later digits
PLACES = {"series_stats": 4, "training_stats": 4, "stealth_labels": 3}


# exact microsecond sums: enough places that no value sits half way between two
COLUMN_PLACES = {"iat_mean": 9}


def present(df: DataFrame, places: int | None = None) -> DataFrame:
    """Comparable values: times as text, doubles rounded and without a negative zero."""
    shown = {}
    for name, kind in df.dtypes:
        if kind == "timestamp":
            shown[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            shown[name] = F.round(name, places or COLUMN_PLACES.get(name, 6)) + F.lit(0.0)
    return df.withColumns(shown) if shown else df


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(build(spark, folder), PLACES.get(build.__name__))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    REGISTRY[build.__name__] = run
    return build


# ---- shared inputs ------------------------------------------------------------------

_stages: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, folder: str, name: str, build: Query) -> DataFrame:
    """A stage table, written once per application into the shared folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stages:
        path = stage_path(spark, name)
        build(spark, folder).write.parquet(path)
        _stages[key] = path
    return spark.read.parquet(_stages[key])


def packets(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_packets(spark, folder)


def queried_names(spark: SparkSession, folder: str) -> DataFrame:
    return dns_queries(with_qname(spark, folder, packets(spark, folder)))


def flow_table(spark: SparkSession, folder: str) -> DataFrame:
    return flows.flow_rows(flows.packet_summary(packets(spark, folder), SPARSE), SPARSE)


def scored_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation-window features with a probability, as a stage table."""

    def build(s: SparkSession, d: str) -> DataFrame:
        windows = features.window_features(packets(s, d), queried_names(s, d), SPARSE, FLOW_MODEL)
        return windows.withColumn("probability", logistic_score())

    return staged(spark, folder, "scored-windows", build)


def day_number() -> Column:
    return F.unix_date(F.to_date("time")).cast("bigint")


def events_table(spark: SparkSession, folder: str) -> DataFrame:
    """The stored events; one ingest batch per day."""

    def build(s: SparkSession, d: str) -> DataFrame:
        rows = scoring.verdicts(scored_windows(s, d), SPARSE, [HOST])
        return rows.withColumn("ingest_batch_id", day_number())

    return staged(spark, folder, "events", build)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    done = events_table(spark, folder).filter(F.col("time") < F.lit(LEDGER_UNTIL).cast("timestamp"))
    return done.select("ingest_batch_id").distinct()


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def recording(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` under the column names of a recorded flow file."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series"),
        *LINE_ORDER,
        F.col("l_extendedprice").alias("Flow Byts/s"),
        F.col("l_quantity").alias("Flow Pkts/s"),
        F.col("l_discount").alias("Pkt Len Mean"),
        F.col("l_tax").alias("Flow IAT Mean"),
        F.col("l_linenumber").alias("SYN Flag Cnt"),
        (F.col("l_partkey") % 4).alias("ACK Flag Cnt"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.lit(".com")).alias(
            "Domain"
        ),
    )


def recorded_features(spark: SparkSession, folder: str) -> DataFrame:
    raw = recording(spark, folder)
    picked = files.feature_columns(raw, files.RECORDED_NAMES)
    rows = raw.select("series", *LINE_ORDER, *[c.alias(n) for n, c in picked.items()])
    numbered = number_rows(rows, ["series"], [F.col(c) for c in LINE_ORDER])
    return volumetric.offline_features(
        numbered, ["series"], SPARSE.offline_rows, LINE_MODEL, F.lit(1)
    )


def detection_log(spark: SparkSession, folder: str) -> DataFrame:
    """Packets as a log with true and detected attack flags, one log per destination."""
    return packets(spark, folder).select(
        F.col("dst_ip").alias("log"),
        "packet_id",
        "ts",
        evaluate.ground_truth(F.col("ts")).alias("in_timeline"),
        F.when(F.hour("ts").between(6, 11), 1).otherwise(0).alias("actual"),
        F.when(F.col("length") > 75, 1).otherwise(0).alias("predicted"),
    )


def detection_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.attack_blocks(
        detection_log(spark, folder),
        ["log"],
        [F.col("ts"), F.col("packet_id")],
    )


def line_entropies(spark: SparkSession, folder: str) -> DataFrame:
    return volumetric.tumbling_entropy(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows
    )


def line_fit(spark: SparkSession, folder: str) -> DataFrame:
    return models.regression_rows(line_entropies(spark, folder), LINE_MODEL, ["series", "w"])


def packet_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every packet with a score and a true class, for the curve queries."""
    return packets(spark, folder).select(
        "packet_id",
        (F.col("length") / 500.0).alias("score"),
        F.when((F.col("packet_id") * 7 + F.col("length")) % 5 < 2, 1).otherwise(0).alias("actual"),
    )


# ---- flows --------------------------------------------------------------------------


@query
def transport_packets(spark, folder):
    """TCP and UDP packets per protocol, with some packets renamed to other protocols."""
    mixed = packets(spark, folder).withColumn(
        "proto", F.when(F.col("packet_id") % 10 == 0, 1).otherwise(F.col("proto"))
    )
    return only_transport(mixed).groupBy("proto").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


@query
def flow_window_totals(spark, folder):
    """Volume of each capture window."""
    return flows.window_totals(packets(spark, folder), SPARSE)


@query
def flow_per_ip(spark, folder):
    """Flow rows per source and capture window."""
    return flow_table(spark, folder)


@query
def bidirectional_flows(spark, folder):
    """Flow rates with both directions folded together."""
    return flows.bidirectional_flows(packets(spark, folder), SPARSE)


@query
def iat_ttl(spark, folder):
    """Inter-arrival gaps that survive the state TTL."""
    return flows.packet_gaps(packets(spark, folder), SPARSE).drop("window_start")


@query
def sa_ratio(spark, folder):
    """SYN/ACK ratio and mean gap of each flow row."""
    return flow_table(spark, folder).select(
        "window_start",
        "source_ip",
        network.syn_ack_ratio(F.col("syn_count"), F.col("ack_count")).alias("sa_ratio"),
        network.mean_gap(F.col("iat_sum"), F.col("iat_count")).alias("iat_mean"),
    )


@query
def valid_ips(spark, folder):
    """Address check over packet sources, some of them made invalid by their number."""
    ip = F.when(F.col("packet_id") % 3 == 0, F.concat("src_ip", F.lit("9"), "length")).otherwise(
        F.col("src_ip")
    )
    return (
        packets(spark, folder)
        .select("packet_id", ip.alias("ip"))
        .filter(network.is_valid_ip(F.col("ip")))
    )


@query
def ip_to_int(spark, folder):
    """Packets per source, with the address as a number and back."""
    number = network.ipv4_to_long(F.col("src_ip"))
    return (
        packets(spark, folder)
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("packets"))
        .select(
            "src_ip", "packets", number.alias("number"), network.long_to_ipv4(number).alias("text")
        )
    )


@query
def stealth_labels(spark, folder):
    """Port scan, SYN flood and slowloris labels of each flow row."""
    base = flow_table(spark, folder)
    spread = flows.gap_spread(packets(spark, folder), SPARSE)
    ratio = network.syn_ack_ratio(F.col("syn_count"), F.col("ack_count"))
    joined = base.join(spread, ["window_start", "source_ip"], "left").select(
        "window_start",
        "source_ip",
        "unique_ports",
        ratio.alias("sa_ratio"),
        F.coalesce("iat_mean", F.lit(0.0)).alias("iat_mean"),
        F.coalesce("iat_std", F.lit(0.0)).alias("iat_std"),
    )
    label = rules.stealth_label(
        F.col("unique_ports"), F.col("sa_ratio"), F.col("iat_mean"), F.col("iat_std"), SPARSE
    )
    return joined.withColumn("label", label)


# ---- DNS ----------------------------------------------------------------------------


@query
def dns_query_list(spark, folder):
    """DNS queries of the packet table."""
    return queried_names(spark, folder)


@query
def domain_entropy(spark, folder):
    """Entropy of the host of every page."""
    hosts = read_table(spark, folder, "pages").select(
        "page_id", F.parse_url("url", F.lit("HOST")).alias("domain")
    )
    return hosts.withColumns(
        {
            "label": entropy.first_label(F.col("domain")),
            "entropy": entropy.domain_entropy(F.col("domain")),
            "cell_entropy": entropy.cell_entropy(F.col("domain")),
        }
    )


@query
def dga_flags(spark, folder):
    """Generated-name verdict of every DNS query."""
    verdict = entropy.dga_verdict(F.col("domain"), SPARSE.dga_entropy)
    return queried_names(spark, folder).select("ts", "source_ip", verdict.alias("v")).select(
        "ts", "source_ip", "v.analyzed_domain", "v.entropy", "v.is_DGA", "v.threshold"
    )


@query
def dns_fanout(spark, folder):
    """DNS messages encoded, unpacked again and turned into features."""
    sent = message_sink.encode_dns(queried_names(spark, folder))
    return features.dns_features(messages.decode_dns(sent))


# ---- entropy and kinematics ---------------------------------------------------------


@query
def count_windows(spark, folder):
    """Rows of the full 20-row windows, with their window number."""
    return volumetric.tumbling_windows(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows
    ).select("series", "w", "rn", "t_vol", "n_req", "s_len")


@query
def renyi_tumbling(spark, folder):
    """Rényi entropy of 20-row windows per supplier."""
    return line_entropies(spark, folder)


@query
def shannon_tumbling(spark, folder):
    """The alpha = 1 case of the same windows."""
    return volumetric.tumbling_entropy(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows, alpha=1
    )


@query
def renyi_trailing(spark, folder):
    """Rényi entropy of the trailing rows of each supplier, at most five."""

    def build(rows, window):
        return volumetric.trailing_entropy(rows, window, SPARSE.trailing_rows)

    numbered = numbered_lines(spark, folder)
    return volumetric.over_blocks(numbered, ["series"], SPARSE.trailing_rows - 1, build).select(
        "series", "rn", "h_t_vol", "h_n_req", "h_s_len"
    )


@query
def entropy_residual(spark, folder):
    """Entropy residual of each 20-row window."""
    return volumetric.tumbling_residuals(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows, LINE_MODEL
    ).select("series", "w", "residual")


@query
def poly_terms(spark, folder):
    """Degree-2 terms of each window."""
    return models.with_terms(line_entropies(spark, folder)).select("series", "w", *volumetric.TERMS)


@query
def kinematics(spark, folder):
    """Residual, velocity and acceleration per source and capture window."""
    return volumetric.flow_kinematics(
        flow_table(spark, folder), SPARSE.trailing_rows, FLOW_MODEL
    ).select("window_start", "source_ip", "residual", "velocity", "acceleration")


@query
def offline_features(spark, folder):
    """Feature rows of the recorded series, 20-row frames."""
    return recorded_features(spark, folder)


@query
def stability_check(spark, folder):
    """Count windows that leave the batch mean by a tenth of its deviation."""
    return volumetric.stability_flags(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows, line_series(spark, folder)
    )


@query
def any_violation(spark, folder):
    """Whether any window of the batch is unstable."""
    flags = volumetric.stability_flags(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows, line_series(spark, folder)
    )
    return volumetric.any_violation(flags, [f"unstable_{c}" for c in volumetric.SERIES])


@query
def zscore_chebyshev(spark, folder):
    """Windows whose residual passes the Chebyshev bound."""
    residuals = volumetric.tumbling_residuals(
        numbered_lines(spark, folder), ["series"], SPARSE.offline_rows, LINE_MODEL
    ).select("series", "w", "residual")
    return volumetric.residual_anomalies(residuals, LINE_MEAN, LINE_SIGMA)


@query
def burst_signature(spark, folder):
    """Burst or flood label of each count window of five rows."""
    return volumetric.burst_signatures(
        numbered_lines(spark, folder), ["series"], 5, line_series(spark, folder), k=0.8
    )


@query
def series_stats(spark, folder):
    """Mean and deviation of the three volumes."""
    return volumetric.series_stats(line_series(spark, folder), volumetric.SERIES)


@query
def inf_clean(spark, folder):
    """Infinite volumes replaced by the mean of the finite ones."""
    rate = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("t_vol"))
    rows = line_series(spark, folder).select("series", *LINE_ORDER, rate.alias("t_vol"))
    return volumetric.replace_infinite(rows, ["t_vol"]).drop("l_shipdate")


@query
def dynamic_window(spark, folder):
    """Window size per supplier, scaled by its volatility."""
    rows = line_series(spark, folder)
    overall = rows.agg(F.stddev_pop("t_vol")).scalar()
    return (
        rows.groupBy("series")
        .agg(F.stddev_pop("t_vol").alias("sigma"))
        .select(
            "series",
            volumetric.dynamic_window(F.col("sigma"), overall, DYNAMIC_SIZE).alias("size"),
        )
    )


@query
def spike_alerts(spark, folder):
    """Acceleration spikes with memory reset, 5-row frames per supplier."""
    moving = volumetric.trailing_kinematics(
        numbered_lines(spark, folder), ["series"], 5, LINE_MODEL, full_frames_only=True
    )
    residuals = moving.filter(F.col("rn") >= 5).select(
        "series", (F.col("rn") - 4).alias("rn"), "residual"
    )
    return spikes.spike_alerts(residuals, ["series"], SPIKE_THRESHOLD)


# ---- spatial ------------------------------------------------------------------------


@query
def minhash_signature(spark, folder):
    """MinHash signature of each window, as text."""
    sigs = spatial.signatures(spatial.port_sources(packets(spark, folder), SPARSE), SPARSE)
    return sigs.withColumn("signature", F.array_join(F.col("signature").cast("array<string>"), ","))


@query
def port_sources(spark, folder):
    """Distinct sources per window and target port."""
    return spatial.port_sources(packets(spark, folder), SPARSE)


@query
def spatial_jaccard(spark, folder):
    """Similarity verdict of each window with its predecessor."""
    p = packets(spark, folder)
    return spatial.signature_similarity(
        spatial.signatures(spatial.port_sources(p, SPARSE), SPARSE),
        spatial.first_capture_window(p, SPARSE),
        SPARSE,
    )


@query
def spatial_fanout(spark, folder):
    """The similarity score for every source of the window."""
    return spatial.similarity_per_source(flows.packet_summary(packets(spark, folder), SPARSE), SPARSE)


@query
def spatial_log(spark, folder):
    """One similarity log line per window, idle ones included."""
    return spatial.similarity_log(packets(spark, folder), SPARSE)


# ---- evaluation windows -------------------------------------------------------------


@query
def unified_features(spark, folder):
    """Six features per source and evaluation window."""
    return features.window_features(
        packets(spark, folder), queried_names(spark, folder), SPARSE, FLOW_MODEL
    ).drop("time")


@query
def evaluated_entities(spark, folder):
    """Sources evaluated per window."""
    return features.evaluated_entities(scored_windows(spark, folder))


@query
def host_exclusion(spark, folder):
    """Scored windows without the host."""
    return scoring.without_hosts(scored_windows(spark, folder), [HOST]).select(
        "time", "source_ip", "probability"
    )


@query
def guardrails(spark, folder):
    """Rows that a guardrail lifts, with the lifted probability."""
    return (
        scored_windows(spark, folder)
        .filter(rules.guardrail(SPARSE))
        .select("time", "source_ip", F.greatest("probability", F.lit(SPARSE.boost)).alias("probability"))
    )


@query
def quiet_override(spark, folder):
    """Rows that pass as quiet."""
    return (
        scored_windows(spark, folder)
        .filter(rules.quiet(SPARSE))
        .select("time", "source_ip", "sa_ratio", "entropy_shannon")
    )


@query
def bayes_posterior(spark, folder):
    """Running posterior of each source."""
    rows = scored_windows(spark, folder).select(
        "time", "source_ip", "probability", F.lit(False).alias("skip")
    )
    return scoring.sequential_posterior(rows, SPARSE).drop("skip")


@query
def verdicts(spark, folder):
    """Event rows after all scoring rules."""
    return scoring.verdicts(scored_windows(spark, folder), SPARSE, [HOST])


@query
def prior_adjust(spark, folder):
    """Probabilities moved to the real attack prior."""
    return scored_windows(spark, folder).select(
        "time", "source_ip", rules.adjust_prior(F.col("probability")).alias("adjusted")
    )


@query
def alerts(spark, folder):
    """Alert lines."""
    return scoring.alerts(events_table(spark, folder), SPARSE)


@query
def alert_tail(spark, folder):
    """The last ten alerts."""
    return reports.last_alerts(scoring.alerts(events_table(spark, folder), SPARSE), 10)


@query
def alert_rotation(spark, folder):
    """The alerts an alert file keeps."""
    return event_sink.newest_alerts(scoring.alerts(events_table(spark, folder), SPARSE), 50)


@query
def alert_log_scan(spark, folder):
    """Alert lines written as text and read back."""
    path = stage_path(spark, "alert-log")
    lines = scoring.alerts(events_table(spark, folder), SPARSE).select(
        F.inline(F.array(F.struct("line"), F.struct(F.lit("  ").alias("line"))))
    )
    lines.write.text(path)
    return files.read_log_lines(spark, path)


# ---- events table -------------------------------------------------------------------


@query
def latest_events(spark, folder):
    """The five newest events."""
    return reports.latest_events(events_table(spark, folder))


@query
def attacks_desc(spark, folder):
    """All attacks."""
    return reports.attacks(events_table(spark, folder))


@query
def latest_per_ip(spark, folder):
    """Newest event of each source."""
    return reports.latest_per_source(events_table(spark, folder))


@query
def unprocessed_count(spark, folder):
    """Number of events, and of those not yet processed."""
    events = events_table(spark, folder)
    return reports.event_counts(events, learning.unprocessed(events, ledger(spark, folder)))


@query
def sanitized_batch(spark, folder):
    """Confident unprocessed rows with their labels."""
    return learning.sanitized_batch(
        events_table(spark, folder), ledger(spark, folder), as_of(), SPARSE, TRUSTED
    )


@query
def ledger_unprocessed(spark, folder):
    """Batches that the next sanitation run marks as processed."""
    return learning.processed_batches(
        events_table(spark, folder), ledger(spark, folder), as_of(), SPARSE, TRUSTED
    )


@query
def retention(spark, folder):
    """Events inside the retention period."""
    return reports.retained(events_table(spark, folder), as_of(), RETENTION_DAYS).select(
        "time", "source_ip", "prediction"
    )


@query
def threat_bands(spark, folder):
    """Events per display band."""
    return reports.threat_bands(events_table(spark, folder))


@query
def latest_velocity(spark, folder):
    """Velocity of the newest scored window."""
    return reports.latest_velocity(scored_windows(spark, folder), "time")


@query
def threshold_flags(spark, folder):
    """Windows above the dashboard lines."""
    flagged = reports.threshold_flags(scored_windows(spark, folder))
    return flagged.groupBy("fast", "jerky").agg(F.count(F.lit(1)).alias("n"))


# ---- learning -----------------------------------------------------------------------


@query
def adaptive_rows(spark, folder):
    """Confident rows of the last days, with their labels."""
    return learning.adaptive_rows(events_table(spark, folder), as_of(), SPARSE, TRUSTED)


@query
def adaptive_training_set(spark, folder):
    """Recorded attacks joined by the confident events."""
    recent = learning.adaptive_rows(events_table(spark, folder), as_of(), SPARSE, TRUSTED)
    return learning.union_labelled(recorded_features(spark, folder), recent)


@query
def class_counts(spark, folder):
    """Rows per class."""
    return learning.class_counts(read_table(spark, folder, "labels"), "quality")


@query
def balanced_set(spark, folder):
    """As many sampled non-toxic documents as toxic ones."""
    rows = read_table(spark, folder, "labels").select("doc_id", (1 - F.col("toxic")).alias("label"))
    gate = replace(SPARSE, min_benign=1)
    return learning.balanced(rows, "doc_id", gate)


@query
def balanced_lines(spark, folder):
    """A large balance: returned lines as the small class, all others sampled."""
    rows = read_table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("label"),
    )
    gate = replace(SPARSE, min_benign=1)
    return learning.balanced(rows, "id", gate)


@query
def train_test_split(spark, folder):
    """Hash split of the labelled documents."""
    held_out = learning.in_test_split(F.col("doc_id"))
    return read_table(spark, folder, "labels").select("doc_id", held_out.alias("held_out"))


@query
def shuffled_labels(spark, folder):
    """Labels in hash order."""
    rows = read_table(spark, folder, "labels").withColumn(
        "order_key", learning.order_key(F.col("doc_id"))
    )
    return learning.shuffled(rows, "doc_id")


@query
def scaled_features(spark, folder):
    """Standardised features of the stored events."""
    events = events_table(spark, folder).select("time", "source_ip", *FEATURE_COLUMNS)
    return learning.scaled(events, learning.scaling_stats(events))


@query
def training_stats(spark, folder):
    """Residual and volume statistics kept with the regression."""
    return models.training_stats(line_fit(spark, folder), line_series(spark, folder))


# ---- evaluation ---------------------------------------------------------------------


@query
def ground_truth(spark, folder):
    """Packets by true class and interval of the timeline."""
    return packets(spark, folder).select(
        "packet_id",
        evaluate.ground_truth(F.col("ts")).alias("is_attack"),
        F.coalesce(evaluate.interval_number(F.col("ts")), F.lit(0)).alias("interval"),
    )


@query
def attack_bounds(spark, folder):
    """First and last packet in each attack interval."""
    return evaluate.interval_bounds(packets(spark, folder), "ts")


@query
def point_adjusted_rows(spark, folder):
    """Log rows with detections spread over their attack run."""
    return evaluate.point_adjusted(detection_blocks(spark, folder), ["log"]).select(
        "packet_id", "actual", "predicted", "adjusted"
    )


@query
def point_adjusted_metrics(spark, folder):
    """Metrics after point adjustment, per log."""
    return evaluate.point_adjusted_metrics(detection_blocks(spark, folder), ["log"])


@query
def confusion_metrics(spark, folder):
    """Confusion counts and rates without adjustment."""
    return evaluate.confusion_metrics(detection_log(spark, folder), ["log"])


@query
def class_report(spark, folder):
    """Per-class precision, recall and F1, with averages."""
    return evaluate.class_report(read_table(spark, folder, "labels"), "quality", "toxic")


@query
def roc_points(spark, folder):
    """ROC curve of the packet scores."""
    return evaluate.roc_points(evaluate.score_curve(packet_scores(spark, folder), "score"))


@query
def roc_auc(spark, folder):
    """Area under that curve."""
    return evaluate.roc_auc(evaluate.score_curve(packet_scores(spark, folder), "score"))


@query
def pr_points(spark, folder):
    """Precision-recall curve of the packet scores."""
    return evaluate.pr_points(evaluate.score_curve(packet_scores(spark, folder), "score"))


@query
def average_precision(spark, folder):
    """Average precision of the packet scores."""
    return evaluate.average_precision(evaluate.score_curve(packet_scores(spark, folder), "score"))


@query
def scored_rows(spark, folder):
    """Actual and predicted volume entropy of each window."""
    return evaluate.scored_rows(line_fit(spark, folder), "actual", "predicted", ["series", "w"])


@query
def regression_metrics(spark, folder):
    """Quality of the entropy regression."""
    return evaluate.regression_metrics(
        evaluate.scored_rows(line_fit(spark, folder), "actual", "predicted")
    )


@query
def residual_histogram(spark, folder):
    """Distribution of the regression residuals."""
    return evaluate.residual_histogram(
        evaluate.scored_rows(line_fit(spark, folder), "actual", "predicted")
    )


# ---- messages and files -------------------------------------------------------------


@query
def json_encode(spark, folder):
    """Flow messages: key, and the counters read back out of the JSON text."""
    sent = message_sink.encode_flows(flow_table(spark, folder))
    value = F.col("value")
    return sent.select(
        "key",
        "timestamp",
        F.get_json_object(value, "$.Source_IP").alias("source_ip"),
        F.get_json_object(value, "$.U_ports").cast("bigint").alias("unique_ports"),
        F.get_json_object(value, "$.syn_count").cast("bigint").alias("syn_count"),
        F.get_json_object(value, "$.T_vol").cast("double").alias("t_vol"),
    )


@query
def json_decode(spark, folder):
    """Flow messages decoded; cut messages are left out and absent counters become 0."""
    sent = message_sink.encode_flows(flow_table(spark, folder))
    value = (
        F.when(F.length("key") % 2 == 0, F.regexp_replace("value", '"syn_count":[0-9]+,', ""))
        .otherwise(F.col("value"))
    )
    both = F.explode(F.array(value, F.substring("value", 1, 20)))
    return messages.decode_flows(sent.withColumn("value", both))


@query
def json_malformed(spark, folder):
    """Side output of messages that do not parse."""
    sent = message_sink.encode_flows(flow_table(spark, folder))
    cut = sent.withColumn(
        "value", F.when(F.col("key").endswith("1"), F.substring("value", 1, 20)).otherwise(F.col("value"))
    )
    bad = messages.malformed(cut, messages.FLOW_MESSAGE)
    return bad.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def csv_flows(spark, folder):
    """The recording written as CSV, read back under its own names, features picked."""
    path = stage_path(spark, "recording-csv")
    recording(spark, folder).write.option("header", True).csv(path)
    schema = ", ".join(f"`{n}` {t}" for n, t in recording(spark, folder).dtypes)
    raw = files.read_csv(spark, [path], schema)
    picked = files.feature_columns(raw, files.RECORDED_NAMES)
    return raw.select(
        "series", "l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in picked.items()]
    )


@query
def label_union(spark, folder):
    """Two labelled file sets and a missing file, stacked and counted."""
    benign, attack = stage_path(spark, "benign-csv"), stage_path(spark, "attack-csv")
    raw = line_series(spark, folder).select("series", "t_vol", "flag")
    raw.filter(F.col("flag") == "N").write.option("header", True).csv(benign)
    raw.filter(F.col("flag") != "N").write.option("header", True).option("compression", "gzip").csv(attack)
    rows = files.read_labelled(
        spark, [benign, f"{benign}-missing"], [attack], "series bigint, t_vol double, flag string"
    )
    return rows.groupBy("series", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t_vol").alias("t_vol")
    )


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def frames_of(p: DataFrame) -> DataFrame:
    """Packets packed into link-layer frames of every supported kind."""
    number = network.ipv4_to_long
    udp = F.col("proto") == network.UDP
    labels = F.transform(F.split("qname", r"\."), lambda x: F.concat(_hex(F.length(x), 1), F.hex(x)))
    dns = F.concat(F.lit("00010100000100000000" + "0000"), F.array_join(labels, ""), F.lit("0000010001"))
    ports = F.concat(_hex(F.col("src_port"), 2), _hex(F.col("dst_port"), 2))
    tcp = F.concat(ports, F.lit("0" * 16 + "50"), _hex(F.col("tcp_flags"), 1), F.lit("0" * 12))
    datagram = F.concat(ports, F.lit("00000000"), dns)
    ip = F.concat(
        F.lit("4500"), F.lit("0000" + "0000" + "0000" + "40"), _hex(F.col("proto"), 1), F.lit("0000"),
        _hex(number(F.col("src_ip")), 4), _hex(number(F.col("dst_ip")), 4),
        F.when(udp, datagram).otherwise(tcp),
    )
    kind = F.col("packet_id") % 6
    macs = "0" * 24
    text = (
        F.when(kind == 0, F.concat(F.lit(macs + "0800"), ip))
        .when(kind == 1, F.concat(F.lit(macs + "81000005" + "0800"), ip))
        .when(kind == 2, F.concat(F.lit("02000000"), ip))
        .when(kind == 3, F.concat(F.lit("0" * 28 + "0800"), ip))
        .when(kind == 4, ip)
        .otherwise(F.lit(macs + "86dd" + "60" * 40))
    )
    link = (
        F.when(kind.isin(0, 1, 5), frames.ETHERNET).when(kind == 2, 0).when(kind == 3, frames.COOKED).otherwise(12)
    )
    return p.select("packet_id", "ts", link.alias("linktype"), F.unhex(text).alias("frame"))


@query
def frame_decode(spark, folder):
    """Packets packed into frames and decoded again."""

    def build(s: SparkSession, d: str) -> DataFrame:
        return frames_of(with_qname(s, d, packets(s, d)))

    return frames.decode_frames(staged(spark, folder, "frames", build)).drop("length")


@query
def log_quality(spark, folder):
    """Detections of fast windows against the recorded timeline."""
    log = packets(spark, folder)
    return evaluation.log_quality(
        log, "ts", F.col("length") > 75, ["dst_ip"], [F.col("packet_id")]
    )


# ---- models (checked by properties, not by SQL) -------------------------------------


def classifier_rows(spark: SparkSession, folder: str) -> DataFrame:
    return learning_loop.training_set(
        recorded_features(spark, folder), events_table(spark, folder), as_of(), SPARSE, TRUSTED
    )


@query
def mlp_scores(spark, folder):
    """Windows scored by a classifier trained on the balanced set."""
    network = models.fit_classifier(classifier_rows(spark, folder), models.ADAPTIVE_LAYERS)
    return network.score(scored_windows(spark, folder)).select(
        "time", "source_ip", "probability", "prediction"
    )


@query
def mlp_hold_out(spark, folder):
    """Class report of the base classifier on held-out rows."""
    _, scored = offline.train_base_classifier(classifier_rows(spark, folder), F.col("id"))
    return evaluate.class_report(scored, "label", "prediction")


@query
def regression_fit(spark, folder):
    """Quality of an entropy regression fitted on these tables."""
    entropies = line_entropies(spark, folder)
    model = models.fit_entropy_model(entropies, F.concat_ws("-", "series", "w"))
    return evaluate.regression_metrics(
        evaluate.scored_rows(models.regression_rows(entropies, model), "actual", "predicted")
    )


@query
def regression_normal_equations(spark, folder):
    """Mean of residual times term over the training windows: zero for each term of a fit
    of least squares."""
    entropies = line_entropies(spark, folder)
    identity = F.concat_ws("-", "series", "w")
    model = models.fit_entropy_model(entropies, identity)
    train = entropies.filter(~learning.in_test_split(identity))
    n, s = F.col("h_n_req"), F.col("h_s_len")
    residual = F.col("h_t_vol") - volumetric.predicted_entropy(n, s, model)
    terms = {"constant": F.lit(1.0), **volumetric.poly_terms(n, s)}
    sums = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(residual * x).alias(t) for t, x in terms.items()])
    rows = [F.struct(F.lit(t).alias("term"), (F.round(t, 5) + 0.0).alias("product"), "n") for t in terms]
    return sums.select(F.inline(F.array(*rows)))


@query
def mlp_score_bounds(spark, folder):
    """Windows scored by the trained classifier: all of them, within [0, 1], on the side of
    the prediction."""
    scored = mlp_scores(spark, folder)
    p, called = F.col("probability"), F.col("prediction") == 1
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p.between(0.0, 1.0)).alias("n_probable"),
        F.count_if(called == (p > 0.5)).alias("n_consistent"),
    )


@query
def mlp_hold_out_bounds(spark, folder):
    """Rows of each class that the base classifier learns from and is tried on, and whether
    a fifth was held out and beats guessing the larger class."""
    rows = classifier_rows(spark, folder)
    _, scored = offline.train_base_classifier(rows, F.col("id"))
    label, right = F.col("label"), F.avg((F.col("label") == F.col("prediction")).cast("double"))
    tried = row_of(
        scored.agg(
            F.count(F.lit(1)).alias("n"), right.alias("right"),
            F.greatest(F.avg((label == 0).cast("double")), F.avg((label == 1).cast("double"))).alias("guess"),
        )
    )
    total = rows.count()
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label",
        "n",
        (tried["n"] / F.lit(float(total))).between(0.1, 0.3).alias("a_fifth_held_out"),
        (tried["right"] >= tried["guess"]).alias("beats_guessing"),
    )


# ---- streaming ----------------------------------------------------------------------

CLOSING_IP = "10.255.255.1"


def packet_files(spark: SparkSession, folder: str, path: str) -> None:
    """Packets as a stream source, followed by packets that close the last windows."""
    columns = [c.split()[0] for c in streams.PACKETS.split(", ")]
    real = with_qname(spark, folder, packets(spark, folder)).select(*columns)
    last = packets(spark, folder).agg(F.max("ts")).scalar()
    later = last + F.make_dt_interval(days=F.col("id").cast("int") * 2)
    closing = (
        spark.range(1, 13)
        .select("id", later.alias("ts"), F.explode(F.array(F.lit(network.TCP), F.lit(network.UDP))).alias("proto"))
        .select(
            (-F.col("id")).alias("packet_id"),
            "ts",
            F.lit(CLOSING_IP).alias("src_ip"),
            F.lit("192.168.0.0").alias("dst_ip"),
            F.lit(1).alias("src_port"),
            F.when(F.col("proto") == network.UDP, 53).otherwise(80).alias("dst_port"),
            "proto",
            F.lit(16).alias("tcp_flags"),
            F.lit(60).alias("length"),
            F.when(F.col("proto") == network.UDP, "end.example").alias("qname"),
        )
    )
    real.unionByName(closing).write.parquet(path)


@query
def stream_events(spark, folder):
    """Events that the streaming stages store for the same packets."""
    run = streams.Streams(
        spark, stage_path(spark, "streams"), SPARSE, FLOW_MODEL, "0 seconds", hosts=(HOST,)
    )
    packet_files(spark, folder, run.table("packets"))
    run.run_once(lambda: lambda df: df.withColumn("probability", logistic_score()))
    stored = event_sink.read_events(spark, run.table("events"))
    return stored.filter(F.col("source_ip") != CLOSING_IP).select(
        "time", "source_ip", "analyzer", *FEATURE_COLUMNS, "probability", "prediction"
    )


@query
def stream_events_by_messages(spark, folder):
    """The same events, with flows, signatures and name queries as JSON messages by topic."""
    run = streams.MessageStreams(
        spark, stage_path(spark, "message-streams"), SPARSE, FLOW_MODEL, "0 seconds", hosts=(HOST,)
    )
    packet_files(spark, folder, run.table("packets"))
    run.run_once(lambda: lambda df: df.withColumn("probability", logistic_score()))
    stored = event_sink.read_events(spark, run.table("events"))
    return stored.filter(F.col("source_ip") != CLOSING_IP).select(
        "time", "source_ip", "analyzer", *FEATURE_COLUMNS, "probability", "prediction"
    )
