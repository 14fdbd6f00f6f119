"""Streaming stages from packets to stored events.

Each stage is one query that reads a stage table as a stream and appends to the next,
so that stages restart and scale on their own. A stage table stands where a broker topic
would; `MessageStreams` runs the same stages over keyed JSON messages by topic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.config import Profile
from tidewatch.functions import rules
from tidewatch.functions.entropy import domain_entropy
from tidewatch.functions.network import mean_gap, syn_ack_ratio
from tidewatch.operators import features as feature_ops
from tidewatch.operators import flows as flow_ops
from tidewatch.operators import spatial
from tidewatch.operators.scoring import alerts, without_hosts
from tidewatch.operators.volumetric import EntropyModel
from tidewatch.session import prepare
from tidewatch.sinks import messages as message_sink
from tidewatch.sinks.events import LOG_COLUMNS, write_events, write_once
from tidewatch.sources import messages as message_source
from tidewatch.sources.schemas import FEATURE_COLUMNS, FLOW_MESSAGE, SIGNATURE_MESSAGE
from tidewatch.sources.tables import dns_queries, only_transport
from tidewatch.streaming import state

PACKETS = (
    "packet_id bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "proto int, tcp_flags int, length int, qname string"
)


class LateRows(StreamingQueryListener):
    """Counts of rows that came after the watermark, per query and batch, for a table.

    Spark reports every batch once; `flush` appends what has been reported since the last
    call. Rows that were combined before the state store count as one.
    """

    SCHEMA = "query string, batch_id bigint, at string, dropped bigint"

    def __init__(self, path: str):
        self.path = path
        self.waiting: list[tuple[str, int, str, int]] = []
        self.lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        if dropped:
            with self.lock:
                self.waiting.append((progress.name or str(progress.id), progress.batchId, progress.timestamp, dropped))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self, spark: SparkSession) -> None:
        with self.lock:
            rows, self.waiting = self.waiting, []
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        self.flush(spark)
        try:
            return spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was late so far
            return spark.createDataFrame([], self.SCHEMA)


@dataclass
class Streams:
    """Stage tables and checkpoints under one shared folder."""

    spark: SparkSession
    root: str
    profile: Profile
    model: EntropyModel
    delay: str  # how late a packet may come; later ones are dropped and counted
    hosts: tuple[str, ...] | DataFrame = ()
    trigger: dict | None = None

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def late_rows(self) -> LateRows:
        """Counts late rows of all queries of the session from now on, in the table `late`."""
        listener = LateRows(self.table("late"))
        self.spark.streams.addListener(listener)
        return listener

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        prepare(self.spark)
        if schema is None:
            # names and types only: stored metadata still carries the writer's watermark
            stored = self.spark.read.parquet(self.table(name)).dtypes
            schema = ", ".join(f"`{c}` {t}" for c, t in stored)
        return self.spark.readStream.schema(schema).parquet(self.table(name))

    def _writer(self, df: DataFrame, name: str):
        return (
            df.writeStream.outputMode("append")
            .queryName(f"{name}-{uuid.uuid4().hex[:8]}")
            .option("checkpointLocation", f"{self.root}/_checkpoints/{name}")
            .trigger(**(self.trigger or {"availableNow": True}))
        )

    def append(self, df: DataFrame, name: str) -> StreamingQuery:
        return self._writer(df, name).format("parquet").start(self.table(name))

    def each_batch(self, df: DataFrame, name: str, body: Callable[[DataFrame, int], None]) -> StreamingQuery:
        return self._writer(df, name).foreachBatch(body).start()

    # ---- stages ---------------------------------------------------------------------

    def packets(self) -> DataFrame:
        return only_transport(self.read("packets", PACKETS)).withWatermark("ts", self.delay)

    def dns(self) -> DataFrame:
        return dns_queries(self.read("packets", PACKETS))

    def totals(self) -> StreamingQuery:
        return self.append(flow_ops.window_totals(self.packets(), self.profile), "totals")

    def summaries(self) -> StreamingQuery:
        return self.append(flow_ops.flow_summaries(self.packets(), self.profile), "summaries")

    def gaps(self) -> StreamingQuery:
        rows = self.read("summaries").withWatermark("window_start", self.delay)
        return self.append(
            state.flow_gaps(rows.withColumn("start_us", F.unix_micros("window_start")), self.profile),
            "gaps",
        )

    def flows(self) -> StreamingQuery:
        """Counters per source joined with the totals of their window.

        Distinct aggregates are not available on streams; a port set holds at most 65,536
        numbers.
        """
        counters = (
            self.read("gaps")
            .withWatermark("window_start", self.delay)
            .groupBy("window_start", F.col("src_ip").alias("source_ip"))
            .agg(
                F.size(F.collect_set("dst_port")).cast("bigint").alias("unique_ports"),
                F.sum("syn_count").alias("syn_count"),
                F.sum("ack_count").alias("ack_count"),
                (F.sum("gap_us") / F.lit(float(flow_ops.MICROS))).alias("iat_sum"),
                F.sum("gap_count").alias("iat_count"),
            )
        )
        totals = self.read("totals").withWatermark("window_start", self.delay)
        return self.append(counters.join(totals, "window_start"), "flows")

    def kinematics(self) -> StreamingQuery:
        return self.append(
            state.kinematics(self.read("flows"), self.profile, self.model), "kinematics"
        )

    def sources(self) -> StreamingQuery:
        return self.append(spatial.port_sources(self.packets(), self.profile), "sources")

    def signatures(self) -> StreamingQuery:
        rows = self.read("sources").withWatermark("window_start", self.delay)
        return self.append(spatial.signatures(rows, self.profile), "signatures")

    def similarity(self) -> StreamingQuery:
        return self.append(state.similarity(self.read("signatures"), self.profile), "similarity")

    def spatial(self) -> StreamingQuery:
        """The score of a window and port for every source that hit it."""
        sources = self.read("sources").withWatermark("window_start", self.delay)
        scores = self.read("similarity").withWatermark("window_start", self.delay)
        return self.append(sources.join(scores, ["window_start", "target_port"]), "spatial")

    def windows(self) -> StreamingQuery:
        """The four analyzers rolled up per source and evaluation window.

        Each branch has its own watermark, so the slowest analyzer decides when a window
        closes.
        """
        moving = self.read("kinematics").select(
            "ts", "source_ip", F.lit("volumetric").alias("analyzer"), "velocity", "acceleration"
        )
        branches = [
            moving,
            feature_ops.stealth_features(self.read("flows")),
            feature_ops.spatial_features(self.read("spatial")),
            feature_ops.dns_features(self.dns()),
        ]
        stacked = feature_ops.unify(*[b.withWatermark("ts", self.delay) for b in branches])
        return self.append(feature_ops.roll_up(stacked, self.profile), "windows")

    def scored(self, score: Callable[[], Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
        """Adds the classifier probability; `score` is asked for the current model once per
        micro-batch, so that a newly published one takes over between windows."""

        def body(batch: DataFrame, batch_id: int) -> None:
            write_once(score()(without_hosts(batch, self.hosts)), self.table("scored"), batch_id)

        return self.each_batch(self.read("windows"), "scored", body)

    def posteriors(self) -> StreamingQuery:
        p = self.profile
        rows = self.read("scored").select(
            "time",
            "source_ip",
            F.when(rules.guardrail(p), F.greatest(F.col("probability"), F.lit(p.boost)))
            .otherwise(F.col("probability"))
            .alias("probability"),
            rules.quiet(p).alias("skip"),
        )
        return self.append(state.posterior(rows, p), "posteriors")

    def events(self) -> StreamingQuery:
        """Event rows and alert lines; both sinks can be replayed."""
        p = self.profile
        scored = self.read("scored").select("time", "source_ip", *FEATURE_COLUMNS)
        verdicts = self.read("posteriors").withWatermark("time", self.delay)
        probability = F.coalesce("posterior", F.lit(0.0))
        rows = (
            scored.withWatermark("time", self.delay)
            .join(verdicts, ["time", "source_ip"])
            .select(
                "time",
                "source_ip",
                F.lit("aggregated").alias("analyzer"),
                F.lit(False).alias("is_host_ip"),
                *FEATURE_COLUMNS,
                probability.alias("probability"),
                F.when(probability >= p.attack_posterior, 1).otherwise(0).alias("prediction"),
            )
        )

        def body(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            write_events(batch, self.table("events"), batch_id)
            write_once(alerts(batch, p).select("line"), self.table("alerts"), batch_id, "text")
            batch.unpersist()

        return self.each_batch(rows, "events", body)

    def telemetry(self) -> list[StreamingQuery]:
        """The four logs of the analyzers, in their column order; a replayed batch is logged once."""
        gaps = mean_gap(F.col("iat_sum"), F.col("iat_count"))
        ratio = syn_ack_ratio(F.col("syn_count"), F.col("ack_count"))
        named = self.dns().filter(F.coalesce("domain", F.lit("")) != "")
        rows = {
            "residual": self.read("kinematics").select("ts", "source_ip", "residual", "velocity", "acceleration"),
            "stealth": self.read("flows").select("window_start", "source_ip", gaps, ratio),
            "spatial": self.read("similarity").select("window_start", "target_port", "jaccard_score"),
            "dns": named.select("ts", "source_ip", "domain", domain_entropy(F.col("domain"))),
        }

        def writer(kind: str) -> Callable[[DataFrame, int], None]:
            def body(batch: DataFrame, batch_id: int) -> None:
                write_once(batch, self.table(f"log-{kind}"), batch_id)

            return body

        return [
            self.each_batch(df.toDF(*LOG_COLUMNS[kind]), f"log-{kind}", writer(kind)) for kind, df in rows.items()
        ]

    def run_once(self, score: Callable[[], Callable[[DataFrame], DataFrame]]) -> None:
        """Runs every stage over the data that is there, in order."""
        for stage in (
            self.totals,
            self.summaries,
            self.gaps,
            self.flows,
            self.kinematics,
            self.sources,
            self.signatures,
            self.similarity,
            self.spatial,
            self.windows,
            lambda: self.scored(score),
            self.posteriors,
            self.events,
        ):
            stage().awaitTermination()


TOPICS = {
    "flows": (message_source.FLOW_TOPIC, message_sink.encode_flows, message_source.decode_flows),
    "signatures": (message_source.SIGNATURE_TOPIC, message_sink.encode_signatures, message_source.decode_signatures),
    "dns": (message_source.DNS_TOPIC, message_sink.encode_dns, message_source.decode_dns),
}


@dataclass
class MessageStreams(Streams):
    """The stages with flows, signatures and name queries as keyed JSON messages by topic.

    `fmt` and `options` are those of the broker's connector; with a file format, a topic is a
    folder of messages. Whoever reads a topic sees every message of the subscription and
    takes its own out of the running stream, and messages that do not parse are kept aside by
    `malformed`. Topics named in `foreign` are filled by other senders.
    """

    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    foreign: tuple[str, ...] = ()

    def _folder(self, topic: str) -> str | None:
        return None if self.fmt == "kafka" else f"{self.root}/topic={topic}"

    def subscription(self, topic: str) -> DataFrame:
        options = {**message_source.kafka_options(self.options.get("kafka.bootstrap.servers", ""), [topic]), **self.options}
        messages = message_source.subscribe(
            self.spark, self.fmt, options if self.fmt == "kafka" else self.options, self._folder(topic)
        )
        return message_source.of_topic(messages, topic)

    def append(self, df: DataFrame, name: str) -> StreamingQuery:
        if name not in TOPICS:
            return super().append(df, name)
        topic, encode, _ = TOPICS[name]
        writer = self._writer(encode(df), name).format(self.fmt).options(**self.options)
        return writer.start() if self.fmt == "kafka" else writer.start(self._folder(topic))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        if name not in TOPICS:
            return super().read(name, schema)
        topic, _, decode = TOPICS[name]
        return decode(self.subscription(topic))

    def name_queries(self) -> StreamingQuery:
        """Publishes the name queries among the packets."""
        return self.append(dns_queries(super().read("packets", PACKETS)), "dns")

    def dns(self) -> DataFrame:
        return self.read("dns")

    def malformed(self, name: str) -> StreamingQuery:
        """Messages of a topic that do not parse, as a table."""
        topic, _, _ = TOPICS[name]
        messages = self.subscription(topic)
        schemas = {"flows": FLOW_MESSAGE, "signatures": SIGNATURE_MESSAGE}
        bad = message_source.malformed(messages, schemas[name]) if name in schemas else message_source.malformed_dns(messages)
        return super().append(bad, f"malformed-{name}")

    def run_once(self, score: Callable[[], Callable[[DataFrame], DataFrame]]) -> None:
        if "dns" not in self.foreign:
            self.name_queries().awaitTermination()
        super().run_once(score)
