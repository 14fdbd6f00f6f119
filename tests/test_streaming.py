"""Streaming stages against the batch run, and a restart."""

import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import queries
from tidewatch.catalog.parameters import FLOW_MODEL, HOST, logistic_score
from tidewatch.config import SPARSE
from tidewatch.sources.schemas import FEATURE_COLUMNS
from tidewatch.operators import models
from tidewatch.sinks.events import LOG_COLUMNS, write_once
from tidewatch.streaming import state
from tidewatch.streaming.jobs import MessageStreams, Streams

COLUMNS = ["time", "source_ip", *FEATURE_COLUMNS, "probability", "prediction"]


def rounded(df):
    kinds = df.select(*COLUMNS).dtypes
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in kinds])


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each stage keeps one state store per shuffle partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_equals_batch_and_restarts_cleanly(spark, folder, tmp_path):
    run = Streams(spark, str(tmp_path), SPARSE, FLOW_MODEL, "0 seconds", hosts=(HOST,))
    packets = str(tmp_path / "all")
    queries.packet_files(spark, folder, packets)
    whole = spark.read.parquet(packets)
    middle = F.lit("2024-01-15").cast("timestamp")
    score = lambda: lambda df: df.withColumn("probability", logistic_score())

    # two halves, so that every keyed state is carried over a restart
    whole.filter(F.col("ts") < middle).coalesce(1).write.parquet(run.table("packets"))
    run.run_once(score)
    first = spark.read.parquet(run.table("events")).count()
    whole.filter(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(run.table("packets"))
    run.run_once(score)
    # a restart without new input adds nothing
    for stage in (run.kinematics, run.posteriors, run.events):
        stage().awaitTermination()

    stored = spark.read.parquet(run.table("events")).filter(F.col("source_ip") != queries.CLOSING_IP)
    want = rounded(queries.events_table(spark, folder))
    got = rounded(stored)
    assert first > 0
    assert got.count() == got.select("time", "source_ip").distinct().count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.text(run.table("alerts")).count() > 0


def test_messages_by_topic_equal_batch_and_a_replay_counts_once(spark, folder, tmp_path):
    run = MessageStreams(spark, str(tmp_path), SPARSE, FLOW_MODEL, "0 seconds", hosts=(HOST,))
    queries.packet_files(spark, folder, run.table("packets"))
    score = lambda: lambda df: df.withColumn("probability", logistic_score())
    run.run_once(score)
    stored = spark.read.parquet(run.table("events")).filter(F.col("source_ip") != queries.CLOSING_IP)
    want, got = rounded(queries.events_table(spark, folder)), rounded(stored)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    topics = {p.name for p in tmp_path.glob("topic=*")}
    assert topics == {"topic=live-network-flows", "topic=spatial-minhash-signatures", "topic=dns-queries"}

    # the batch was written, but the crash came before the checkpoint knew
    before = spark.read.parquet(run.table("posteriors")).count()
    for commit in (tmp_path / "_checkpoints/scored/commits").glob("*"):
        commit.unlink()
    run.scored(score).awaitTermination()
    run.posteriors().awaitTermination()
    assert spark.read.parquet(run.table("posteriors")).count() == before

    for query in run.telemetry():
        query.awaitTermination()
    for kind, columns in LOG_COLUMNS.items():
        log = spark.read.parquet(run.table(f"log-{kind}")).drop("batch")
        assert log.columns == columns and log.count() > 0
    flows = run.table("topic=live-network-flows")
    assert spark.read.parquet(run.table("log-residual")).count() == spark.read.parquet(flows).count()

    # what does not parse is kept aside
    spark.createDataFrame([("live-network-flows", "k", "{broken", None)], "topic string, key string, value string, timestamp timestamp").write.mode("append").parquet(str(tmp_path / "topic=x"))
    foreign = replace(run, root=str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "topic=x")).write.parquet(str(tmp_path / "other/topic=live-network-flows"))
    foreign.malformed("flows").awaitTermination()
    assert [r["value"] for r in spark.read.parquet(foreign.table("malformed-flows")).collect()] == ["{broken"]


def test_a_batch_is_written_once_and_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert write_once(spark.range(3), folder, 7)
    assert not write_once(spark.range(9), folder, 7)
    assert spark.read.parquet(folder).count() == 3
    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        write_once(broken, folder, 8)
    assert spark.read.parquet(folder).select("batch").distinct().count() == 1
    assert write_once(spark.range(2), folder, 8) and spark.read.parquet(folder).count() == 5


def flow_rows(spark, rows):
    return spark.createDataFrame(rows, "window_start string, source_ip string, t_vol double, n_req double, s_len double").withColumn(
        "window_start", F.col("window_start").cast("timestamp")
    )


@pytest.mark.parametrize(("days", "remembered"), [(3, False), (100, True)])
def test_a_silent_source_is_forgotten_after_the_ttl(spark, tmp_path, days, remembered):
    run = Streams(spark, str(tmp_path), replace(SPARSE, state_ttl_seconds=days * 86400), FLOW_MODEL, "0 seconds")
    parts = [
        [("2024-01-01", "quiet", 10.0, 1.0, 3.0), ("2024-01-02", "quiet", 90.0, 4.0, 1.0)],
        [("2024-01-20", "busy", 5.0, 2.0, 2.0)],
        [("2024-01-21", "quiet", 50.0, 9.0, 7.0)],
    ]
    for part in parts:
        flow_rows(spark, part).coalesce(1).write.mode("append").parquet(run.table("flows"))
        run.kinematics().awaitTermination()
    last = spark.read.parquet(run.table("kinematics")).filter("ts = '2024-01-21'").first()
    # a frame of one row has no residual
    assert (last["residual"] > 0) is remembered and (last["velocity"] > 0) is remembered


@pytest.mark.parametrize("buckets", [1, 1024])
def test_gaps_of_flows_that_share_a_bucket(spark, tmp_path, monkeypatch, buckets):
    """Gaps over three batches, with flows of null parts; memory ends after the TTL."""
    monkeypatch.setattr(state, "FLOW_BUCKETS", buckets)
    ttl, t0 = 3600, 1_700_000_000
    run = Streams(spark, str(tmp_path), replace(SPARSE, flow_ttl_seconds=ttl), FLOW_MODEL, "0 seconds")
    flows = [("a", 1, "x", 80), ("a", 2, "x", 80), (None, None, "x", 80), ("b", 1, "x", 80)]
    seen, want = {}, set()
    for part, starts in enumerate([(t0, t0 + 600), (t0 + 1200, t0 + 9000), (t0 + 9600, t0 + 9900)]):
        rows = []
        for i, flow in enumerate(flows):
            for at in starts:
                if part == 1 and i == 3:  # silent for longer than the TTL
                    continue
                first, last, n = at + i, at + 30 + i, 2 + i
                rows.append((at, *flow, first * 1_000_000, last * 1_000_000, n, i, part))
                known = flow in seen and at - seen[flow] <= ttl
                want.add((at, *flow, (last - first + (first - seen[flow] if known else 0)) * 1_000_000, n - 1 + known))
                seen[flow] = last
        spark.createDataFrame(rows, "at bigint, src_ip string, src_port int, dst_ip string, dst_port int, first_us bigint, last_us bigint, packets bigint, syn_count bigint, ack_count bigint").withColumn(
            "window_start", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(run.table("summaries"))
        run.gaps().awaitTermination()
    stored = spark.read.parquet(run.table("gaps")).withColumn("at", F.unix_timestamp("window_start"))
    got = [tuple(r) for r in stored.select("at", "src_ip", "src_port", "dst_ip", "dst_port", "gap_us", "gap_count").collect()]
    assert len(got) == len(want) and set(got) == want


def test_late_rows_are_counted_over_many_batches(spark, tmp_path):
    """More batches than a query's progress log keeps."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    run = Streams(spark, str(tmp_path), SPARSE, FLOW_MODEL, "0 seconds")
    batches = 105
    for i in range(batches):
        late = "'2020-01-01'" if i % 3 == 2 else f"'2024-01-01' + INTERVAL {i} HOURS"
        spark.sql(f"SELECT timestamp {late} AS ts UNION ALL SELECT timestamp '2024-01-01' + INTERVAL {i} HOURS" if i % 3 == 2 else f"SELECT timestamp '2024-01-01' + INTERVAL {i} HOURS AS ts").coalesce(1).write.parquet(str(tmp_path / f"in/{i:04}"))
    listener = run.late_rows()
    rows = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    counted = rows.withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 hour")).count()
    run.append(counted.select("count"), "counted").awaitTermination()
    for _ in range(50):  # progress is reported a little later
        found = listener.read(spark).agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]
        if found >= batches // 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert found == batches // 3


def test_a_published_model_takes_over_between_batches(spark, tmp_path):
    rows = spark.range(200).withColumn("label", (F.col("id") % 2).cast("int"))
    up = rows.select(*[(F.col("label") * 3.0 + (F.col("id") % 7) / 7.0).alias(c) for c in FEATURE_COLUMNS], "label")
    down = up.withColumn("label", 1 - F.col("label"))
    root = str(tmp_path / "models")
    run = Streams(spark, str(tmp_path), SPARSE, FLOW_MODEL, "0 seconds")
    current = models.CurrentModel(root)
    for version, labelled in ((1, up), (2, down)):
        models.publish(models.fit_classifier(labelled, [4], 30, validation_percent=0), root, version)
        window = up.filter("label = 1").limit(1).select(F.lit("2024-01-01").cast("timestamp").alias("time"), F.lit(f"s{version}").alias("source_ip"), *FEATURE_COLUMNS)
        window.write.mode("append").parquet(run.table("windows"))
        run.scored(current.scorer).awaitTermination()
    scored = {r["source_ip"]: r["prediction"] for r in spark.read.parquet(run.table("scored")).collect()}
    assert scored == {"s1": 1, "s2": 0}
