"""Sources and sinks over files written by the tests themselves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.parameters import FLOW_MODEL
from tidewatch.config import LIVE, SPARSE
from tidewatch.operators import learning, models, reports
from tidewatch.plans import evaluation, learning_loop, offline
from tidewatch.sinks import events as event_sink
from tidewatch.sinks import messages as message_sink
from tidewatch.sources import files, frames, messages
from tidewatch.sources.schemas import FEATURE_COLUMNS

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


def as_messages(spark, values, topic=messages.FLOW_TOPIC):
    return spark.createDataFrame([(topic, "k", v, T0) for v in values], messages.MESSAGES)


def test_flow_messages_with_defaults_and_malformed_rows(spark):
    df = as_messages(spark, ['{"Source_IP":"1.1.1.1","T_vol":1.5,"N_req":2,"S_len":3,"syn_count":4}', '{"T_vol":1', "not json", '{"T_vol":2.0}'])
    got = messages.decode_flows(df).orderBy("t_vol").collect()
    assert [(r["source_ip"], r["t_vol"], r["syn_count"], r["ack_count"]) for r in got] == [("1.1.1.1", 1.5, 4, 0), ("Unknown", 2.0, 0, 0)]
    assert messages.malformed(df, messages.FLOW_MESSAGE).count() == 2


def test_signature_and_dns_messages(spark):
    sig = as_messages(spark, ['{"timestamp":5.0,"target_port":80,"signature":[1,2],"source_ips":["a"]}', '{"target_port":0,"signature":[1]}', '{"target_port":80,"signature":[]}', '{"signature":[1]}'])
    got = messages.decode_signatures(sig).collect()
    assert len(got) == 1 and got[0]["signature"] == [1, 2] and got[0]["source_ips"] == ["a"]
    dns = as_messages(spark, ['[{"timestamp":1.5,"source_ip":"a","domain":"x.com"},{"timestamp":2.0,"domain":"y.com"}]', "[]", "junk"])
    assert sorted((r["source_ip"], r["domain"]) for r in messages.decode_dns(dns).collect()) == [("Unknown", "y.com"), ("a", "x.com")]


def test_float_signatures_and_the_number_of_sources_survive(spark):
    floats = as_messages(spark, ['{"timestamp":5.0,"target_port":80,"signature":[123.0,5.0,-1.0],"source_ips":["a","b"]}'])
    row = messages.decode_signatures(floats).first()
    assert row["signature"] == [123, 5, -1] and row["n_sources"] == 2
    rows = spark.createDataFrame([(T0, 80, [7, 8], 4)], "window_start timestamp, target_port int, signature array<bigint>, n_sources bigint")
    back = messages.decode_signatures(message_sink.encode_signatures(rows)).first()
    assert (back["signature"], back["n_sources"]) == ([7, 8], 4)


def test_dns_messages_that_do_not_parse_are_kept_aside(spark):
    sent = as_messages(spark, ['[{"timestamp":1.5,"domain":"x.com"}]', "[]", "junk"])
    assert [r["value"] for r in messages.malformed_dns(sent).collect()] == ["junk"]


def test_feature_messages_round_trip(spark):
    rows = spark.createDataFrame([(T0, "a", 0.5, 0.25)], "ts timestamp, source_ip string, velocity double, acceleration double")
    sent = message_sink.encode_features(rows, "volumetric")
    back = messages.decode_features(sent).first()
    assert (back["source_ip"], back["analyzer"], back["velocity"], back["jaccard_score"]) == ("a", "volumetric", 0.5, None)


def test_topics_are_dispatched_and_published(spark, tmp_path):
    both = as_messages(spark, ["{}"]).unionByName(as_messages(spark, ["[]"], messages.DNS_TOPIC))
    message_sink.publish_batch(both, "parquet", {}, str(tmp_path / "m"))
    stream = messages.subscribe(spark, "parquet", {}, str(tmp_path / "m"))
    q = message_sink.publish_stream(messages.of_topic(stream, messages.DNS_TOPIC), "parquet", {}, str(tmp_path / "c"), str(tmp_path / "out"))
    q.awaitTermination()
    assert [r["topic"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [messages.DNS_TOPIC]
    assert messages.kafka_options("b:9092", ["x", "y"])["subscribe"] == "x,y"


def write_recording(path, n, start=0, header="flow_byts_s,flow_pkts_s,pkt_len_mean,iat_mean,syn_ack_ratio,Domain"):
    lines = [header]
    for i in range(start, start + n):
        lines.append(f"{(i * 37) % 101}.5,{(i * 17) % 23}.0,{(i * 7) % 13}.25,0.5,1.0,{'google.com' if i % 2 else 'nan'}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_recordings_to_labelled_features(spark, tmp_path, capsys):
    benign = write_recording(tmp_path / "benign.csv", 60)
    attack = write_recording(tmp_path / "attack.csv", 45, 7)
    raw = files.read_labelled(spark, [benign, str(tmp_path / "absent.csv")], [attack])
    assert "absent.csv" in capsys.readouterr().out
    data = offline.feature_dataset(raw, LIVE, FLOW_MODEL).collect()
    assert sum(r["label"] == 0 for r in data) == 40 and sum(r["label"] == 1 for r in data) == 25
    assert {round(r["entropy_shannon"], 6) for r in data} == {0.0, 1.918296}
    assert {r["iat_mean"] for r in data} == {0.5}


def test_recorded_names_and_flag_counts(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("Flow Byts/s,Flow Pkts/s,SYN Flag Cnt,ACK Flag Cnt\n10,2,3,0\n20,4,3,2\n")
    raw = files.read_csv(spark, [str(path)])
    picked = files.feature_columns(raw, files.RECORDED_NAMES)
    got = raw.select(*[c.alias(n) for n, c in picked.items()]).orderBy("t_vol").collect()
    assert [(r["t_vol"], r["s_len"], r["sa_ratio"], r["entropy_shannon"]) for r in got] == [(10.0, 0.0, 999.0, 0.0), (20.0, 0.0, 1.5, 0.0)]


def test_gzip_recording_and_log_lines(spark, tmp_path):
    spark.createDataFrame([(1.0,)], "T_vol double").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "z"))
    assert files.read_csv(spark, [str(tmp_path / "z")]).count() == 1
    (tmp_path / "alerts.log").write_text("one\n\n   \n two \n")
    assert sorted(r["line"] for r in files.read_log_lines(spark, str(tmp_path / "alerts.log")).collect()) == ["one", "two"]


def test_regression_training(spark, tmp_path):
    raw = files.read_csv(spark, [write_recording(tmp_path / "capture.csv", 2000)])
    model, stats = offline.train_regression(raw, LIVE)
    assert len(model.weights) == 5 and all(s > 0 for s in model.scale)
    row = stats.first()
    assert row["mean_train"] >= 0 and row["mean_t_vol"] == pytest.approx(50.5, abs=1)


def event_rows(spark, n=10, days=2):
    base = spark.range(n).select(
        (F.lit(T0) + F.make_dt_interval(days=(F.col("id") % days).cast("int"), secs=F.col("id"))).alias("time"),
        F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("source_ip"),
        F.lit("aggregated").alias("analyzer"),
        F.lit(None).cast("boolean").alias("is_host_ip"),
        *[(F.col("id") * 1.0).alias(c) for c in FEATURE_COLUMNS],
        (F.col("id") / n).alias("probability"),
        (F.col("id") % 2).cast("int").alias("prediction"),
    )
    return base


def test_events_are_idempotent_partitioned_and_checked(spark, tmp_path):
    path = str(tmp_path / "events")
    for _ in range(2):
        event_sink.write_events(event_rows(spark), path, 1)
    event_sink.write_events(event_rows(spark), path, 2)
    stored = event_sink.read_events(spark, path)
    assert stored.count() == 20
    assert stored.filter("is_host_ip IS NULL").count() == 0
    recent = stored.filter(event_sink.since(F.lit(T0 + dt.timedelta(days=1))))
    assert recent.count() == 10
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    as_of = F.lit(T0 + dt.timedelta(days=SPARSE.lookback_days + 1))
    for pruned in (learning.adaptive_rows(stored, as_of, SPARSE), reports.retained(stored, as_of, SPARSE.lookback_days)):
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan
    with pytest.raises(Exception, match="incomplete event row"):
        event_sink.write_events(event_rows(spark).withColumn("probability", F.lit(None).cast("double")), path, 3)


def test_retention_and_logs_and_rotation(spark, tmp_path):
    path = str(tmp_path / "events")
    event_sink.write_events(event_rows(spark), path, 1)
    files_before = {f: f.stat().st_mtime_ns for f in (tmp_path / "events").rglob("*.parquet")}
    days = sorted({r["date"] for r in event_sink.read_events(spark, path).select("date").collect()})
    as_of = F.lit(T0 + dt.timedelta(days=2))
    removed = event_sink.drop_expired(spark, path, as_of, 1)
    first = (T0 + dt.timedelta(days=1)).date()
    assert removed == [str(d) for d in days if d < first] and removed
    left = {f: f.stat().st_mtime_ns for f in (tmp_path / "events").rglob("*.parquet")}
    assert left == {f: t for f, t in files_before.items() if f in left}  # no kept file was written again
    kept = event_sink.read_events(spark, path).filter(event_sink.since(F.lit(T0 + dt.timedelta(days=1))))
    assert kept.count() == 5
    assert event_sink.drop_expired(spark, path, as_of, 1) == []
    log = spark.createDataFrame([(1.0, "a", 0.1, 0.2, 0.3)], "Timestamp double, Source_IP string, Residual double, Velocity double, Acceleration double")
    for _ in range(2):
        event_sink.append_log(log, "residual", str(tmp_path / "log"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    alerts = event_rows(spark).withColumn("line", F.col("source_ip"))
    event_sink.rotate_alerts(alerts, str(tmp_path / "alerts"), 3)
    assert files.read_log_lines(spark, str(tmp_path / "alerts")).count() == 3


def test_processed_batches_are_not_read(spark, tmp_path):
    path, ledger = str(tmp_path / "events"), str(tmp_path / "ledger")
    for batch in (1, 2, 3):
        event_sink.write_events(event_rows(spark), path, batch)
    event_sink.append_ledger(spark.createDataFrame([(1,), (3,)], "ingest_batch_id bigint"), ledger)
    waiting = learning.waiting_only(event_sink.read_events(spark, path), event_sink.read_ledger(spark, ledger))
    assert {r[0] for r in waiting.select("ingest_batch_id").distinct().collect()} == {2}
    plan = waiting._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_batch_id" in plan


def test_sanitize_run(spark, tmp_path):
    events, ledger, batch = (str(tmp_path / n) for n in ("events", "ledger", "batch"))
    event_sink.write_events(event_rows(spark), events, 1)
    spark.createDataFrame([], "ingest_batch_id bigint").write.parquet(ledger)
    later = F.lit(T0 + dt.timedelta(days=5))
    assert learning_loop.sanitize(spark, events, ledger, batch, later, LIVE)
    # 0.0, 0.1 and 0.9 are certain enough
    assert files.read_matrix(spark, batch).count() == 3
    assert not learning_loop.sanitize(spark, events, ledger, batch, later, LIVE)


def test_retrain_publish_and_swap(spark, tmp_path):
    from dataclasses import replace

    p = replace(LIVE, min_benign=40)
    x = spark.range(400).withColumn("label", (F.col("id") % 2).cast("int"))
    history = x.select(*[((F.col("id") % 7) / 7.0 + F.col("label") * 3.0).alias(c) for c in FEATURE_COLUMNS], "label")
    events = event_rows(spark, 10)
    root = str(tmp_path / "models")
    as_of = F.lit(T0 + dt.timedelta(days=3))
    assert learning_loop.retrain(history, events, as_of, LIVE, root, 1) is None
    current = models.CurrentModel(root)
    with pytest.raises(ValueError):
        current.refresh()
    path = learning_loop.retrain(history, events, as_of, p, root, 1, iterations=60)
    classifier = current.refresh()
    assert current.path == path
    scored = classifier.score(history)
    assert scored.filter("prediction = label").count() / 400 > 0.95
    assert scored.filter("probability < 0 OR probability > 1").count() == 0
    quality = offline.hold_out_quality(scored)
    assert quality["auc"].first()[0] > 0.95
    spark.range(1).select(F.lit(2).cast("bigint").alias("version"), F.lit(f"{root}/v=2").alias("path"), F.current_timestamp().alias("created")).write.mode("append").parquet(f"{root}/versions")
    assert current.refresh() is classifier and current.path == path


def test_training_loss_falls(spark):
    x = spark.range(200).withColumn("label", (F.col("id") % 2).cast("int"))
    rows = x.select(*[(F.col("label") * 2.0 + (F.col("id") % 5) / 5.0).alias(c) for c in FEATURE_COLUMNS], "label")
    history = models.training_history(models.fit_classifier(rows, [8], 20)).orderBy("iteration").collect()
    assert history[-1]["loss"] < history[0]["loss"]
    assert [r["iteration"] for r in history] == list(range(len(history)))


def noise(spark, n):
    """Features that say nothing about the label."""
    columns = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0).alias(c) for k, c in enumerate(FEATURE_COLUMNS)]
    return spark.range(n).select(*columns, F.pmod(F.xxhash64("id", F.lit(99)), F.lit(2)).cast("int").alias("label"))


def test_training_on_noise_stops_early_with_the_best_weights(spark):
    rows = noise(spark, 600)
    fitted = models.fit_classifier(rows, [16], iterations=500, patience=3, round_iterations=4)
    history = models.training_history(fitted).orderBy("iteration").collect()
    tried = [r["validation_accuracy"] for r in history if r["validation_accuracy"] is not None]
    assert 4 <= len(tried) and len(history) < 200
    assert max(tried[:-3]) >= max(tried[-3:]) - 1e-4
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in FEATURE_COLUMNS], "label")
    held = rows.filter(learning.in_test_split(identity, 10, models.VALIDATION_SEED))
    right = fitted.score(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right == pytest.approx(max(tried))


@pytest.mark.parametrize("rows", [12, 60])
def test_training_without_a_validation_part_runs_all_iterations(spark, rows):
    fitted = models.fit_classifier(noise(spark, rows), [4], iterations=6, validation_percent=0)
    history = models.training_history(fitted).collect()
    assert len(history) >= 2 and all(r["validation_accuracy"] is None for r in history)


def far_apart(spark, n):
    """Two classes on either side of a curve, with a tenth of the labels turned."""
    base = noise(spark, n).drop("label")
    a, b = F.col(FEATURE_COLUMNS[0]), F.col(FEATURE_COLUMNS[1])
    turned = F.pmod(F.xxhash64(*FEATURE_COLUMNS), F.lit(10)) == 0
    return base.withColumn("label", ((a + b > 10) != turned).cast("int"))


@pytest.mark.parametrize("validation", [0, 10])
def test_training_by_passes_reads_every_row_and_learns(spark, validation):
    rows = far_apart(spark, 6000).persist()
    fitted = models.fit_classifier(rows, [16, 8], iterations=40, validation_percent=validation, pass_rows=2000)
    history = models.training_history(fitted).orderBy("iteration").collect()
    assert len(history) <= 40 and history[-1]["loss"] < history[0]["loss"]
    scored = fitted.score(rows)
    assert scored.count() == 6000 and scored.filter("prediction = label").count() / 6000 > 0.85
    # the passes and Spark's network agree on the layout of the weights
    part = scored.limit(50).toPandas()
    x = (part[FEATURE_COLUMNS].to_numpy() - fitted.mean) / fitted.std
    layers = models._layers(fitted.network.weights.toArray(), [len(FEATURE_COLUMNS), 16, 8, 2])
    assert models._outputs(x, layers)[-1][:, 1] == pytest.approx(part["probability"].to_numpy(), abs=1e-9)
    if not validation:
        assert len(history) == 40
        return
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in FEATURE_COLUMNS], "label")
    held = scored.filter(learning.in_test_split(identity, 10, models.VALIDATION_SEED))
    right = held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right == pytest.approx(max(r["validation_accuracy"] for r in history))


def frame(spark, linktype, hexa):
    return spark.createDataFrame([(1, T0, linktype, bytearray.fromhex(hexa))], "packet_id bigint, ts timestamp, linktype int, frame binary")


IP_TCP = "4500002800000000400600000a000001c0a80001" + "9c400050" + "00" * 8 + "5012" + "00" * 6
ETH = "00" * 12


@pytest.mark.parametrize(
    ("linktype", "text", "want"),
    [
        (1, ETH + "0800" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (1, ETH + "81000001" + "0800" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (0, "02000000" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (108, "00000002" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (113, "00" * 14 + "0800" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (99, IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (99, ETH + "0800" + IP_TCP, ("10.0.0.1", 40000, 80, 18)),
        (1, ETH + "86dd" + "60" * 40, None),
        (1, ETH + "0800" + IP_TCP[:20], None),
        (1, "00", None),
        (1, ETH + "0800" + IP_TCP.replace("4500002800000000", "4500002800000010"), ("10.0.0.1", None, None, None)),
        (1, ETH + "0800" + IP_TCP[:60], ("10.0.0.1", None, None, None)),
    ],
)
def test_frame_decode(spark, linktype, text, want):
    got = frames.decode_frames(frame(spark, linktype, text)).collect()
    if want is None:
        assert got == []
    else:
        r = got[0]
        assert (r["src_ip"], r["src_port"], r["dst_port"], r["tcp_flags"]) == want
        assert r["length"] == len(text) // 2


def udp_dns(flags, body):
    return ETH + "0800" + "4500002800000000401100000a000001c0a80001" + "9c400035" + "00" * 4 + "0001" + flags + "0001" + "00" * 6 + body


@pytest.mark.parametrize(
    ("flags", "body", "want"),
    [
        ("0100", "03777777076578616d706c6503636f6d0000010001", "www.example.com"),
        ("8100", "03777777076578616d706c6503636f6d0000010001", None),
        ("0100", "0377", None),
        ("0100", "0000010001", None),
    ],
)
def test_dns_names(spark, flags, body, want):
    assert frames.decode_frames(frame(spark, 1, udp_dns(flags, body))).first()["qname"] == want


def test_log_quality(spark):
    rows = [(dt.datetime(2024, 5, 1, 17, 0, s), int(s == 30)) for s in range(60)] + [(dt.datetime(2024, 5, 1, 16, 30, s), 0) for s in range(60)]
    log = spark.createDataFrame(rows, "ts timestamp, hit int")
    m = evaluation.log_quality(log, "ts", F.col("hit") == 1).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"]) == (60, 60, 0, 0)
