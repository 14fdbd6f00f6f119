"""Flow, scoring and learning steps against hand-made cases and plain Python."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch.config import LIVE
from tidewatch.operators import features, flows, learning, scoring, spatial
from tidewatch.plans import detection
from tidewatch.sinks.events import read_events
from tidewatch.sources.schemas import FEATURE_COLUMNS

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
PACKET = "packet_id bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, tcp_flags int, length int"


def traffic(n=1500):
    """Packets of a few flows; one of them sends more than half of all packets."""
    rng = random.Random(3)
    out, now = [], 0.0
    for i in range(n):
        now += rng.choice([0.01, 0.3, 1.0, 1.0, 45.0])
        hot = rng.random() < 0.6
        src = "10.0.0.1" if hot else f"10.0.0.{rng.randrange(2, 6)}"
        out.append((i, T0 + dt.timedelta(seconds=now), src, "192.168.0.1", 4000 if hot else rng.randrange(4000, 4003),
                    80 if hot else rng.choice([80, 443]), 6, rng.choice([2, 16, 18, 4]), rng.randrange(40, 1500)))
    return out


def reference_flows(packets, p):
    """The live loop: one pass per capture window, state dropped when a window closes."""
    def window(ts):
        seconds = ts.timestamp()
        return math.floor(seconds / p.capture_seconds) * p.capture_seconds

    last, rows, spread = {}, {}, {}
    current = None
    for _, ts, src, dst, sport, dport, _, flags, _ in packets:
        w = window(ts)
        if w != current:
            # a window that starts later than the TTL after a packet has forgotten it
            last = {k: v for k, v in last.items() if w - v <= p.flow_ttl_seconds}
            current = w
        row = rows.setdefault((w, src), {"ports": set(), "syn": 0, "ack": 0, "iats": []})
        row["ports"].add(dport)
        row["syn"] += bool(flags & 2)
        row["ack"] += bool(flags & 16)
        key = (src, sport, dst, dport)
        if key in last:
            row["iats"].append(ts.timestamp() - last[key])
        last[key] = ts.timestamp()
    return rows


def test_flow_rows_match_the_packet_loop(spark):
    packets = traffic()
    df = spark.createDataFrame(packets, PACKET).repartition(6)
    got = {(r["window_start"].timestamp(), r["source_ip"]): r for r in flows.flow_rows(flows.packet_summary(df, LIVE), LIVE).collect()}
    want = reference_flows(packets, LIVE)
    assert set(got) == {(float(w), ip) for w, ip in want}
    for (w, ip), x in want.items():
        r = got[(float(w), ip)]
        assert (r["unique_ports"], r["syn_count"], r["ack_count"], r["iat_count"]) == (len(x["ports"]), x["syn"], x["ack"], len(x["iats"]))
        assert r["iat_sum"] == pytest.approx(sum(x["iats"]), abs=1e-4)


def test_packet_gaps_add_up_to_the_flow_counters(spark):
    df = spark.createDataFrame(traffic(), PACKET)
    per_packet = flows.packet_gaps(df, LIVE).agg(F.sum("iat"), F.count("iat")).first()
    per_flow = flows.source_counters(flows.flow_summaries(df, LIVE), LIVE).agg(F.sum("iat_sum"), F.sum("iat_count")).first()
    assert per_packet[1] == per_flow[1]
    assert per_packet[0] == pytest.approx(per_flow[0], abs=1e-3)


def test_signatures_ignore_order_and_copies(spark):
    df = spark.createDataFrame(traffic(300), PACKET)
    p = replace(LIVE, capture_seconds=60)
    one = spatial.signatures(spatial.port_sources(df, p), p)
    two = spatial.signatures(spatial.port_sources(df.unionByName(df).repartition(7), p), p)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_similarity_needs_the_adjacent_window(spark):
    p = replace(LIVE, capture_seconds=10)

    def hits(second, hosts):
        return [(second * 100 + h, T0 + dt.timedelta(seconds=second), f"10.0.0.{h}", "192.168.0.1", 1, 80, 6, 2, 60) for h in hosts]

    rows = hits(0, [1, 2, 3]) + hits(10, [1, 2, 3]) + hits(20, [1, 2]) + hits(40, [1, 2, 3]) + hits(50, [7, 8, 9])
    df = spark.createDataFrame(rows, PACKET)
    scores = {r["window_start"]: r for r in spatial.signature_similarity(
        spatial.signatures(spatial.port_sources(df, p), p), spatial.first_capture_window(df, p), p).collect()}
    at = lambda s: scores.get(T0 + dt.timedelta(seconds=s))
    assert at(0) is None
    assert (at(10)["jaccard_score"], at(10)["is_botnet"]) == (1.0, True)
    assert (at(20)["jaccard_score"], at(20)["status"]) == (0.0, "too few sources")
    assert (at(40)["jaccard_score"], at(40)["status"]) == (0.0, "idle")
    assert at(50)["jaccard_score"] < 0.2
    log = spatial.similarity_log(df, p)
    assert [r["jaccard_score"] for r in log.orderBy("window_start").collect()][:3] == [1.0, 0.0, 0.0]
    assert log.count() == 5


def test_similarity_log_spans_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SPINE_CHUNK", 4)
    p = replace(LIVE, capture_seconds=10)
    rows = [(i, T0 + dt.timedelta(seconds=s), "10.0.0.1", "192.168.0.1", 1, 80, 6, 2, 60) for i, s in enumerate((3, 205))]
    log = spatial.similarity_log(spark.createDataFrame(rows, PACKET), p).orderBy("window_start").collect()
    assert [r["window_start"] for r in log] == [T0 + dt.timedelta(seconds=10 * i) for i in range(1, 21)]


def window_row(ip, seconds, probability, **changes):
    values = dict(velocity=1.0, acceleration=0.0, iat_mean=0.5, sa_ratio=1.0, jaccard_score=0.0, entropy_shannon=0.0)
    values.update(changes)
    return (T0 + dt.timedelta(seconds=seconds), ip, *[values[c] for c in FEATURE_COLUMNS], probability)


SCORED = "time timestamp, source_ip string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", probability double"


def reference_posteriors(rows, p):
    belief, seen, out = {}, {}, {}
    for time, ip, *_, probability in sorted(rows):
        now, prior = time.timestamp(), belief.get(ip, p.base_prior)
        if ip in seen and now - seen[ip] > p.gap_seconds:
            prior = max(prior * p.decay ** int((now - seen[ip]) / p.step_seconds), p.base_prior)
        a = min(max(probability, 1e-5), 1 - 1e-5)
        belief[ip] = a * prior / (a * prior + (1 - a) * (1 - prior))
        seen[ip] = now
        out[(ip, time)] = belief[ip]
    return out


def test_posterior_known_answers(spark):
    rows = [window_row("a", s, q) for s, q in ((0, 0.95), (10, 0.95), (20, 0.95), (140, 0.1))]
    got = scoring.verdicts(spark.createDataFrame(rows, SCORED), LIVE).orderBy("time").collect()
    want = [0.16101694915, 0.78478260870, 0.98577177350, 0.11241057993]
    assert [r["probability"] for r in got] == pytest.approx(want, abs=1e-9)
    assert [r["prediction"] for r in got] == [0, 0, 1, 0]


def test_posterior_of_a_long_busy_source(spark):
    """Sticks at 1.0 exactly as the running update does, also over many blocks."""
    rng = random.Random(4)
    rows, now = [], 0
    for i in range(1500):
        now += rng.choice([10, 10, 10, 10, 40])
        rows.append(window_row("hot", now, rng.choice([0.05, 0.6, 0.99])))
    rows += [window_row(f"c{i}", 10 * j, rng.random()) for i in range(20) for j in range(5)]
    got = scoring.verdicts(spark.createDataFrame(rows, SCORED).repartition(4), LIVE).collect()
    want = reference_posteriors(rows, LIVE)
    assert len(got) == len(rows)
    for r in got:
        assert r["probability"] == pytest.approx(want[(r["source_ip"], r["time"])], abs=1e-12)
        assert 0.0 <= r["probability"] <= 1.0


def test_posterior_without_gaps_is_a_sum_of_logits(spark):
    rows = [window_row("a", 10 * i, 0.3 + 0.05 * i) for i in range(8)]
    got = scoring.verdicts(spark.createDataFrame(rows, SCORED), LIVE).orderBy("time").collect()
    logit = math.log(0.01 / 0.99)
    for row, r in zip(rows, got):
        logit += math.log(row[-1] / (1 - row[-1]))
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)


def test_quiet_rows_leave_the_posterior_alone(spark):
    quiet = dict(velocity=0.0, iat_mean=0.0, sa_ratio=1.2, entropy_shannon=2.4)
    rows = [window_row("a", 0, 0.95), window_row("a", 10, 0.95, **quiet), window_row("a", 14, 0.95)]
    rows += [window_row("b", 0, 0.95, **{**quiet, "sa_ratio": 1.3})]
    got = {(r["source_ip"], r["time"]): r for r in scoring.verdicts(spark.createDataFrame(rows, SCORED), LIVE).collect()}
    passed = got[("a", T0 + dt.timedelta(seconds=10))]
    assert (passed["probability"], passed["prediction"], passed["quiet"]) == (0.0, 0, True)
    assert got[("a", T0 + dt.timedelta(seconds=14))]["probability"] == pytest.approx(0.78478260870)
    assert got[("b", T0)]["probability"] == pytest.approx(0.16101694915)


def test_guardrail_edges_and_hosts(spark):
    rows = [
        window_row("at", 0, 0.5, sa_ratio=10.0, velocity=3.0, acceleration=3.0),
        window_row("sa", 0, 0.5, sa_ratio=10.1),
        window_row("ent", 0, 0.5, entropy_shannon=3.0),
        window_row("jac", 0, 0.5, jaccard_score=0.7),
        window_row("127.0.0.1", 0, 0.99),
        window_row("me", 0, 0.99),
    ]
    got = {r["source_ip"]: r["probability"] for r in scoring.verdicts(spark.createDataFrame(rows, SCORED), LIVE, ["me"]).collect()}
    assert set(got) == {"at", "sa", "ent", "jac"}
    assert got["at"] == pytest.approx(0.01)
    assert got["sa"] == got["ent"] == got["jac"] == pytest.approx(0.16101694915)


def test_day_by_day_scoring_equals_one_run(spark, tmp_path):
    rng = random.Random(8)
    rows = [window_row(ip, 3600 * h, rng.random()) for ip in ("a", "b") for h in range(60) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, SCORED)
    p = replace(LIVE, gap_seconds=7200, step_seconds=3600)
    detection.score_by_day(df, str(tmp_path / "events"), p)
    stored = read_events(spark, str(tmp_path / "events"))
    assert stored.select("ingest_batch_id").distinct().count() == 3
    whole = {(r["source_ip"], r["time"]): r["probability"] for r in scoring.verdicts(df, p).collect()}
    for r in stored.collect():
        assert r["probability"] == pytest.approx(whole.pop((r["source_ip"], r["time"])), abs=1e-12)
    assert not whole


def test_alert_text(spark):
    df = spark.createDataFrame(
        [(T0, "10.0.0.9", 0.98577, 1), (T0, "low", 0.89, 1)], "time timestamp, source_ip string, probability double, prediction int"
    )
    assert [r["line"] for r in scoring.alerts(df, LIVE).collect()] == [
        "[2024-05-01 12:00:00] ALERT: Malicious Traffic from 10.0.0.9 (Prob: 98.58%)"
    ]


def test_roll_up_uses_ratio_of_sums_and_keeps_unknown_analyzers(spark):
    rows = [
        (T0, "a", "stealth", None, None, 9, 1, 4.0, 1, None, None),
        (T0, "a", "stealth", None, None, 1, 9, 0.0, 3, None, None),
        (T0, "a", "volumetric", 0.2, 0.1, None, None, None, None, None, None),
        (T0, "a", "volumetric", 0.7, 0.0, None, None, None, None, None, None),
        (T0, "b", "other", 5.0, None, None, None, None, None, None, None),
        (T0, "Unknown", "dns", None, None, None, None, None, None, None, 4.0),
    ]
    schema = "ts timestamp, source_ip string, analyzer string, velocity double, acceleration double, syn_count bigint, ack_count bigint, iat_sum double, iat_count bigint, jaccard_score double, entropy_shannon double"
    got = {r["source_ip"]: r for r in features.roll_up(spark.createDataFrame(rows, schema), LIVE).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["sa_ratio"], a["iat_mean"], a["velocity"], a["acceleration"]) == (1.0, 1.0, 0.7, 0.1)
    assert all(got["b"][c] == 0.0 for c in FEATURE_COLUMNS)


@pytest.mark.parametrize(
    ("benign", "attacks", "want"), [(999, 50, (0, 0)), (1000, 1500, (1000, 1000)), (1000, 400, (1000, 400))]
)
def test_balance_gate(spark, benign, attacks, want):
    df = spark.range(benign + attacks).withColumn("label", (F.col("id") >= benign).cast("int"))
    counts = {r["label"]: r["n"] for r in learning.class_counts(learning.balanced(df, "id", LIVE)).collect()}
    assert (counts.get(0, 0), counts.get(1, 0)) == want


def test_batch_across_the_snapshot_waits_as_a_whole(spark):
    t = lambda hour: dt.datetime(2024, 1, 2, hour)
    values = {c: 0.0 for c in FEATURE_COLUMNS}
    rows = [(1, t(1)), (1, t(9)), (2, t(2))]
    events = spark.createDataFrame(
        [{"ingest_batch_id": b, "time": at, "source_ip": "a", "is_host_ip": False, "probability": 0.99, "prediction": 1, **values} for b, at in rows]
    )
    ledger = spark.createDataFrame([], "ingest_batch_id bigint")
    early, late = (F.lit(t(h)).cast("timestamp") for h in (5, 10))
    assert [r[0] for r in learning.processed_batches(events, ledger, early, LIVE).collect()] == [2]
    assert learning.sanitized_batch(events, ledger, early, LIVE).count() == 1
    done = learning.processed_batches(events, ledger, early, LIVE)
    assert learning.sanitized_batch(events, done, late, LIVE).count() == 2


def test_other_protocols_do_not_count_in_totals(spark):
    packets = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), 100, 6), (dt.datetime(2024, 1, 1), 50, 17), (dt.datetime(2024, 1, 1), 1000, 1)],
        "ts timestamp, length int, proto int",
    )
    row = flows.window_totals(packets, LIVE).first()
    assert row["t_vol"] * LIVE.capture_seconds == 150 and row["n_req"] * LIVE.capture_seconds == 2


def test_ledger_marks_every_pending_batch_but_only_after_a_selection(spark):
    def events(probability):
        return spark.createDataFrame(
            [(T0, "a", 1, probability, 0), (T0, "b", 2, 0.5, 0), (T0 + dt.timedelta(days=2), "c", 3, 0.0, 0), (T0, "d", 4, 0.0, 0)],
            "time timestamp, source_ip string, ingest_batch_id bigint, probability double, prediction int",
        ).withColumns({c: F.lit(0.0) for c in FEATURE_COLUMNS})

    ledger = spark.createDataFrame([(4,)], "ingest_batch_id bigint")
    now = F.lit(T0 + dt.timedelta(days=1))
    picked = learning.sanitized_batch(events(0.9), ledger, now, LIVE)
    assert [r["source_ip"] for r in picked.collect()] == ["a"]
    marks = learning.processed_batches(events(0.9), ledger, now, LIVE)
    assert sorted(r[0] for r in marks.collect()) == [1, 2]
    assert learning.processed_batches(events(0.5), ledger, now, LIVE).count() == 0


def test_scaling_keeps_constant_columns_finite(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    got = learning.scaled(df, learning.scaling_stats(df, ["x", "y"]), ["x", "y"]).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_packets_are_read_once_for_flows_and_similarity(spark, folder):
    """Everything but the name queries comes from the summary's table."""
    from tidewatch.catalog import queries

    frame = queries.REGISTRY["unified_features"](spark, folder)
    scans = [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line]
    assert sum("event_id" in line for line in scans) <= 1  # name queries
