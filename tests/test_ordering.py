"""Sliced and blocked operators against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.config import SPARSE
from tidewatch.functions.entropy import frame_entropies
from tidewatch.operators import evaluate, flows, learning, spatial, spikes, volumetric
from tidewatch.operators.ordering import number_rows, running_totals
from tidewatch.operators.volumetric import EntropyModel
from tidewatch.sources.tables import with_qname

MODEL = EntropyModel((1.0, 1.0, 1.0, 1.0, 1.0), (2.0, 1.0, 1.0, 1.0, 1.0), (0.1, 0.2, 0.3, 0.1, 0.1), 0.5)


def skewed(n=600):
    """Half of the rows belong to one key; one key is null."""
    rng = random.Random(1)
    keys = ["hot"] * 3 + ["a", "b", None]
    return [
        (rng.choice(keys), i, rng.randrange(10), float(rng.randrange(40)), float(rng.randrange(5)), rng.random())
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, at int, x int, t_vol double, n_req double, s_len double").repartition(5)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_running_totals(table, rows):
    got = running_totals(
        table, ["key"], [F.col("at")], {"rn": F.lit(1), "total": F.col("x")}, slice_rows=50
    )
    found = {(r["key"], r["at"]): (r["rn"], r["total"]) for r in got.collect()}
    assert len(found) == len(rows)
    for key, group in by_key(rows).items():
        total = 0
        for n, r in enumerate(group, 1):
            total += r[2]
            assert found[(key, r[1])] == (n, total)


def reference_kinematics(group, size, first):
    residuals, out = [], []
    for n in range(1, len(group) + 1):
        frame = group[max(0, n - size):n]
        velocity = acceleration = 0.0
        if n >= first:
            h = [float(frame_entropies(np.array([r[c] for r in frame]), np.array([len(frame)]), 10)[0]) for c in (3, 4, 5)]
            residuals.append(abs(h[0] - MODEL.predict(h[1], h[2])))
            memory = residuals[-3:]
            if len(memory) >= 2:
                velocity = abs(memory[-1] - memory[-2])
            if len(memory) == 3:
                acceleration = abs((memory[2] - memory[1]) - (memory[1] - memory[0]))
        out.append((velocity, acceleration))
    return out


@pytest.mark.parametrize(("size", "full"), [(5, False), (20, True)])
def test_trailing_kinematics_across_blocks(table, rows, size, full):
    numbered = number_rows(table.filter(F.col("key").isNotNull()), ["key"], [F.col("at")], slice_rows=64)
    got = volumetric.trailing_kinematics(numbered, ["key"], size, MODEL, full_frames_only=full, block=32)
    found = {(r["key"], r["at"]): (r["velocity"], r["acceleration"]) for r in got.collect()}
    for key, group in by_key(rows).items():
        if key is None:
            continue
        for r, want in zip(group, reference_kinematics(group, size, size if full else 2)):
            assert found[(key, r[1])] == pytest.approx(want, abs=1e-9)


def test_offline_rows_start_when_two_residuals_exist(table):
    numbered = number_rows(table.filter("key = 'hot'"), ["key"], [F.col("at")], slice_rows=64)
    extra = numbered.withColumns({c: F.lit(0.0) for c in ("iat_mean", "sa_ratio", "jaccard_score", "entropy_shannon")})
    got = volumetric.offline_features(extra, ["key"], 20, MODEL, F.lit(1))
    assert got.agg(F.min("rn")).first()[0] == 21
    first = got.filter("rn = 21").first()
    assert first["acceleration"] == 0.0


def test_lookback_must_fit_a_block(table):
    numbered = number_rows(table, ["key"], [F.col("at")])
    with pytest.raises(ValueError):
        volumetric.trailing_kinematics(numbered, ["key"], 20, MODEL, block=8)


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_spike_alerts_reset(spark, block):
    rng = random.Random(2)
    series = {k: [rng.choice([0.0, 0.1, 3.0]) for _ in range(n)] for k, n in (("hot", 400), ("cold", 30), ("tiny", 2))}
    data = [(k, i, v) for k, values in series.items() for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(data, "key string, rn bigint, residual double").repartition(4)
    got = {(r["key"], r["rn"]) for r in spikes.spike_alerts(df, ["key"], 1.0, block=block).collect()}
    want = set()
    for k, values in series.items():
        memory = []
        for i, v in enumerate(values, 1):
            memory = (memory + [v])[-3:]
            if len(memory) == 3 and abs(memory[2] - 2 * memory[1] + memory[0]) > 1.0:
                want.add((k, i))
                memory = []
    assert got == want


def reference_adjust(actual, predicted):
    adjusted, i = list(predicted), 0
    while i < len(actual):
        j = i
        while j < len(actual) and actual[j] == actual[i]:
            j += 1
        if actual[i] == 1 and any(predicted[i:j]):
            adjusted[i:j] = [1] * (j - i)
        i = j
    return adjusted


def test_point_adjust_known_case(spark):
    actual, predicted = [0, 1, 1, 1, 0, 1, 1], [1, 0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(zip(actual, predicted))), "at int, v struct<actual:int,predicted:int>")
    log = df.select("at", "v.*")
    blocks = evaluate.attack_blocks(log, [], [F.col("at")], 2)
    adjusted = [r["adjusted"] for r in evaluate.point_adjusted(blocks, []).orderBy("at").collect()]
    assert adjusted == [1, 1, 1, 1, 0, 0, 0]
    m = evaluate.point_adjusted_metrics(blocks).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (3, 1, 2, 1)


def test_point_adjust_against_brute_force(spark):
    rng = random.Random(6)
    data = [("hot" if i % 3 else "cold", i, int(rng.random() < 0.7), int(rng.random() < 0.2)) for i in range(500)]
    df = spark.createDataFrame(data, "log string, at int, actual int, predicted int").repartition(3)
    blocks = evaluate.attack_blocks(df, ["log"], [F.col("at")], 40)
    got = {r["at"]: r["adjusted"] for r in evaluate.point_adjusted(blocks, ["log"]).collect()}
    raw = {r["log"]: r["detection_rate"] for r in evaluate.confusion_metrics(df, ["log"]).collect()}
    for m in evaluate.point_adjusted_metrics(blocks, ["log"]).collect():
        mine = [d for d in data if d[0] == m["log"]]
        want = reference_adjust([d[2] for d in mine], [d[3] for d in mine])
        assert [got[d[1]] for d in mine] == want
        assert m["tp"] == sum(d[2] and w for d, w in zip(mine, want))
        assert m["detection_rate"] >= raw[m["log"]]


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "actual int, predicted int")
    m = evaluate.confusion_metrics(df).first()
    assert (m["detection_rate"], m["precision"], m["f1"], m["fpr"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("n", [0, 1, 37, 200, 1000])
def test_smallest_n_is_exact(spark, n):
    df = spark.range(300).withColumn("k", learning.order_key(F.col("id")))
    limit = spark.range(1).select(F.lit(n).cast("bigint")).scalar()
    got = {r["id"] for r in learning.smallest_n(df, F.col("k"), F.col("id"), limit).collect()}
    want = {r["id"] for r in df.orderBy("k", "id").limit(n).collect()}
    assert got == want


def test_smallest_n_with_repeated_rows(spark):
    """Copies share one hash bucket; the quota may end inside them."""
    df = spark.range(500).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("id"))
    limit = spark.range(1).select(F.lit(130).cast("bigint")).scalar()
    got = learning.smallest_n(df, learning.order_key(F.col("id")), F.col("id"), limit)
    assert got.count() == 130


def test_auc_against_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(2000).select(
        (F.pmod(F.hash("id"), F.lit(97)) / 97.0).alias("score"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 4, 1).otherwise(0).alias("actual"),
    )
    mine = evaluate.roc_auc(evaluate.score_curve(df, "score", slice_rows=10)).first()[0]
    ready = df.withColumn("label", F.col("actual").cast("double"))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(ready)
    assert mine == pytest.approx(theirs, abs=1e-9)


def test_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("-inf"),)], "v double")
    got = sorted(r[0] for r in volumetric.replace_infinite(df, ["v"]).collect())
    assert got == [1.0, 2.0, 2.0, 3.0]


def test_tumbling_drops_the_remainder(spark):
    df = spark.range(47).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("t_vol"))
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("t_vol")))
    got = volumetric.tumbling_entropy(df, ["key"], 20, series=["t_vol"]).collect()
    assert sorted(r["w"] for r in got) == [0, 1]
    assert got[0]["h_t_vol"] == pytest.approx(3.4683400536172693)


@pytest.fixture
def plain_joins(spark):
    """Joins shuffle both sides and nothing is planned anew."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_rows_outside_runs_spread_over_the_join(spark, plain_joins):
    log = spark.range(4000).select(
        F.col("id").alias("at"), (F.col("id") % 100 == 7).cast("int").alias("actual"), F.lit(1).alias("predicted")
    )
    blocks = evaluate.attack_blocks(log, [], [F.col("at")], 500)
    adjusted = evaluate.point_adjusted(blocks, [])
    assert adjusted.count() == 4000
    assert largest_share(adjusted.filter("adjusted >= 0")) < 0.25


def test_packets_without_a_page_spread_over_the_join(spark, folder, plain_joins):
    packets = spark.range(4000).select(
        F.col("id").alias("packet_id"), F.when(F.col("id") % 50 == 0, 17).otherwise(6).alias("proto")
    )
    named = with_qname(spark, folder, packets)
    assert named.count() == 4000
    assert named.filter("qname IS NOT NULL AND proto <> 17").count() == 0
    assert named.filter("qname IS NOT NULL").count() > 0
    assert largest_share(named) < 0.25


def test_sources_of_one_flood_spread_over_the_join(spark, plain_joins):
    packets = spark.range(4000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 2 * SPARSE.capture_seconds).alias("ts"),
        F.concat(F.lit("10.0."), F.floor(F.col("id") / 250), F.lit("."), F.col("id") % 250).alias("src_ip"),
        F.lit(SPARSE.target_port).alias("dst_port"),
        F.lit("192.0.2.1").alias("dst_ip"),
        F.lit(6).alias("proto"),
    )
    packets = packets.withColumns({"src_port": F.lit(1), "tcp_flags": F.lit(2), "length": F.lit(60)})
    scored = spatial.similarity_per_source(flows.packet_summary(packets, SPARSE), SPARSE)
    assert scored.count() == 2000  # the first window has no earlier signature
    assert largest_share(scored) < 0.4
