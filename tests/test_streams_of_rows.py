"""Folds, trees and slices hold a bounded part of a key, however long it is."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.config import SPARSE
from tidewatch.operators import evaluate, ordering, scoring, spikes


def folded(probabilities, times, skips, p, posterior=None, seen=None):
    posterior = p.base_prior if posterior is None else posterior
    out = []
    for a, at, skip in zip(probabilities, times, skips):
        if skip:
            out.append(None)
            continue
        if seen is not None and at - seen > p.gap_seconds:
            posterior = max(posterior * p.decay ** math.floor((at - seen) / p.step_seconds), p.base_prior)
        a = min(max(a, 1e-5), 1 - 1e-5)
        posterior = a * posterior / (a * posterior + (1 - a) * (1 - posterior))
        seen = at
        out.append(posterior)
    return out


def scored(spark, n, step):
    return spark.range(n).select(
        F.when(F.col("id") % 1000 < 999, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source_ip"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * step).alias("time"),
        ((F.pmod(F.xxhash64("id"), F.lit(1000)) + 1) / 1300.0).alias("probability"),
        (F.col("id") % 11 == 3).alias("skip"),
    )


def test_posterior_of_a_million_rows_of_one_source(spark):
    n, step = 1_000_000, 7
    rows = scored(spark, n, step)
    got = scoring.sequential_posterior(rows, SPARSE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    hot = {r["id"]: r["posterior"] for r in got.filter("source_ip = 'hot'").select(
        ((F.unix_timestamp("time") - 1_700_000_000) / step).cast("bigint").alias("id"), "posterior").toLocalIterator()}
    ids = [i for i in range(n) if i % 1000 < 999]
    hashed = {r["id"]: r["probability"] for r in rows.filter("source_ip = 'hot'").select(
        ((F.unix_timestamp("time") - 1_700_000_000) / step).cast("bigint").alias("id"), "probability").toLocalIterator()}
    want = folded([hashed[i] for i in ids], [1_700_000_000.0 + i * step for i in ids], [i % 11 == 3 for i in ids], SPARSE)
    assert len(hot) == len(want)
    assert all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip((hot[i] for i in ids), want))


@pytest.mark.parametrize("cut", [1, 1500, 2999])
def test_posterior_goes_on_from_a_state(spark, cut):
    rows = scored(spark, 3000, 3 * int(SPARSE.gap_seconds)).withColumn("n", F.unix_timestamp("time"))
    at = 1_700_000_000 + cut * 3 * int(SPARSE.gap_seconds)
    whole = {(r["source_ip"], r["time"]): r["posterior"] for r in scoring.sequential_posterior(rows, SPARSE).collect()}
    first = scoring.sequential_posterior(rows.filter(F.col("n") < at), SPARSE)
    state = first.filter("posterior IS NOT NULL").groupBy("source_ip").agg(
        F.max_by("posterior", "time").alias("posterior"), F.max("n").cast("double").alias("seen")
    )
    both = [*first.collect(), *scoring.sequential_posterior(rows.filter(F.col("n") >= at), SPARSE, state).collect()]
    assert {(r["source_ip"], r["time"]): r["posterior"] for r in both} == whole


def test_posterior_of_awkward_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, None, False), ("a", 2, 0.9, False), (None, 1, 0.9, False), ("b", 1, 0.4, True), ("b", 2, 0.4, None)],
        "source_ip string, t bigint, probability double, skip boolean",
    ).select("source_ip", F.timestamp_seconds("t").alias("time"), "probability", "skip")
    got = {(r["source_ip"], r["time"].second): r["posterior"] for r in scoring.sequential_posterior(rows, SPARSE).collect()}
    assert len(got) == 5 and got[("a", 1)] is None and got[("b", 1)] is None
    assert got[("a", 2)] == got[(None, 1)] == folded([0.9], [1.0], [False], SPARSE)[0]
    assert scoring.sequential_posterior(rows.limit(0), SPARSE).collect() == []


@pytest.mark.parametrize(("block", "fan"), [(3, 3), (4, 2), (7, 5), (1000, 2)])
def test_spike_tree_of_several_levels(spark, block, fan):
    rng = random.Random(12)
    series = {k: [rng.choice([0.0, 0.1, 3.0]) for _ in range(n)] for k, n in (("hot", 500), ("cold", 40), (None, 9))}
    data = [(k, i, v) for k, values in series.items() for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(data, "key string, rn bigint, residual double").repartition(4)
    got = {(r["key"], r["rn"]) for r in spikes.spike_alerts(df, ["key"], 1.0, block, fan).collect()}
    want = set()
    for k, values in series.items():
        memory = []
        for i, v in enumerate(values, 1):
            memory = (memory + [v])[-3:]
            if len(memory) == 3 and abs(memory[2] - 2 * memory[1] + memory[0]) > 1.0:
                want.add((k, i))
                memory = []
    assert got == want


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_start_states_against_a_loop(spark, fan):
    rng = random.Random(fan)
    maps = {k: [[rng.randrange(4) for _ in range(4)] for _ in range(n)] for k, n in (("x", 131), ("y", 1), ("z", 16))}
    rows = [(k, i, m) for k, chain in maps.items() for i, m in enumerate(chain)]
    df = spark.createDataFrame(rows, "key string, block bigint, leads array<int>").repartition(5)
    starts = ordering.start_states(df, ["key"], "block", "leads", 4, 130, fan)
    got = {(r["key"], r["block"]): r["start"] for r in starts.collect()}
    want = {}
    for k, chain in maps.items():
        state = 0
        for i, m in enumerate(chain):
            want[(k, i)] = state
            state = m[state]
    assert got == want


def hot_day(spark, n):
    """Half of the rows have one key and one day."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id"), F.lit(80_000))).otherwise(F.col("id") * 997)).alias("ts"),
    )


def test_no_slice_holds_a_hot_key_and_day(spark):
    n, slice_rows = 40_000, 1000
    table = ordering.sliced(hot_day(spark, n), ["key"], [F.col("ts"), F.col("id")], n // slice_rows)
    sizes = [r["count"] for r in table.groupBy("_slice").count().collect()]
    assert sum(sizes) == n and max(sizes) < 3 * slice_rows


def test_numbers_across_slices(spark):
    df = hot_day(spark, 20_000)
    order = [F.col("ts"), F.col("id")]
    got = ordering.number_rows(df, ["key"], order, slice_rows=700).select("id", "rn")
    want = df.select("id", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint").alias("rn"))
    assert got.count() == 20_000 and got.exceptAll(want).count() == 0
    sums = ordering.running_totals(df, ["key"], order, {"total": F.col("id")}, slice_rows=700).select("id", "total")
    whole = df.select("id", F.sum("id").over(Window.partitionBy("key").orderBy(*order)).alias("total"))
    assert sums.exceptAll(whole).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-9])
def test_curve_on_any_scale(spark, scale):
    df = spark.range(6000).select(
        # half of the scores are the ends of the range, the rest lies close together
        F.when(F.col("id") % 4 == 0, -scale).when(F.col("id") % 4 == 1, scale)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 22) * scale).alias("score"),
        (F.pmod(F.hash("id"), F.lit(10)) < 3).cast("int").alias("actual"),
    )
    curve = evaluate.score_curve(df, "score", slice_rows=100)
    tp = fp = 0
    rows = {r["score"]: (r["tp"], r["fp"]) for r in curve.collect()}
    counts = {r["score"]: (r["pos"], r["neg"]) for r in df.groupBy("score").agg(
        F.count_if(F.col("actual") == 1).alias("pos"), F.count_if(F.col("actual") == 0).alias("neg")).collect()}
    for score in sorted(counts, reverse=True):
        tp, fp = tp + counts[score][0], fp + counts[score][1]
        assert rows[score] == (tp, fp)
    assert len(rows) == len(counts) > 2000
