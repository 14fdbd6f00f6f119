import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import LIVE
from tidewatch.functions import entropy, network, rules
from tidewatch.functions.folds import scan
from tidewatch.operators.evaluate import ground_truth
from tidewatch.operators.spatial import address_hash, coefficients, jaccard_verdict
from tidewatch.operators.volumetric import chebyshev_multiplier


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("size", "bins"), [(2, 4), (3, 6), (4, 6), (5, 6), (20, 16), (1000, 200)])
def test_bin_count(size, bins):
    assert entropy.bin_count(size) == bins


RENYI = [
    ([1, 2], 1.0),
    ([1, 2, 3], 1.584962500721156),
    ([1, 2, 3, 4, 5], 2.321928094887362),
    ([1, 1, 1, 1, 100], 0.35769773033478575),
    ([1, 1, 50, 99, 100], 1.3576196310958195),
    ([3, 3, 3, 3, 3], 0.0),
    ([5, 5], 0.0),
    (list(range(1, 21)), 3.4683400536172693),
]


def test_renyi_known_answers(spark):
    rows = [(i, [float(v) for v in values]) for i, (values, _) in enumerate(RENYI)]
    df = spark.createDataFrame(rows, "i int, a array<double>")
    got = {r[0]: r[1] for r in df.select("i", entropy.renyi_of_frame(10)("a")).collect()}
    for i, (_, want) in enumerate(RENYI):
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_frame_without_values_has_no_entropy(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0, 2.0]), (3, [])], "i int, a array<double>").coalesce(1)
    got = {r[0]: r[1] for r in df.select("i", entropy.renyi_of_frame(10)("a")).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


def test_shannon_case(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0, 100.0],)], "a array<double>")
    assert df.select(entropy.renyi_of_frame(1)("a")).first()[0] == pytest.approx(0.7219280948873623)


def test_frame_entropy_equals_numpy_histogram():
    rng = np.random.RandomState(3)
    frames = [rng.choice(np.arange(0, 11) / 100, size=20) for _ in range(2000)]
    frames += [rng.randint(0, 50, size=n).astype(float) for n in rng.randint(1, 21, size=2000)]

    def reference(x):
        counts = np.histogram(x, bins=entropy.bin_count(len(x)))[0]
        share = counts[counts > 0] / len(x)
        return np.log2(np.sum(share**10)) / -9

    got = entropy.frame_entropies(np.concatenate(frames), np.array([len(f) for f in frames]), 10)
    np.testing.assert_allclose(got, [reference(f) for f in frames], atol=1e-12)


def test_bin_index_equals_numpy_histogram(spark):
    rng = np.random.RandomState(4)
    rows = []
    for i in range(400):
        x = rng.choice(np.arange(0, 11) / 100, size=20)
        rows += [(i, float(v), float(x.min()), float(x.max())) for v in x]
    df = spark.createDataFrame(rows, "i int, v double, lo double, hi double")
    got = df.groupBy("i", entropy.bin_index(F.col("v"), F.col("lo"), F.col("hi"), F.lit(16)).alias("b")).count()
    counted = {(r["i"], r["b"]): r["count"] for r in got.collect()}
    for i in range(400):
        x = [r[1] for r in rows if r[0] == i]
        want = np.histogram(x, bins=16)[0]
        assert [counted.get((i, b), 0) for b in range(16)] == list(want)


@pytest.mark.parametrize(
    ("domain", "want"),
    [
        ("google.com", 1.9182958340544896),
        ("www.github.com", 0.0),
        ("aaaa.com", 0.0),
        ("x7f3kq9z2b.net", 3.3219280948873626),
        (".hidden", 0.0),
        ("", 0.0),
        ("nodots", 2.2516291673878226),
        ("a\U0001f600\U0001f600.com", 0.9182958340544896),
    ],
)
def test_domain_entropy(spark, domain, want):
    assert one(spark, entropy.domain_entropy(F.lit(domain)))[0] == pytest.approx(want, abs=1e-12)


def test_cell_entropy_treats_nan_text_as_absent(spark):
    got = one(spark, entropy.cell_entropy(F.lit("NaN")), entropy.cell_entropy(F.lit(None).cast("string")))
    assert tuple(got) == (0.0, 0.0)


def test_dga_threshold_is_strict(spark):
    four_letters = "abcd.com"  # entropy exactly 2
    row = one(
        spark,
        entropy.dga_verdict(F.lit(four_letters), 2.0)["is_DGA"],
        entropy.dga_verdict(F.lit("x7f3kq9z2b.net"))["is_DGA"],
    )
    assert tuple(row) == (False, True)


def test_syn_ack_ratio(spark):
    rows = spark.createDataFrame([(4, 2), (4, 0), (0, 0)], "s bigint, a bigint")
    got = [r[0] for r in rows.select(network.syn_ack_ratio(F.col("s"), F.col("a"))).collect()]
    assert got == [2.0, 999.0, 0.0]


def test_addresses(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::", "1:2:3:4:5:6:7::"]
    bad = ["1.2.3", "256.1.1.1", "01.2.3.4", "Unknown", "1:2:3", "1::2::3", "", "1:2:3:4:5:6:7:8:9", ":1"]
    df = spark.createDataFrame([(x,) for x in good + bad], "ip string")
    got = [r[0] for r in df.filter(network.is_valid_ip(F.col("ip"))).collect()]
    assert sorted(got) == sorted(good)
    number = network.ipv4_to_long(F.lit("192.168.1.1"))
    assert tuple(one(spark, number, network.long_to_ipv4(number))) == (3232235777, "192.168.1.1")


def test_minhash_product_is_exact(spark):
    a, b = coefficients(128)[0]
    assert (a, b) == (3421126068, 1312958716)
    big = 4294967295
    got = one(
        spark,
        address_hash(F.lit(3232235777), F.lit(a), F.lit(b)),
        address_hash(F.lit(big), F.lit(a), F.lit(b)),
    )
    assert tuple(got) == (2225573699, (a * big + b) % 4294967311)


def test_jaccard_verdicts(spark):
    same, idle, other = ([1, 2, 3, 4], [-1] * 4, [1, 2, 3, 9])

    def verdict(x, y):
        arrays = [F.array(*[F.lit(v) for v in z]) if z else F.lit(None).cast("array<int>") for z in (x, y)]
        return one(spark, jaccard_verdict(*arrays).alias("v"))["v"]

    assert (verdict(same, same)["jaccard_score"], verdict(same, same)["status"]) == (1.0, "potentially malicious")
    assert (verdict(same, idle)["jaccard_score"], verdict(same, idle)["status"]) == (0.0, "idle")
    assert verdict(same, None)["status"] == "idle"
    assert (verdict(same, other)["matches"], verdict(same, other)["is_botnet"]) == (3, True)


def test_prior_adjustment(spark):
    got = one(spark, rules.adjust_prior(F.lit(0.5)), rules.adjust_prior(F.lit(0.95)))
    assert got[0] == pytest.approx(0.01) and got[1] == pytest.approx(0.16101694915)


def test_chebyshev(spark):
    got = one(spark, chebyshev_multiplier(0.01), chebyshev_multiplier(0.05))
    assert got[0] == pytest.approx(10.0) and got[1] == pytest.approx(4.472135955)


@pytest.mark.parametrize(
    ("values", "label"),
    [
        ((51, 11.0, 0.0, 0.0), "Stealth Port Scan (Reconnaissance Phase)"),
        ((50, 10.5, 0.0, 0.0), "Stealth SYN Flood (State Exhaustion)"),
        ((50, 10.0, 3.1, 0.4), "Slowloris (Application-Layer DoS)"),
        ((50, 10.0, 3.1, 0.0), "Normal"),
        ((50, 10.0, 3.0, 0.4), "Normal"),
    ],
)
def test_stealth_label_priority(spark, values, label):
    assert one(spark, rules.stealth_label(*[F.lit(v) for v in values], LIVE))[0] == label


@pytest.mark.parametrize(
    ("clock", "want"),
    [("17:00:00", 1), ("17:01:45", 0), ("17:05:00", 1), ("17:05:01", 0), ("17:05:00.5", 0), ("16:30:00", 0), ("12:00:00", 0)],
)
def test_ground_truth_edges(spark, clock, want):
    assert one(spark, ground_truth(F.lit(f"2024-05-01 {clock}").cast("timestamp")))[0] == want


def test_scan_chains_over_blocks(spark):
    items = F.sequence(F.lit(1), F.lit(1000)).cast("array<bigint>")
    states = scan(items, F.lit(0).cast("bigint"), lambda s, x: s + x, block=7)
    got = one(spark, states.alias("s"))["s"]
    assert got == [n * (n + 1) // 2 for n in range(1, 1001)]


def test_renyi_bounds():
    rng = np.random.RandomState(5)
    values = rng.rand(20 * 500)
    h = entropy.frame_entropies(values, np.full(500, 20), 10)
    assert (h >= 0).all() and (h <= math.log2(20)).all()
