"""Whitening against fractions, on awkward and on large vectors."""

import random

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, component string"
BIG = "vec_id bigint, embedding array<double>"


def vectors(seed=3, rows=60, d=5):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0.2 * k, 0.1 + 0.2 * k) for k in range(d)]) for i in range(rows)]
    out += [(100 + i, out[7][1]) for i in range(30)]  # a third are copies
    out += [(200, None), (201, [0.1, None, 0.2, 0.3, 0.4]), (202, [float("nan")] * d), (203, [float("inf")] + [0.0] * (d - 1))]
    out += [(204, []), (205, [0.5] * (d + 1))]
    return out


def checked(got, rows, most):
    n, v, want = whitening.brute_force([(i, c) for i, c in rows if c and len(c) == len(rows[0][1])], most)
    exact = np.array([[float(c) for c in row] for row in v])
    values, axes = np.linalg.eigh(exact)
    values, axes = values[::-1], axes[:, ::-1]
    assert {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == set(want)
    for r in got:
        deviation, centred = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == deviation
        assert abs(r["explained"] - values[k] / np.trace(exact)) < 1e-9
        along = np.array([float(c) for c in centred]) @ axes[:, k] / values[k] ** 0.5
        assert abs(abs(r["whitened"]) - abs(along)) < 1e-6
        assert r["identity_error"] < 1e-9
    return n


def test_equals_fractions_without_polarisation(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, c, 1, 2, "z") for i, c in rows], SCHEMA).repartition(4)
    got = whitening.whitening_report(df).collect()
    assert checked(got, [(i, None if c is None else [None if v is None else float(np.float32(v)) for v in c]) for i, c in rows], 16) == 60
    assert len(got) == 90 * 5


def test_entries_beyond_machine_squares(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0**k for k in (0, 9, 9)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, BIG).repartition(3)).collect()
    n, v, want = whitening.brute_force(rows)
    assert all(r["deviation"] == want[r["vec_id"]][0] for r in got) and max(r["deviation"] for r in got) > 1 << 63
    assert whitening.moments(spark.createDataFrame(rows, BIG).select(whitening.grid("embedding").alias("x")))[2] == [
        [c * n * n for c in row] for row in v
    ]


def test_report_refuses_a_deviation_that_does_not_fit(spark):
    df = spark.createDataFrame([(i, [i * 1e9, -i * 2e9]) for i in range(20)], BIG)
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        whitening.whitening_report(df).collect()


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5]), (1, [0.5]), (None, [0.5])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitening_report(spark.createDataFrame(rows, BIG)).collect() == []


def test_flat_directions_null_and_repeated_ids(spark):
    rows = [(None, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]
    got = whitening.whitening_report(spark.createDataFrame(rows, BIG)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "None"]
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {3} and {r["explained"] for r in got} == {1.0}
