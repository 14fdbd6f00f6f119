"""Selection by digits against sorting, and against Spark's own exact form."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.selection import exact_quantiles, ordered_bits, value_of

PS = [0.0, 0.25, 0.5, 0.75, 1.0]


def test_patterns_keep_the_order():
    import numpy as np

    values = np.array([-math.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf])
    bits = ordered_bits(values)
    assert all(a < b for a, b in zip(bits.tolist(), bits.tolist()[1:])) is False  # the zeros are equal
    assert sorted(bits.tolist()) == bits.tolist() and bits[4] == bits[5]
    assert [value_of(int(b)) for b in bits] == values.tolist()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_against_sorting(spark, n):
    rng = random.Random(n)
    wild = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(n)]
    rows = [(w, float(rng.randrange(3)), rng.gauss(0, 1) * 10 ** rng.randrange(-5, 9)) for w in wild]
    df = spark.createDataFrame(rows + [(None, None, None)], "a double, b double, c double").repartition(3)
    got = exact_quantiles(df, ["a", "b", "c"], PS)
    for k, c in enumerate("abc"):
        values = sorted(r[k] for r in rows if not math.isnan(r[k]))
        assert got[c] == [values[max(1, math.ceil(p * len(values))) - 1] for p in PS]


def test_against_spark(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7.0 - 300).alias("v"))
    assert exact_quantiles(df, ["v"], PS)["v"] == df.approxQuantile("v", PS, 0.0)


def test_nothing_to_select(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
