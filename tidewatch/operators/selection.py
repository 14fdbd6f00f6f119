"""Exact quantiles by distributed selection.

The numbers of a column are ordered like the 64-bit patterns they are stored in. A range
of patterns is halved by `DIGIT` bits at a time: every task counts its values by the next
digit of their pattern, the digit in which the wanted rank falls is kept, and after six
rounds one value is left. A round moves at most 2^DIGIT counts per column and quantile, so
no machine holds the values, and the answer is a value of the column, not an estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import staged

DIGIT = 11
SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; the two zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def value_of(bits: int) -> float:
    raw = np.array([bits], np.uint64)
    return float(np.where(raw & SIGN, raw ^ SIGN, ~raw).view(np.float64)[0])


def _count_digits(prefixes: Mapping[str, Sequence[int]], shift: int, width: int):
    """Counts of the next `width` bits above `shift`, of the values that begin with a prefix."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, wanted in prefixes.items():
                values = batch.column(name).drop_null().to_numpy()
                bits = ordered_bits(values[~np.isnan(values)])
                digits = (bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                above = bits >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(bits), np.uint64)
                for prefix in wanted:
                    counts = np.bincount(digits[above == prefix].astype(np.int64), minlength=1 << width)
                    totals[name, prefix] = totals.get((name, prefix), 0) + counts
        rows = [(n, p, int(d), int(c[d])) for (n, p), c in totals.items() for d in np.flatnonzero(c)]
        names, above, digits, counts = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch(
            {
                "name": pa.array(names, pa.string()),
                "prefix": pa.array([str(p) for p in above], pa.string()),
                "digit": pa.array(digits, pa.int32()),
                "n": pa.array(counts, pa.int64()),
            }
        )

    return counted


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """The value of rank ceil(p n) (at least 1) of each column, for each p.

    Nulls and NaN are left out; a column without other values gives None.
    """
    table = staged(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "selection")
    counts = table.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    # per column and quantile: the bits found so far and the rank among the values that share them
    found = {
        (c, i): (0, max(1, math.ceil(p * counts[c]))) for c in columns if counts[c] for i, p in enumerate(probabilities)
    }
    shift = 64
    while shift and found:
        width = min(DIGIT, shift)
        shift -= width
        prefixes: dict[str, list[int]] = {}
        for (c, _), (prefix, _) in found.items():
            if prefix not in prefixes.setdefault(c, []):
                prefixes[c].append(prefix)
        rows = (
            table.mapInArrow(_count_digits(prefixes, shift, width), "name string, prefix string, digit int, n bigint")
            .groupBy("name", "prefix", "digit")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        histogram: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in rows:
            histogram.setdefault((r["name"], int(r["prefix"])), []).append((r["digit"], r["n"]))
        for key, (prefix, rank) in found.items():
            for digit, n in sorted(histogram[key[0], prefix]):
                if rank <= n:
                    break
                rank -= n
            found[key] = (prefix << width | digit, rank)
    return {c: [value_of(found[c, i][0]) if (c, i) in found else None for i in range(len(probabilities))] for c in columns}
