"""Whitening of embeddings from variances alone.

Polarisation: cov(a, b) = (var(a + b) - var(a) - var(b)) / 2. Vectors are integers, so every
sum of squares is exact: tasks add up the squared centred values of each dimension and of
the sum of each pair of dimensions, the differences are taken in unbounded integers, and
only the finished covariance is rounded, once, for the eigenvectors.

What meets on the driver is one number per pair of dimensions, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import staged

STEPS = 64
OFFSET = 1_000_000
COMPONENTS = 16
# entries beyond this many steps have no place in a 64-bit vector
LARGEST = float(1 << 61)
# squares of values below this, added up over a chunk of rows, stay inside 64 bits
SMALL = 1 << 24
CHUNK = 2048
# an eigenvalue below this share of the largest is rounding
FLAT = 1e-12


def grid(vector: Column) -> Column:
    """The integer vector floor(64 c) + 1000000, or null if the vector is null or has an
    entry that is null, not finite or beyond 2^61 steps."""
    doubles = F.transform(vector, lambda c: c.cast("double") * STEPS)
    usable = F.forall(doubles, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(usable, F.transform(doubles, lambda c: F.floor(c) + F.lit(OFFSET).cast("bigint")))


def _matrix(column: pa.Array, center: np.ndarray | int = 0) -> np.ndarray:
    """Rows of a list column, less `center`: as 64-bit numbers, or unbounded ones if large."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - center
    return x if np.abs(x).max(initial=0) < SMALL else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and the sum of each dimension over a task's rows."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x")).sum(0).astype(object)
            n, total = n + batch.num_rows, x if total is None else total + x
    if total is not None:
        yield pa.record_batch(
            {
                "i": pa.array(range(len(total)), pa.int32()),
                "n": pa.array([n] * len(total), pa.int64()),
                "total": pa.array([str(v) for v in total]),
            }
        )


def _squares(center: np.ndarray):
    """Tasks' sums of squares: of dimension i for j = i, of the sum of i and j for j > i."""

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(center)
        total = [np.zeros(d - i, object) for i in range(d)]
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                z = np.ascontiguousarray(_matrix(batch.column("x").slice(start, CHUNK), center).T)
                for i in range(d):
                    pairs = z[i:] + z[i]
                    pairs[0] = z[i]
                    total[i] = total[i] + (pairs * pairs).sum(1)
        rows = [(i, i + k, str(v)) for i in range(d) for k, v in enumerate(total[i]) if v]
        yield pa.record_batch(
            {
                "i": pa.array([r[0] for r in rows], pa.int32()),
                "j": pa.array([r[1] for r in rows], pa.int32()),
                "total": pa.array([r[2] for r in rows], pa.string()),
            }
        )

    return squared


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the exact n^2 * covariance of the integer vectors `x`.

    The vectors must have one length. Sums are held as decimals of 38 digits.
    """
    total = F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    sums = fit.mapInArrow(_sums, "i int, n bigint, total string").groupBy("i").agg(F.sum("n").alias("n"), total).collect()
    if not sums:
        return 0, [], []
    n, s = sums[0]["n"], [0] * len(sums)
    for r in sums:
        s[r["i"]] = int(r["total"])
    d = len(s)
    # whole numbers next to the means; what is left of a centred value is put right below
    center = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    rest = [v - n * int(c) for v, c in zip(s, center)]
    squares = [[0] * d for _ in range(d)]
    for r in fit.mapInArrow(_squares(center), "i int, j int, total string").groupBy("i", "j").agg(total).collect():
        squares[r["i"]][r["j"]] = int(r["total"])
    # n^2 times the variance of one dimension, or of the sum of two
    variance = [
        [n * squares[i][j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2 if j >= i else 0 for j in range(d)] for i in range(d)
    ]
    # twice the covariance of two dimensions is even, as n * cross - rest * rest is whole
    v = [[0] * d for _ in range(d)]
    for i in range(d):
        v[i][i] = variance[i][i]
        for j in range(i + 1, d):
            v[i][j] = v[j][i] = (variance[i][j] - variance[i][i] - variance[j][j]) // 2
    return n, s, v


def components(n: int, v: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, and its trace.

    At most `most`, without those of a flat direction. The largest entry of a vector, the
    first of equals, is positive.
    """
    exact = np.array([[float(Fraction(x, n * n)) for x in row] for row in v], float).reshape(len(v), len(v))
    values, vectors = np.linalg.eigh(exact)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = (values > FLAT * max(values[0], 0.0))[:most].nonzero()[0] if len(values) else np.zeros(0, int)
    values, vectors = values[keep], vectors[:, keep]
    largest = np.abs(np.round(vectors, 12)).argmax(0) if len(keep) else np.zeros(0, int)
    return values, vectors * np.sign(vectors[largest, np.arange(len(keep))]), float(np.trace(exact))


def _whitened(z: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (z.astype(float) - rest) @ vectors / np.sqrt(values)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened,
    explained and identity_error.

    The covariance is that of the distinct integer vectors (see `grid`), n of them with sums S.
    deviation is the exact sum of (n x - S)^2 over the dimensions, as decimal(38,0); whitened
    is (x - S/n) along the component over the root of its eigenvalue, explained its share of
    the trace. identity_error is measured on the whitened distinct vectors.

    Rows with a null vector or unusable entries have no rows in the result, nor have rows whose
    length is not the commonest one (of equals the longest) or 0. Flat directions are no
    components, so fewer than two different vectors give no rows. Null and repeated ids are
    rows like others; other columns are not read.
    """
    source = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), grid(F.col(vector)).alias("x"))
    source = source.filter(F.col("x").isNotNull() & (F.size("x") > 0))
    lengths = source.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    names = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], names)
    source = source.filter(F.size("x") == lengths["d"])
    fit = staged(source.select("x").distinct(), "whitening-fit")
    n, s, v = moments(fit)
    values, axes, trace = components(n, v, most)
    center = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)
    rest = [t - n * int(c) for t, c in zip(s, center)]
    shift = np.array([float(Fraction(r, n)) for r in rest])
    k = len(values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(_matrix(batch.column("x"), center), shift, values, axes)
            total += np.vstack([w.T @ w, w.sum(0)])
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.record_batch({"i": at[0], "j": at[1], "total": total.ravel()})

    measured = np.zeros((k + 1, k))
    if k:
        for r in fit.mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("t")).collect():
            measured[r["i"], r["j"]] = r["t"] / n
    covariance = measured[:k] - np.outer(measured[k], measured[k]) if k else measured[:k]
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    explained = values / trace if k else values
    narrow = np.array(rest, np.int64)  # at most n / 2 each

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                z = _matrix(part.column("x"), center)
                bound = n * (int(np.abs(z).max(initial=0)) + 1)
                wide = z * n - narrow if bound * bound * len(rest) < 1 << 62 else z.astype(object) * n - np.array(rest, object)
                deviation = (wide * wide).sum(1)
                w = _whitened(z, shift, values, axes)
                rows = np.repeat(np.arange(part.num_rows), k)
                yield pa.record_batch(
                    {
                        "vec_id": part.column("vec_id").take(pa.array(rows)),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows),
                        "deviation": pa.array([str(x) for x in deviation]).take(pa.array(rows)),
                        "whitened": w.ravel(),
                        "explained": np.tile(explained, part.num_rows),
                    }
                )

    return source.mapInArrow(
        projected, "vec_id bigint, component int, deviation string, whitened double, explained double"
    ).select(
        "vec_id",
        "component",
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )


def whitening_report(embeddings: DataFrame) -> DataFrame:
    """`whiten` with deviation as a 64-bit number; one that does not fit is an error."""
    return whiten(embeddings).withColumn("deviation", F.col("deviation").cast("bigint"))


def brute_force(rows: list[tuple[int | None, list | None]], most: int = COMPONENTS) -> tuple[int, list[list[Fraction]], dict]:
    """n, the covariance as fractions and (deviation, x - S/n) by id, without polarisation."""
    usable = {}
    for i, c in rows:
        if c is not None and all(v is not None and np.isfinite(v) for v in c):
            usable[i] = tuple(int(np.floor(float(v) * STEPS)) + OFFSET for v in c)
    fit = sorted(set(usable.values()))
    n, d = len(fit), len(fit[0])
    means = [Fraction(sum(x[i] for x in fit), n) for i in range(d)]
    v = [[sum((x[i] - means[i]) * (x[j] - means[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    out = {i: (int(sum((n * (a - m)) ** 2 for a, m in zip(x, means))), [a - m for a, m in zip(x, means)]) for i, x in usable.items()}
    return n, v, out
