"""Document quality by pairwise ranking.

A Bradley-Terry model: the chance that document a is preferred to document b is the
logistic of the difference of their scores, and a score is linear in the features of a
text. It is fitted on pairs of one document labelled good and one labelled bad, by
logistic loss on feature differences. All labelled rows take part: they are dealt into
blocks by hash, and every good row of a block is paired with every bad one. The cut is a
quantile of the scores of all these rows: the share of bad labels. Scores are mapped to
(0, 1) so that the cut lies at `CUT`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, id_text, staged
from tidewatch.operators.selection import exact_quantiles

CUT = 0.3
BLOCK_ROWS = 1024
# rows of the rarer class that a block gets on average; they are repeated where there are fewer
BLOCK_RARE = 32
HELD_OUT_MODULUS = 5


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    slope: float


def features(text: bytes) -> list[float]:
    """Shares and counts that describe how a text is written; all zero for an empty one."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    upper = counts[65:91].sum()
    letters = upper + counts[97:123].sum() + counts[128:].sum()
    digits = counts[48:58].sum()
    breaks = counts[10]
    spaces = counts[32] + counts[9] + counts[13]
    ends = counts[33] + counts[44] + counts[46] + counts[63]
    symbols = size - letters - digits - breaks - spaces - ends if text else 0
    words = text.split()
    n = max(1, len(words))
    tally = Counter(words)
    ranked = tally.most_common(1)
    runs = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = [
        upper / max(1, letters),
        symbols / size,
        digits / size,
        counts[33] / size,
        counts[124] / size,
        ends / size,
        breaks / size,
        1 - letters / size,
        runs / n,
        (ranked[0][1] / n) if ranked else 0.0,
        1 - len(tally) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    return [
        *shares,
        *(x**0.5 for x in shares),
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        letters / n / 10,
        len(tally) / n**0.8,
    ]


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "features": pa.array(rows, pa.list_(pa.float64()))})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of `part` over all batches; one array a task reaches the driver."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [part(batch) for batch in batches if batch.num_rows]
        if parts:
            yield pa.record_batch({"sums": pa.array([np.sum(parts, 0)], pa.list_(pa.float64()))})

    return np.sum([r["sums"] for r in rows.mapInArrow(summed, "sums array<double>").collect()], 0)


def _blocks(rows: DataFrame, n: int, n_good: int, block_rows: int) -> DataFrame:
    """The labelled rows in blocks of about `block_rows`, a row of lists each.

    A class with too few rows for all blocks is repeated, so that the other one meets it in
    every block: by hash, a block is left without it with a chance of about exp(-32).
    """
    blocks = -(-n // block_rows)
    rare, rare_label = min((n_good, 1), (n - n_good, 0))
    copies = min(blocks, -(-BLOCK_RARE * blocks // rare))
    nth = F.when((F.col("quality") == 1).cast("int") == rare_label, copies).otherwise(1)
    start = F.pmod(F.xxhash64("doc_id", "features"), F.lit(blocks))
    return (
        rows.withColumn("copy", F.explode(F.sequence(F.lit(0), nth - 1)))
        .groupBy(((start + F.col("copy") * (blocks // copies)) % blocks).alias("block"))
        .agg(F.collect_list(F.struct("quality", "features")).alias("rows"))
    )


def pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and curvature of the logistic loss over all of them."""
    p = 1 / (1 + np.exp(-np.clip((good @ weights)[:, None] - (bad @ weights)[None, :], -30, 30)))
    gradient = good.T @ (p - 1).sum(1) - bad.T @ (p - 1).sum(0)
    w = p * (1 - p)
    mixed = good.T @ w @ bad
    curvature = good.T @ (w.sum(1)[:, None] * good) + bad.T @ (w.sum(0)[:, None] * bad) - mixed - mixed.T
    return np.concatenate([[p.size], gradient, curvature.ravel()])


def _fit_pairs(blocks: DataFrame, center: np.ndarray, scale: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of least logistic loss on differences (good minus bad), by Newton steps."""
    d = len(center)
    weights = np.zeros(d)
    for _ in range(rounds):
        def part(batch: pa.RecordBatch, weights: np.ndarray = weights) -> np.ndarray:
            total = np.zeros(1 + d + d * d)
            for block in batch.column("rows"):
                rows = block.values
                z = (_matrix(rows.field("features")) - center) / scale
                good = rows.field("quality").to_numpy(zero_copy_only=False) == 1
                total += pair_sums(z[good], z[~good], weights)
            return total

        sums = _summed(blocks, part)
        gradient = sums[1:d + 1] / sums[0] + ridge * weights
        curvature = sums[d + 1:].reshape(d, d) / sums[0]
        step = np.linalg.solve(curvature + ridge * np.eye(d), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_quality(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> QualityModel:
    """Fits the ranking on all labelled rows whose fold (crc32 of the id modulo 5) is not 0.

    Rows without a label are left out. If one class is missing, every document gets the
    same score: above the cut without bad labels, below it without good ones.
    """
    known = labels.filter(F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    learnt = fold(F.col("doc_id"), HELD_OUT_MODULUS) != 0
    # features are small, so the join moves no texts
    found = id_text(docs).filter(learnt).mapInArrow(_with_features, "doc_id bigint, features array<double>")
    rows = staged(found.join(known.filter(learnt), "doc_id"), "quality-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    n, n_good = counts["n"], counts["good"]
    width = len(features(b""))
    if n_good in (0, n):
        flat = 0.0 if n_good or not n else 10.0
        return QualityModel((0.0,) * width, (0.0,) * width, (1.0,) * width, flat, 1.0)
    center = _summed(rows, lambda b: _matrix(b.column("features")).sum(0)) / n
    spread = _summed(rows, lambda b: ((_matrix(b.column("features")) - center) ** 2).sum(0)) / n
    scale = np.maximum(np.sqrt(spread), 1e-9)
    weights = _fit_pairs(staged(_blocks(rows, n, n_good, block_rows), "quality-blocks"), center, scale)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ((_matrix(batch.column("features")) - center) / scale) @ weights
            yield pa.record_batch({"quality": batch.column("quality"), "score": raw})

    scores = staged(rows.mapInArrow(scored, "quality int, score double"), "quality-scores")
    # the two ranks around the share of bad labels
    at = (n - 1) * (1 - n_good / n)
    ranks = [int(np.floor(at)), int(np.ceil(at))]
    cut = float(np.mean(exact_quantiles(scores, ["score"], [(r + 0.5) / n for r in ranks])["score"]))
    steep = np.geomspace(0.05, 20, 60)

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        raw = batch.column("score").to_numpy() - cut
        sign = np.where(batch.column("quality").to_numpy() == 1, 1, -1)
        return np.array([np.logaddexp(0, -sign * (a * raw + np.log(CUT / (1 - CUT)))).sum() for a in steep])

    # the likeliest steepness of the logistic map whose cut is fixed
    slope = float(steep[np.argmin(_summed(scores, losses))])
    weights, center, scale = (tuple(map(float, v)) for v in (weights, center, scale))
    return QualityModel(weights, center, scale, cut, slope)


def _scores(texts: list[bytes | None], model: QualityModel) -> np.ndarray:
    weights, center, scale = map(np.array, (model.weights, model.center, model.scale))
    x = np.array([features(t or b"") for t in texts], float).reshape(-1, len(weights))
    raw = ((x - center) / scale) @ weights - model.cut
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + np.log(CUT / (1 - CUT)), -500, 500)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the cut on) of every row.

    Null text counts as empty and gets a score like any other; rows without an id are
    not held out; other columns are not read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(_scores(texts, model))})

    return (
        id_text(docs)
        .mapInArrow(scored, "doc_id bigint, score double")
        .select(
            "doc_id",
            F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS) == 0, F.lit(False)).alias("held_out"),
            "score",
            (F.col("score") >= CUT).cast("int").alias("predicted"),
        )
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs`, all columns, whose text is scored at or above the cut."""
    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores([(t or "").encode() for t in texts], model) >= CUT)

    return docs.filter(good(F.col("text").cast("string")))
