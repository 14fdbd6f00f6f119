"""Entropy column builders: Rényi over numeric windows, Shannon over domain labels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.folds import let

# fixed value: window used when the asked one holds fewer than two rows
DEFAULT_WINDOW = 1000


def effective_window(size: int) -> int:
    return size if size >= 2 else DEFAULT_WINDOW


def bin_count(size: int) -> int:
    """Histogram bins for a window of `size` rows."""
    return 2 * math.ceil(size ** (2 / 3))


def range_start(low: Column, high: Column) -> Column:
    """A single-valued window gets the range low ± 0.5."""
    return F.when(low == high, low - 0.5).otherwise(low)


def range_width(low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(1.0)).otherwise(high - low)


def guessed_bin(value: Column, start: Column, width: Column, bins: Column) -> Column:
    return F.least(F.floor((value - start) / width * bins), bins - 1).cast("int")


def settled_bin(guess: Column, value: Column, start: Column, width: Column, bins: Column) -> Column:
    """Compares the guess with the bin edges themselves, as a numeric histogram does.

    The quotient alone can land one bin off when a value sits on an edge. The last bin
    is closed.
    """
    step = width / bins
    return (
        F.when(value < guess * step + start, guess - 1)
        .when((value >= (guess + 1) * step + start) & (guess != bins - 1), guess + 1)
        .otherwise(guess)
    )


def bin_index(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Equal-width bin of `value` in [low, high]."""
    start, width = range_start(low, high), range_width(low, high)
    return settled_bin(guessed_bin(value, start, width, bins), value, start, width, bins)


def frame_entropies(values: np.ndarray, lengths: np.ndarray, alpha: int) -> np.ndarray:
    """Rényi entropy of many short frames stored one after the other.

    Same bins and edge rule as `bin_index`. A frame without values has no entropy.
    """
    if not lengths.all():
        full = np.full(len(lengths), np.nan)
        full[lengths > 0] = frame_entropies(values, lengths[lengths > 0], alpha)
        return full
    if len(lengths) == 0:
        return np.empty(0)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    flat = low == high
    start, width = np.where(flat, low - 0.5, low), np.where(flat, 1.0, high - low)
    known = {n: bin_count(int(n)) for n in np.unique(lengths)}
    bins = np.array([known[n] for n in lengths])

    owner = np.repeat(np.arange(len(lengths)), lengths)
    v_start, v_width, v_bins = start[owner], width[owner], bins[owner]
    step = v_width / v_bins
    guess = np.minimum(((values - v_start) / v_width * v_bins).astype(np.int64), v_bins - 1)
    below = values < guess * step + v_start
    above = (values >= (guess + 1) * step + v_start) & (guess != v_bins - 1)
    index = guess - below + (above & ~below)

    most = int(bins.max())
    counts = np.bincount(owner * most + index, minlength=len(lengths) * most)
    shares = counts.reshape(-1, most) / lengths[:, None]
    if alpha == 1:
        logs = np.log2(shares, out=np.zeros_like(shares), where=shares > 0)
        return -(shares * logs).sum(axis=1) + 0.0
    return np.log2((shares**alpha).sum(axis=1)) / (1 - alpha) + 0.0


def renyi_of_frame(alpha: int = 10):
    """Arrow UDF: Rényi entropy of an array column of frames.

    The elements of a frame fall into bins that depend on the frame itself. Lambdas over
    the array are evaluated one element at a time, and unrolled expressions grow past the
    size of one generated method; whole Arrow batches in numpy measured several times
    faster than either (see README).
    """

    @F.arrow_udf("double")
    def entropy(frames: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(frames).to_numpy(zero_copy_only=False)
        values = frames.flatten().to_numpy(zero_copy_only=False)
        return pa.array(frame_entropies(values, lengths, alpha), from_pandas=True)

    return entropy


def first_label(domain: Column) -> Column:
    return F.split_part(domain, F.lit("."), F.lit(1))


def domain_entropy(domain: Column) -> Column:
    """Shannon entropy of the characters before the first dot, case-sensitive."""

    def of_label(text: Column) -> Column:
        size = F.length(text).cast("double")
        letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
        shares = F.transform(letters, lambda c: (size - F.length(F.replace(text, c))) / size)
        return F.aggregate(shares, F.lit(0.0), lambda acc, s: acc - s * F.log2(s)) + F.lit(0.0)

    return let(
        first_label(domain), lambda text: F.when(F.length(text) > 0, of_label(text)).otherwise(0.0)
    )


def cell_entropy(domain: Column) -> Column:
    """Domain entropy of a file cell, where blank and the text 'nan' count as absent."""
    absent = domain.isNull() | F.lower(domain).isin("", "nan")
    return F.when(absent, 0.0).otherwise(domain_entropy(domain))


def dga_verdict(domain: Column, threshold: float = 2.5) -> Column:
    entropy = domain_entropy(domain)
    return F.struct(
        domain.alias("analyzed_domain"),
        entropy.alias("entropy"),
        (entropy > threshold).alias("is_DGA"),
        F.lit(threshold).alias("threshold"),
    )
