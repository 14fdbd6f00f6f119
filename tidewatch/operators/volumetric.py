"""Entropy residuals of flow volumes, and how fast they change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.entropy import effective_window, renyi_of_frame
from tidewatch.operators.ordering import DEFAULT_BLOCK, over_blocks
from tidewatch.operators.scalars import row_of

SERIES = ["t_vol", "n_req", "s_len"]
TERMS = ["n_req", "s_len", "n_req_sq", "n_req_s_len", "s_len_sq"]


@dataclass(frozen=True)
class EntropyModel:
    """Fitted regression of the volume entropy on the other two entropies.

    `center` and `scale` belong to the degree-2 terms without the constant, which the
    intercept covers.
    """

    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, n: float, s: float) -> float:
        """Single value, for the streaming state."""
        terms = (n, s, n * n, n * s, s * s)
        parts = zip(terms, self.center, self.scale, self.weights)
        return self.intercept + sum((x - c) / r * w for x, c, r, w in parts)


def poly_terms(n: Column, s: Column) -> dict[str, Column]:
    """Degree-2 expansion, without the constant."""
    return dict(zip(TERMS, [n, s, n * n, n * s, s * s]))


def predicted_entropy(n: Column, s: Column, model: EntropyModel) -> Column:
    terms = poly_terms(n, s).values()
    total = F.lit(model.intercept)
    for term, c, r, w in zip(terms, model.center, model.scale, model.weights):
        total = total + (term - F.lit(c)) / F.lit(r) * F.lit(w)
    return total


def entropy_residual(t: Column, n: Column, s: Column, model: EntropyModel) -> Column:
    return F.abs(t - predicted_entropy(n, s, model))


def z_score(residual: Column, mean: Column, sigma: Column) -> Column:
    return F.when(sigma != 0, (residual - mean) / sigma)


def chebyshev_multiplier(false_positive_rate: float) -> Column:
    return F.sqrt(F.lit(1.0) / F.lit(false_positive_rate))


def tumbling_windows(numbered: DataFrame, keys: Sequence[str], size: int, rn: str = "rn") -> DataFrame:
    """Full count windows of `size` rows; a shorter remainder is dropped.

    Adds the window number `w` and works on one window per group.
    """
    size = effective_window(size)
    tagged = numbered.withColumn("w", F.floor((F.col(rn) - 1) / size))
    whole = Window.partitionBy(*keys, "w")
    return (
        tagged.withColumn("_rows", F.count(F.lit(1)).over(whole))
        .filter(F.col("_rows") == size)
        .drop("_rows")
    )


def full_windows(
    numbered: DataFrame, keys: Sequence[str], size: int, *measures: Column, rn: str = "rn"
) -> DataFrame:
    """Aggregates each full count window: (keys, w, measures)."""
    size = effective_window(size)
    return (
        numbered.groupBy(*keys, F.floor((F.col(rn) - 1) / size).alias("w"))
        .agg(F.count(F.lit(1)).alias("_rows"), *measures)
        .filter(F.col("_rows") == size)
        .drop("_rows")
    )


def tumbling_entropy(
    numbered: DataFrame,
    keys: Sequence[str],
    size: int,
    alpha: int = 10,
    series: Sequence[str] = SERIES,
    rn: str = "rn",
) -> DataFrame:
    """Rényi entropy of each series per full count window: (keys, w, h_<series>).

    The rows of a window meet as one short list per series, `size` values long.
    """
    entropy = renyi_of_frame(alpha)
    frames = full_windows(
        numbered, keys, size, *[F.collect_list(c).alias(f"_f_{c}") for c in series], rn=rn
    )
    return frames.select(*keys, "w", *[entropy(f"_f_{c}").alias(f"h_{c}") for c in series])


def tumbling_residuals(
    numbered: DataFrame, keys: Sequence[str], size: int, model: EntropyModel, alpha: int = 10
) -> DataFrame:
    """Entropy residual of each full count window."""
    h = tumbling_entropy(numbered, keys, size, alpha)
    return h.withColumn(
        "residual", entropy_residual(F.col("h_t_vol"), F.col("h_n_req"), F.col("h_s_len"), model)
    )


def trailing_entropy(
    rows: DataFrame, window: WindowSpec, size: int, alpha: int = 10, series: Sequence[str] = SERIES
) -> DataFrame:
    """Adds h_<series>, the Rényi entropy of the last min(n, size) rows."""
    frame = window.rowsBetween(-(size - 1), Window.currentRow)
    framed = rows.withColumns({f"_f_{c}": F.collect_list(c).over(frame) for c in series})
    entropy = renyi_of_frame(alpha)
    return framed.withColumns({f"h_{c}": entropy(f"_f_{c}") for c in series}).drop(
        *[f"_f_{c}" for c in series]
    )


def _with_residual(
    rows: DataFrame, window: WindowSpec, size: int, first: int, model: EntropyModel, alpha: int
) -> DataFrame:
    h = trailing_entropy(rows, window, size, alpha)
    residual = entropy_residual(F.col("h_t_vol"), F.col("h_n_req"), F.col("h_s_len"), model)
    return h.withColumn("residual", F.when(F.col("rn") >= first, residual))


def _with_kinematics(rows: DataFrame, window: WindowSpec, first: int) -> DataFrame:
    """Velocity and acceleration; `first` is the row with the first residual.

    The velocity needs two residuals and the acceleration three, until then they are 0.
    """
    r0, r1, r2 = F.col("residual"), F.lag("residual", 1).over(window), F.lag("residual", 2).over(window)
    return rows.withColumns(
        {
            "velocity": F.when(F.col("rn") >= first + 1, F.abs(r0 - r1)).otherwise(0.0),
            "acceleration": F.when(
                F.col("rn") >= first + 2, F.abs((r0 - r1) - (r1 - r2))
            ).otherwise(0.0),
        }
    )


def trailing_kinematics(
    numbered: DataFrame,
    keys: Sequence[str],
    size: int,
    model: EntropyModel,
    alpha: int = 10,
    full_frames_only: bool = False,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Residual, velocity and acceleration over trailing frames, for keys of any length.

    With `full_frames_only` the first residual appears at row `size` (file features),
    otherwise frames grow from two rows on (live features).
    """
    first = size if full_frames_only else 2

    def build(rows: DataFrame, window: WindowSpec) -> DataFrame:
        residuals = _with_residual(rows, window, size, first, model, alpha)
        return _with_kinematics(residuals, window, first)

    # frame of the current row plus the two residuals before it
    return over_blocks(numbered, keys, size + 1, build, block=block)


def flow_kinematics(
    flows: DataFrame, size: int, model: EntropyModel, alpha: int = 10
) -> DataFrame:
    """The live form on flow rows.

    There is at most one flow row per source and capture window, so the rows of one
    source are bounded by the number of windows however much traffic it sends, and the
    plain ordered window is enough.
    """
    window = Window.partitionBy("source_ip").orderBy("window_start")
    rows = flows.withColumn("rn", F.row_number().over(window))
    residuals = _with_residual(rows, window, size, 2, model, alpha)
    return _with_kinematics(residuals, window, 2).withColumn(
        "residual", F.coalesce("residual", F.lit(0.0))
    )


def offline_features(
    numbered: DataFrame,
    keys: Sequence[str],
    size: int,
    model: EntropyModel,
    label: Column,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Feature rows of a recorded series, from the row where two residuals exist."""
    features = trailing_kinematics(
        numbered, keys, size, model, full_frames_only=True, block=block
    )
    return features.filter(F.col("rn") >= size + 1).select(
        *keys,
        "rn",
        "velocity",
        "acceleration",
        "iat_mean",
        "sa_ratio",
        "jaccard_score",
        "entropy_shannon",
        label.cast("int").alias("label"),
    )


def replace_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces infinities by the mean of the finite values of the column."""
    finite = {
        c: F.when(~F.col(c).isin(float("inf"), float("-inf")), F.col(c)) for c in columns
    }
    means = row_of(df.agg(*[F.avg(finite[c]).alias(c) for c in columns]))
    return df.withColumns(
        {
            c: F.when(F.col(c).isin(float("inf"), float("-inf")), means[c]).otherwise(F.col(c))
            for c in columns
        }
    )


def series_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, as one row."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )


def stability_flags(
    numbered: DataFrame,
    keys: Sequence[str],
    size: int,
    batch: DataFrame,
    series: Sequence[str] = SERIES,
    factor: float = 0.1,
) -> DataFrame:
    """Per count window: does any row leave mean ± factor * deviation of its series?

    Mean and deviation are those of the whole `batch`, the rows before they were numbered.
    """
    stats = row_of(series_stats(batch, series))
    deviates = {
        c: F.abs(F.col(c) - stats[f"mean_{c}"]) > F.lit(factor) * stats[f"std_{c}"] for c in series
    }
    any_series = F.greatest(*[deviates[c].cast("int") for c in series]) == 1
    return full_windows(
        numbered,
        keys,
        size,
        *[F.max(deviates[c]).alias(f"unstable_{c}") for c in series],
        F.count_if(any_series).alias("unstable_rows"),
    )


def any_violation(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: is any flag set anywhere?"""
    return flags.agg(F.max(F.greatest(*[F.col(c).cast("int") for c in columns]) == 1).alias("violated"))


def residual_anomalies(residuals: DataFrame, mean: float, sigma: float, rate: float = 0.01) -> DataFrame:
    """Flags residuals whose z-score passes the Chebyshev bound for `rate`."""
    z = z_score(F.col("residual"), F.lit(mean), F.lit(sigma))
    bound = chebyshev_multiplier(rate)
    return residuals.withColumns({"z": z, "bound": bound, "anomalous": z > bound})


def dynamic_window(sigma_live: Column, sigma_train: Column, size: int) -> Column:
    """Window size scaled by the volatility of the live data, cut to a whole number."""
    return F.when(sigma_train != 0, (F.lit(size) * (sigma_live / sigma_train)).cast("int"))


def burst_label(
    avg: dict[str, Column], mean: dict[str, Column], std: dict[str, Column], k: float = 5.0
) -> Column:
    """Tells a legitimate burst from a flood by the window means of the three volumes."""
    high = {c: mean[c] + F.lit(k) * std[c] for c in SERIES}
    return (
        F.when(
            (avg["t_vol"] > high["t_vol"]) & (avg["s_len"] > high["s_len"]),
            "Legitimate Burst (Speedtest/Large Download)",
        )
        .when(
            (avg["n_req"] > high["n_req"]) & (avg["s_len"] < mean["s_len"]),
            "Malicious Attack (Potential Flood)",
        )
        .otherwise("Unknown Anomaly (Further check...)")
    )


def burst_signatures(
    numbered: DataFrame, keys: Sequence[str], size: int, batch: DataFrame, k: float = 5.0
) -> DataFrame:
    """Labels each full count window against the statistics of the whole `batch`."""
    stats = row_of(series_stats(batch, SERIES))
    mean = {c: stats[f"mean_{c}"] for c in SERIES}
    std = {c: stats[f"std_{c}"] for c in SERIES}
    averages = full_windows(
        numbered, keys, size, *[F.avg(c).alias(f"avg_{c}") for c in SERIES]
    )
    return averages.withColumn(
        "label", burst_label({c: F.col(f"avg_{c}") for c in SERIES}, mean, std, k)
    )
