"""Ground truth, point adjustment and quality metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.entropy import bin_index
from tidewatch.functions.network import guarded_ratio, seconds_of_day
from tidewatch.operators.ordering import SLICE_ROWS, running_totals
from tidewatch.operators.scalars import row_of
from tidewatch.session import staged


@dataclass(frozen=True)
class Interval:
    start: str
    end: str
    is_attack: int
    label: str


# fixed values: the recorded experiment, matched by time of day
TIMELINE = [
    Interval("16:20:00", "17:00:00", 0, "Benign (4K/8K Streaming)"),
    Interval("17:00:00", "17:01:00", 1, "SYN Flood (hping3)"),
    Interval("17:01:00", "17:01:45", 1, "Slowloris / Port Scan"),
    Interval("17:01:45", "17:03:00", 0, "Benign Recovery Window"),
    Interval("17:03:00", "17:04:00", 1, "SYN Flood (hping3)"),
    Interval("17:04:00", "17:05:00", 1, "Slowloris / Port Scan"),
]


def clock_seconds(text: str) -> int:
    h, m, s = (int(x) for x in text.split(":"))
    return h * 3600 + m * 60 + s


def inside(interval: Interval, ts: Column) -> Column:
    return seconds_of_day(ts).between(
        float(clock_seconds(interval.start)), float(clock_seconds(interval.end))
    )


def interval_number(ts: Column, timeline: Sequence[Interval] = tuple(TIMELINE)) -> Column:
    """1-based number of the interval around `ts`; the later one wins on a shared edge.

    A timeline is a short list, so the lookup is an expression and needs no join.
    """
    choice = F
    for number, interval in reversed(list(enumerate(timeline, 1))):
        choice = choice.when(inside(interval, ts), number)
    return choice


def ground_truth(ts: Column, timeline: Sequence[Interval] = tuple(TIMELINE)) -> Column:
    choice = F
    for interval in reversed(timeline):
        choice = choice.when(inside(interval, ts), interval.is_attack)
    return choice.otherwise(0)


def interval_bounds(log: DataFrame, ts: str, timeline: Sequence[Interval] = tuple(TIMELINE)) -> DataFrame:
    """First and last log time inside each attack interval.

    A row on a shared edge belongs to both intervals here.
    """
    hits = [
        F.when(
            inside(interval, F.col(ts)),
            F.struct(F.lit(n).alias("interval"), F.lit(interval.label).alias("label")),
        )
        for n, interval in enumerate(timeline, 1)
        if interval.is_attack == 1
    ]
    return (
        log.select(F.col(ts).alias("_ts"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .groupBy("hit.interval", "hit.label")
        .agg(F.min("_ts").alias("first_time"), F.max("_ts").alias("last_time"))
    )


def attack_blocks(
    log: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Numbers the contiguous runs of true attacks; `log` has `actual` and `predicted`.

    Row number minus attack number is constant inside a run. Both numbers come from
    sliced running totals, so one long log spreads over many tasks.
    """
    numbered = running_totals(
        log,
        keys,
        order,
        {"_rn": F.lit(1).cast("bigint"), "_an": F.col("actual").cast("bigint")},
        slice_rows,
    )
    return numbered.withColumn(
        "block", F.when(F.col("actual") == 1, F.col("_rn") - F.col("_an"))
    ).drop("_rn", "_an")


def point_adjusted(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `adjusted`: a run with any detection counts as detected throughout.

    Rows outside runs match nothing; negative keys, which no run has, spread them.
    """
    spread = -1 - F.pmod(F.xxhash64(*blocks.columns), F.lit(1 << 30))
    keyed = blocks.withColumn("_run", F.coalesce("block", spread))
    detected = (
        blocks.filter((F.col("actual") == 1) & (F.col("predicted") == 1))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("block").alias("_block"))
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    same = keyed["_run"] == detected["_block"]
    for k in keys:
        same = same & keyed[k].eqNullSafe(detected[f"_k_{k}"])
    return keyed.join(detected, same, "left").select(
        *[keyed[c] for c in blocks.columns],
        F.when(F.col("actual") == 1, F.greatest("predicted", F.coalesce("_hit", F.lit(0))))
        .otherwise(F.col("predicted"))
        .alias("adjusted"),
    )


def _rates(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, precision = guarded_ratio(tp, tp + fn), guarded_ratio(tp, tp + fp)
    return counts.select(
        *keys,
        "tp",
        "tn",
        "fp",
        "fn",
        guarded_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        guarded_ratio(fp, fp + tn).alias("fpr"),
        recall.alias("detection_rate"),
        precision.alias("precision"),
        guarded_ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def confusion_metrics(
    df: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Confusion counts and rates, 0 where a rate is undefined."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
    )
    return _rates(counts, keys)


def point_adjusted_metrics(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics after point adjustment, from run totals alone."""
    runs = blocks.groupBy(*keys, "actual", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("hits")
    )
    attack, found = F.col("actual") == 1, F.col("hits") > 0
    zero = F.lit(0).cast("bigint")
    counts = runs.groupBy(*keys).agg(
        F.sum(F.when(attack & found, F.col("n")).otherwise(zero)).alias("tp"),
        F.sum(F.when(~attack, F.col("n") - F.col("hits")).otherwise(zero)).alias("tn"),
        F.sum(F.when(~attack, F.col("hits")).otherwise(zero)).alias("fp"),
        F.sum(F.when(attack & ~found, F.col("n")).otherwise(zero)).alias("fn"),
    )
    return _rates(counts, keys)


def class_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # each pair counts for its true class and for its predicted class
    per_class = (
        pairs.select(
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("class"), F.col("n").alias("support"),
                             F.lit(0).cast("bigint").alias("called"),
                             F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                    F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                             F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits")),
                )
            )
        )
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    )
    precision = guarded_ratio(F.col("hits"), F.col("called"))
    recall = guarded_ratio(F.col("hits"), F.col("support"))
    classes = per_class.select(
        F.col("class").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        guarded_ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "hits",
    )
    measures = ("precision", "recall", "f1")
    total, weight = F.sum("support"), F.col("support")
    summary = classes.agg(
        total.alias("support"),
        F.sum("hits").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * weight) / total).alias(f"weighted_{m}") for m in measures],
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("class"),
                         *[(F.col("hits") / F.col("support")).alias(m) for m in measures], "support"),
                F.struct(F.lit("macro avg").alias("class"),
                         *[F.col(f"macro_{m}").alias(m) for m in measures], "support"),
                F.struct(F.lit("weighted avg").alias("class"),
                         *[F.col(f"weighted_{m}").alias(m) for m in measures], "support"),
            )
        )
    )
    return classes.drop("hits").unionByName(summary)


def score_curve(df: DataFrame, score: str, actual: str = "actual", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Cumulative positives and negatives per distinct score, from the highest down.

    Rows are aggregated by score first. The distinct scores may be as many as the rows, on
    any scale, so the running sums are cut at sampled quantiles of the scores.
    """
    groups = staged(
        df.groupBy(F.col(score).alias("score"))
        .agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) != 1).alias("neg")),
        "score-groups",
    )
    curve = running_totals(
        groups, [], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, slice_rows
    )
    totals = row_of(groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    return curve.withColumns({"p": totals["p"], "n": totals["n"]})


def roc_points(curve: DataFrame) -> DataFrame:
    return curve.select(
        F.col("score").alias("threshold"),
        guarded_ratio(F.col("fp"), F.col("n")).alias("fpr"),
        guarded_ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area; each step's start is its end minus its own counts."""
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")))
    return curve.agg(
        guarded_ratio(area, 2.0 * F.max("p") * F.max("n")).alias("auc")
    )


def pr_points(curve: DataFrame) -> DataFrame:
    return curve.select(
        F.col("score").alias("threshold"),
        guarded_ratio(F.col("tp"), F.col("p")).alias("recall"),
        guarded_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    precision = guarded_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.agg(
        guarded_ratio(F.sum(F.col("pos") * precision), F.max("p")).alias("average_precision")
    )


def scored_rows(df: DataFrame, actual: str, predicted: str, keep: Sequence[str] = ()) -> DataFrame:
    """Actual, predicted and signed residual."""
    return df.select(
        *keep,
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        (F.col(actual) - F.col(predicted)).alias("residual"),
    )


def regression_metrics(rows: DataFrame) -> DataFrame:
    """R², MAE, MSE, and mean and deviation of the absolute residual."""
    residual, actual = F.col("residual"), F.col("actual")
    spread = F.var_pop(actual)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(spread > 0, 1 - F.avg(residual * residual) / spread).alias("r2"),
        F.avg(F.abs(residual)).alias("mae"),
        F.avg(residual * residual).alias("mse"),
        F.stddev_pop(F.abs(residual)).alias("std_abs_residual"),
    )


def residual_histogram(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Counts of equal-width residual bins between the smallest and the largest."""
    ends = row_of(rows.agg(F.min("residual").alias("low"), F.max("residual").alias("high")))
    tagged = rows.withColumns({"_low": ends["low"], "_high": ends["high"]})
    index = bin_index(F.col("residual"), F.col("_low"), F.col("_high"), F.lit(bins))
    return tagged.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
