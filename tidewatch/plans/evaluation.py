"""Telemetry logs to detection quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluate
from tidewatch.operators.evaluate import TIMELINE, Interval


def log_quality(
    log: DataFrame,
    ts: str,
    predicted: Column,
    keys: Sequence[str] = (),
    order: Sequence[Column] = (),
    timeline: Sequence[Interval] = tuple(TIMELINE),
) -> DataFrame:
    """Point-adjusted metrics of a log against a timeline.

    `order` breaks ties of `ts`.
    """
    rows = log.withColumns(
        {
            "actual": evaluate.ground_truth(F.col(ts), timeline),
            "predicted": predicted.cast("int"),
        }
    )
    blocks = evaluate.attack_blocks(rows, keys, [F.col(ts), *order])
    return evaluate.point_adjusted_metrics(blocks, keys)
