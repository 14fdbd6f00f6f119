"""Acceleration spikes whose alert clears the memory of the last three residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.folds import scan
from tidewatch.operators.ordering import DEFAULT_BLOCK, over_blocks, start_states
from tidewatch.session import staged

MEMORY = 3
# Rows since the last alert, cut off at MEMORY: that is all the rule remembers.
STATES = range(MEMORY + 1)


def _next(state: Column, spike: Column) -> Column:
    waited = F.least(state + 1, F.lit(MEMORY))
    return F.when(spike & (waited == MEMORY), 0).otherwise(waited)


def spike_alerts(
    residuals: DataFrame, keys: Sequence[str], threshold: float = 1.0, block: int = DEFAULT_BLOCK, fan: int = 256
) -> DataFrame:
    """Rows that raise an alert; `residuals` has `rn` (1, 2, …) and `residual` per key.

    A spike alerts only when three residuals came in since the last alert. The rule is a
    machine with four states, so a block of rows boils down to where it leads from each
    state. Blocks are summarised in parallel, the summaries are composed as a tree, and
    each block is replayed from its true start state. No row holds more than `block` rows
    or `fan` summaries of a key.
    """

    def accelerate(rows: DataFrame, window: WindowSpec) -> DataFrame:
        r1, r2 = F.lag("residual", 1).over(window), F.lag("residual", 2).over(window)
        return rows.withColumn("acceleration", F.col("residual") - 2 * r1 + r2)

    spike = F.coalesce(F.abs("acceleration") > threshold, F.lit(False))
    blocks = staged(
        over_blocks(residuals, keys, MEMORY - 1, accelerate, block=block)
        .withColumn("block", F.floor((F.col("rn") - 1) / block))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "residual", "acceleration", spike.alias("spike")))).alias("rows")),
        "spike-blocks",
    )

    def end_from(state: int) -> Column:
        return F.aggregate("rows", F.lit(state), lambda s, x: _next(s, x["spike"]))

    summaries = blocks.select(*keys, "block", F.array(*[end_from(s) for s in STATES]).alias("leads"))
    largest = blocks.agg(F.max("block")).first()[0] or 0
    starts = start_states(summaries, keys, "block", "leads", len(STATES), largest, fan)
    of = starts.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "block")], "start")
    same = F.lit(True)
    for c in (*keys, "block"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    replayed = scan(F.col("rows"), F.col("start"), lambda s, x: _next(s, x["spike"]))
    return (
        blocks.join(of, same)
        .select(*keys, F.inline(F.arrays_zip("rows", replayed.alias("state"))))
        .filter(F.col("state") == 0)
        .select(*keys, "rows.rn", "rows.residual", "rows.acceleration")
    )
