"""Ordered analytics that never need a whole key in one task.

A key may hold a third of all rows, so a window partitioned by the key alone is not
enough. Rows are cut into slices of about `SLICE_ROWS` rows along (key, order): Spark
samples the bounds and sorts each range, whatever the distribution of keys and times.
Slice totals are small, and their running sums give each slice its offset. Once rows
carry a number, frames with a bounded look-back run over blocks of rows, each with a copy
of the few rows before it. Order-dependent rules without a look-back bound are folded as
a stream, with one state in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.functions.folds import scan
from tidewatch.session import staged

DEFAULT_BLOCK = 16384
SLICE_ROWS = 1 << 20


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int) -> DataFrame:
    """The rows as a stage table of ranges of (key, order): adds `_at`, which grows along
    (key, order), and `_slice`, the number of the range.

    Rows that are equal in both stay in one range, so `order` should tell rows apart.
    """
    ranges = [*[F.col(k) for k in keys], *order]
    return staged(
        df.repartitionByRange(slices, *ranges)
        .sortWithinPartitions(*ranges)
        # a row's number is part of the table, so every later job sees the same one
        .withColumn("_at", F.monotonically_increasing_id()),
        "slices",
    ).withColumn("_slice", F.shiftright("_at", 33))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds inclusive running sums, in `order`, per key.

    A task sorts about `slice_rows` rows, and the running sum across slices sees one row
    per key and slice. Tables of up to `slice_rows` rows are one slice.
    """
    values = {name: f"_value_{name}" for name in totals}
    tagged = df.withColumns({v: totals[name] for name, v in values.items()})
    slices = -(-df.count() // slice_rows)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if slices <= 1:
        whole = up_to(Window.partitionBy(*keys).orderBy(*order))
        return tagged.select(*df.columns, *[F.sum(v).over(whole).alias(name) for name, v in values.items()])

    table = sliced(tagged, keys, order, slices)
    per_slice = table.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_sum_{name}") for name, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(n).alias(f"_of_{n}") for n in (*keys, "_slice")],
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals],
    )
    inside = up_to(Window.partitionBy(*keys, "_slice").orderBy("_at"))
    pairs = [(n, f"_of_{n}") for n in (*keys, "_slice")]
    return table.join(offsets, _same(table, offsets, pairs)).select(
        *[table[c] for c in df.columns],
        *[(F.col(f"_before_{name}") + F.sum(table[v]).over(inside)).alias(name) for name, v in values.items()],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Adds the 1-based position of each row within its key.

    Inside a slice the place in the sorted table is the number, so nothing is ordered a
    second time.
    """
    slices = -(-df.count() // slice_rows)
    if slices <= 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    table = sliced(df, keys, order, slices)
    per_slice = table.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(n).alias(f"_of_{n}") for n in (*keys, "_slice")],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    pairs = [(n, f"_of_{n}") for n in (*keys, "_slice")]
    return table.join(offsets, _same(table, offsets, pairs)).select(
        *[table[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name)
    )


def fold_stream(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    inputs: Sequence[str],
    start: Callable[..., Any],
    step: Callable[..., tuple[Any, float | None]],
    output: str,
) -> DataFrame:
    """Adds `output` (double), folded over each key's rows in `order`.

    Rows are dealt out by key and sorted, and stream through the fold: a task holds one
    batch and one state, however long a key's history is. `start(*values)` makes the state
    from a key's first row, `step(state, *values)` gives the next state and the row's
    output; `values` are the row's `inputs`.
    """
    schema = StructType([*df.schema.fields, StructField(output, DoubleType())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = state = None
        begun = False
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in inputs]
            for at, *values in zip(batch.column(key).to_pylist(), *columns):
                if not begun or at != current:
                    begun, current, state = True, at, start(*values)
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, output]
            )

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(folded, schema)


def composed(leads: Column, states: int) -> Column:
    """One state map out of an ordered array of maps: where each state ends up."""
    identity = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(
        leads, identity, lambda ends, lead: F.transform(ends, lambda s: F.element_at(lead, s + 1))
    )


def start_states(
    maps: DataFrame, keys: Sequence[str], number: str, leads: str, states: int, largest: int, fan: int = 256
) -> DataFrame:
    """The state in which each numbered map of a key starts, the first one in state 0.

    A tree: `fan` neighbouring maps are composed to one, level by level until one map per
    key is left, and the starts are handed down again. A row holds at most `fan` maps.
    `largest` is the highest number. Gives (keys, number, start).
    """
    if fan < 2:
        raise ValueError("a tree needs a fan of 2 or more")

    def together(level: DataFrame) -> DataFrame:
        return level.groupBy(*keys, F.floor(F.col("_n") / fan).alias("_n")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), "leads"))).alias("maps")
        )

    level = maps.select(*keys, F.col(number).alias("_n"), F.col(leads).alias("leads"))
    levels = [together(level)]
    while largest >= fan:
        largest //= fan
        up = levels[-1].select(*keys, "_n", composed(F.col("maps.leads"), states).alias("leads"))
        levels.append(together(up))
    starts = levels[-1].select(*keys, "_n", F.lit(0).alias("start"))
    for level in reversed(levels):
        of = starts.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_n")], "start")
        same = F.lit(True)
        for c in (*keys, "_n"):
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        inside = level.join(of, same).select(*keys, "maps", "start")
        ends = scan(F.col("maps"), F.col("start"), lambda s, x: F.element_at(x["leads"], s + 1))
        begins = F.concat(F.array("start"), F.slice(ends, 1, F.size("maps") - 1))
        starts = inside.select(*keys, F.inline(F.arrays_zip("maps", begins.alias("start")))).select(
            *keys, F.col("maps.n").alias("_n"), "start"
        )
    return starts.withColumnRenamed("_n", number)


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    lookback: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    rn: str = "rn",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Runs frames that reach back at most `lookback` rows, block by block.

    `build` gets the rows and an ordered window and adds its columns. Each block also
    holds the `lookback` rows before it, which are dropped again afterwards.
    """
    if lookback > block:
        raise ValueError("the look-back must fit into one block")
    position = F.col(rn) - 1
    home = F.floor(position / block)
    homes = F.when(position % block >= block - lookback, F.array(home, home + 1)).otherwise(
        F.array(home)
    )
    spread = df.withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*keys, "_block").orderBy(rn)
    return build(spread, window).filter(F.col("_block") == home).drop("_block")
