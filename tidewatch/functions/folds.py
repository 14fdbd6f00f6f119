"""Ordered folds over arrays, for recurrences that no window function can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once and hands it to `body`."""
    return F.transform(F.array(value), body)[0]


def scan(
    items: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = BLOCK
) -> Column:
    """State after every item, in array order.

    States are appended inside blocks and the blocks are joined at the end, so a long
    array is not copied once per item.
    """
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / block) - 1, F.lit(0)).cast("int"))

    def run_block(done: Column, b: Column) -> Column:
        carried = F.array(F.element_at(F.element_at(done, -1), -1))
        part = F.slice(items, b * block + 1, block)
        states = F.aggregate(
            part, carried, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))
        )
        return F.concat(done, F.array(states))

    chained = F.aggregate(blocks, F.array(F.array(zero)), run_block)
    # the first entry of each block repeats the last state of the block before
    return F.flatten(F.transform(chained, lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))))
