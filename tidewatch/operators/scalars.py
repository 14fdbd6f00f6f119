"""One-row results as columns of another query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_of(single: DataFrame) -> Column:
    """The only row of `single` as a struct.

    All fields come out of one subquery, which runs once however often they are used.
    """
    return single.select(F.struct(*single.columns).alias("row")).scalar()
