"""Views of the test tables that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordering import number_rows
from tidewatch.sources.tables import read_table

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def line_series(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as one volume series per supplier."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series"),
        *LINE_ORDER,
        F.col("l_extendedprice").alias("t_vol"),
        F.col("l_quantity").alias("n_req"),
        F.col("l_discount").alias("s_len"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
    )


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The series with row numbers."""
    return number_rows(line_series(spark, folder), ["series"], [F.col(c) for c in LINE_ORDER])
