"""Numbering rows in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.session import materialize


def range_parts(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in range partitions of the order, with `_part`, written down so that every later step sees the same parts."""
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def chained(parted: DataFrame, value: Column) -> DataFrame:
    """(_part, below): the sum of `value` over all parts before each part. There are as many rows as range partitions."""
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_own"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("below"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with their number (from 0) in the given order, which must be total for the numbers to be the same every time."""
    parted = range_parts(rows, *order)
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parted.withColumn("_n", own).join(chained(parted, F.lit(1)), "_part").withColumn(name, F.col("_n") + F.col("below")).drop("_n", "_part", "below")
