"""Ranks and running sums over a whole table, without one task that sees all rows.

Rows are range-partitioned by the order and written; sums inside a partition are shifted by the totals
of the partitions before. Only one row per partition (and group) meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.operators.joins import null_safe_join
from brindle.storage import write_out

_SO_FAR = (W.unboundedPreceding, W.currentRow)


def ranged(df: DataFrame, order: list[str], label: str = "ranged") -> DataFrame:
    """The rows written in range partitions of ``order``, with the partition's number as ``__part``."""
    return write_out(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                     .withColumn("__part", F.spark_partition_id()), label)


def running_sum(parts: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` up to and with each row of ``ranged`` rows, within ``by``."""
    rows = parts.withColumn("__add", value)
    totals = rows.groupBy("__part", *by).agg(F.sum("__add").alias("__total"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", *by, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = F.sum("__add").over(W.partitionBy("__part", *by).orderBy(*order).rowsBetween(*_SO_FAR))
    summed = rows.withColumn("__inside", inside)
    return (null_safe_join(summed, offsets, ["__part", *by], "inner").withColumn(name, F.col("__inside") + F.col("__offset"))
            .drop("__add", "__inside", "__offset"))
