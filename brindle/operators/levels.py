"""Levels of a categorical column: its distinct values in order, and their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.operators.ordering import ranged, running_sum


def category_levels(df: DataFrame, col: str) -> DataFrame:
    """(code 1.., level): sorted distinct non-null values of any type that can be ordered.

    The values are range-partitioned and numbered inside a partition, after the counts of those before.
    """
    values = df.select(F.col(col).alias("level")).filter(F.col("level").isNotNull()).distinct()
    return running_sum(ranged(values, ["level"], "levels"), [], ["level"], F.lit(1).cast("bigint"), "code").select("code", "level")


def category_code(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    levels = category_levels(df, col).select(F.col("level").alias("__level"), F.col("code").alias(name))
    return df.join(levels, F.col(col) == F.col("__level"), "left").drop("__level")
