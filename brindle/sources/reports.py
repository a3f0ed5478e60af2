"""Small result tables, written reports, first rows and schema profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from brindle.storage import write_out

MAX_PRINTED_ROWS = 1000


def literal_table(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def stack_metrics(metrics: list[tuple[str, DataFrame]], value: str, label: str = "model") -> DataFrame:
    """One row (pos, label, value) per one-row, one-column frame, in the given order."""
    parts = [df.select(F.lit(i).cast("bigint").alias("pos"), F.lit(name).alias(label),
                       F.col(df.columns[0]).cast("double").alias(value))
             for i, (name, df) in enumerate(metrics, start=1)]
    return reduce(DataFrame.unionByName, parts)


def report_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table in parallel; csv gets a header."""
    writer = df.write.mode("errorifexists")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def markdown(df: DataFrame, limit: int = MAX_PRINTED_ROWS) -> str:
    """The rows, in the frame's order, as a Markdown table; a frame of more than ``limit`` rows is refused, not cut."""
    rows = df.limit(min(limit, MAX_PRINTED_ROWS) + 1).collect()
    if len(rows) > min(limit, MAX_PRINTED_ROWS):
        raise ValueError("use report_table for large results")
    lines = [df.columns, ["---"] * len(df.columns)]
    lines += [[str(v) for v in row] for row in rows]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def peek(df: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The ``n`` rows with the least key."""
    return df.orderBy(key).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, name, type, distinct, example): the example is the least non-null value as text.

    The rows are written once and each column is read for itself: distinct values of all columns in one
    aggregation would be rows as wide as the table, as many times as it has columns, sorted in every task.
    """
    rows = write_out(df, "profiled", compact=True)
    parts = [rows.select(F.col(name).alias("value")).distinct()
             .agg(F.count("value").alias("distinct"), F.min("value").cast("string").alias("example"))
             .select(F.lit(i).cast("bigint").alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"), "distinct", "example")
             for i, (name, kind) in enumerate(df.dtypes, start=1)]
    return reduce(DataFrame.unionAll, parts)
