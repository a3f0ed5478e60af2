"""Reading the given tables and writing intermediate ones to the folder that the cluster shares."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.storage import note_table, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if that path exists for them.

    On a cluster the package is installed or sent along (``--py-files``) as for any PySpark program.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which also ends its lineage there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_mod(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; a null value counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % mod


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], by: str, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key) that spreads a hot key over many tasks.

    The table's rows are copied to the salts that a key's rows have, at most ``salts`` per key.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    return salted.join(salted.select(*keys, "__salt").distinct().join(table, keys), [*keys, "__salt"]).drop("__salt")


def stage_bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """Like ``stage``, as an external table bucketed by ``column``: grouping by it later moves no rows. ``release`` drops its name."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    note_table(spark, name)
    return spark.table(name)
