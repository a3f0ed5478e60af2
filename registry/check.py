"""Compare registered queries with their SQL: ``python -m registry.check [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from registry import ALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("~" if pd.isna(v) else v for v in row) for row in df.itertuples(index=False, name=None)), key=repr)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    kinds = [(c, spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in sorted(spark_df.columns)
             if spark_df[c].dtype.kind != sql_df[c].dtype.kind and len(spark_df)]
    a, b = normal(spark_df), normal(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[:2]}" if bad else ("ok" if not kinds else f"ok but types {kinds}")


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ALL)
    spark, con, failed = session(), connect(folder), 0
    for name in names:
        fn, oracle = ALL[name]
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            spent = time.time() - start
            start = time.time()
            verdict = f"rows only ({len(got)})" if oracle is None else compare(got, con.sql(oracle).df())
            verdict += f" [{len(got)} rows]"
        except Exception as error:  # noqa: BLE001 - report and go on
            spent, verdict = time.time() - start, f"ERROR {type(error).__name__} {str(error)[:600]}"
        failed += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {spent:6.2f}s {time.time() - start:6.2f}s {verdict[:900]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
