"""Column selection by range, position, aggregate or list, and reshaping to long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns in order; a later one may use an earlier one."""
    for name, expr in exprs.items():
        df = df.withColumn(name, expr)
    return df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop_listed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included."""
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def column_slice(df: DataFrame, start: int, stop: int) -> list[str]:
    """Names at 1-based positions ``start``..``stop``."""
    return df.columns[start - 1: stop]


def across(df: DataFrame, cols: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each listed column by ``fn`` of it: one native expression per column."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def select_columns_where(one_row: DataFrame, test: Callable[[float], bool]) -> list[str]:
    """Names in a one-row aggregate whose value passes ``test``."""
    row = one_row.first()
    return [c for c in one_row.columns if test(row[c])]


def choose_features(cols: list[str], wanted: list[str]) -> list[str]:
    """Members of ``wanted`` in table order."""
    keep = set(wanted)
    return [c for c in cols if c in keep]


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(values))


def split_rows(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where ``flag`` holds, and all others."""
    return df.filter(flag), df.filter(~F.coalesce(flag, F.lit(False)))


def features_to_vector(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=name).transform(df)


def features_to_array(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def unpivot_levels(df: DataFrame, ids: list[str], cols: list[str],
                   name: str = "protein", value: str = "level") -> DataFrame:
    """Wide to long; null cells stay as rows. Columns not listed are never read."""
    return df.select(*ids, *cols).unpivot(ids, cols, name, value)


def unpivot_subset(df: DataFrame, ids: list[str], cols: list[str], keep: list[str]) -> DataFrame:
    """Long form of the kept columns only, chosen before the reshape so that the scan is narrow."""
    return unpivot_levels(df, ids, choose_features(cols, keep))


def scatter_projection(df: DataFrame, pairs: list[tuple[str, str]], label: str) -> DataFrame:
    """Points (pair, x, y, label) for each pair of columns, from one scan."""
    points = [F.struct(F.lit(f"{x}/{y}").alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"))
              for x, y in pairs]
    return df.select(F.col(label), F.inline(F.array(*points)))
