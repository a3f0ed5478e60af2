"""Missing values: null and NaN both count as missing, and aggregates may refuse to skip them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_missing(col: Column, floating: bool = True) -> Column:
    """Null, or NaN when the column is a floating-point one."""
    return (col.isNull() | F.isnan(col)) if floating else col.isNull()


def fill_missing(col: Column, value, floating: bool = True) -> Column:
    return F.when(is_missing(col, floating), F.lit(value)).otherwise(col)


def unless_missing(aggregate: Column, col: Column, na_rm: bool) -> Column:
    """``aggregate``, or null when ``col`` has a null and ``na_rm`` is false."""
    return aggregate if na_rm else F.when(F.count(col) == F.count(F.lit(1)), aggregate)


def strict_sum(col: Column, na_rm: bool = False) -> Column:
    return unless_missing(F.sum(col), col, na_rm)


def strict_avg(col: Column, na_rm: bool = False) -> Column:
    return unless_missing(F.avg(col), col, na_rm)
