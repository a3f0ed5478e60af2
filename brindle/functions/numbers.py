"""Arithmetic helpers and evenly spaced grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squared_error(y: Column, yhat: Column) -> Column:
    return F.pow(y - yhat, F.lit(2.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of an error where the divisor is zero."""
    return F.try_divide(top, bottom)


def grid_values(start: float, stop: float, step: float) -> list[float]:
    """``start, start+step, ... , stop`` from integer steps, so that no rounding builds up."""
    return [start + i * step for i in range(int(round((stop - start) / step)) + 1)]


def grid_by_length(start: float, stop: float, length: int) -> list[float]:
    return [start + (stop - start) * i / (length - 1) for i in range(length)]


def double_array(values: list[float]) -> Column:
    """A constant array, built in one expression however long it is."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def numeric_grid(start: Column, stop: Column, step: float) -> Column:
    """The grid of :func:`grid_values` as an array column, for bounds held in the data."""
    steps = F.floor(F.round((stop - start) / F.lit(step), 9)).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda i: start + i * F.lit(step))
