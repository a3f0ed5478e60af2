"""Reproducible pseudo-random order: a hash of the row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_hash(keys: list[str], seed: int) -> Column:
    """Hex text whose order is a random order of the rows, equal in every engine with md5."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("#", *parts, F.lit(str(seed))))


def hash_integer(hexadecimal: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits as a non-negative integer."""
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("bigint")


def hash_fraction(hexadecimal: Column) -> Column:
    """Uniform on [0, 1) from the first 8 hex digits."""
    return hash_integer(hexadecimal) / F.lit(float(16**8))
