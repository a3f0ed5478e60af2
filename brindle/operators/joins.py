"""Joins, set operations and scalars attached to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.numbers import double_array


def join_fact_dim(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left equi-join, a null key matching a null key. No hint: ``dim`` is broadcast when its known size allows."""
    return null_safe_join(facts, dim, [key])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key."""
    renamed = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return null_safe_join(left, right, [key])


def join_effects_chain(df: DataFrame, effects: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Left joins in turn with (table, key, null_safe)."""
    for table, key, null_safe in effects:
        df = null_safe_join(df, table, [key]) if null_safe else df.join(table, key, "left")
    return df


def semi_join_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose every key, null included, occurs in ``other``; the keys are tested one by one."""
    for key in keys:
        df = null_safe_join(df, other.select(key).distinct(), [key], "left_semi")
    return df


def anti_join_natural(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` equal to no row of ``b`` on all shared columns; nulls are equal, copies stay."""
    shared = [c for c in a.columns if c in b.columns]
    return null_safe_join(a, b.select(shared).distinct(), shared, "left_anti")


def join_derived_attr(df: DataFrame, key: str, name: str, expr: Column, check: bool = True) -> DataFrame:
    """Derive one attribute per key, de-duplicate, join back.

    With ``check`` a key that carries two values stops the query instead of multiplying its rows.
    """
    attrs = df.select(key, expr.alias(name)).distinct()
    if check:
        guarded = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"{name} is not unique per {key}")))
        attrs = attrs.groupBy(key).agg(F.coalesce(guarded.cast(dict(attrs.dtypes)[name]), F.max(name)).alias(name))
    return df.join(attrs, key, "left")


def attach_scalar(df: DataFrame, scalar: DataFrame, name: str) -> DataFrame:
    """A one-row, one-column result on every row, as a scalar subquery rather than a join."""
    return df.withColumn(name, scalar.scalar())


def grid_cross(df: DataFrame, grid: list[float], name: str = "lam", pos: str = "pos") -> DataFrame:
    """Every row at every grid value, with the 1-based position; meant for aggregates, not rows."""
    return df.select("*", F.posexplode(double_array(grid)).alias(pos, name)).withColumn(pos, F.col(pos) + 1)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def complement_rows(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not among ``chosen``; a null key is a key like any other."""
    return null_safe_join(df, chosen.select(key), [key], "left_anti")


def feature_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many names two one-column tables share."""
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared"))
