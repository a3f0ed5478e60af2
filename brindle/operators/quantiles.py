"""Exact quantiles with linear interpolation, by one plan at every size.

A first pass takes one mergeable sketch per group and reads from it a bracket of values around every wanted rank; the
sketch's rank error is bounded (Greenwald and Khanna 2001), and a bracket reaches beyond it on both sides. A second pass counts the rows
between brackets and the rows per value inside them. Only values inside brackets are sorted, at most 8/ACCURACY of a
group's rows per quantile; rows between them have become one count. Groups of fewer than ACCURACY rows are one bracket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.operators.joins import null_safe_join
from brindle.storage import write_out

_ALL = "__all"
ACCURACY = 2000


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], name: str = "quantiles") -> DataFrame:
    """Per group: ``n`` non-null values and the array of quantiles at ``probs``.

    Groups without a value are absent. Null group keys form a group.
    """
    keys = by or [_ALL]
    counted = bracketed(df, by, value, probs)
    upto = W.partitionBy(*keys).orderBy("__v", "__in").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("__end", F.sum("__rows").over(upto)).withColumn("__start", F.col("__end") - F.col("__rows"))
    out = ranked.groupBy(*keys, "n").agg(F.array(*[_interpolate(p) for p in probs]).alias(name))
    return out if by else out.drop(_ALL)


def bracketed(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(group, n, value, inside, rows): rows per value inside a bracket, and per gap below a bracket."""
    keys = by or [_ALL]
    rows = df.select(*(by or [F.lit(1).alias(_ALL)]), F.col(value).cast("double").alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    reach, wanted = 3 / ACCURACY, sorted(set(probs))
    edges = [min(max(p + side * reach, 0.0), 1.0) for p in wanted for side in (-1, 1)]
    sketched = write_out(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", edges, ACCURACY).alias("__edges")), "brackets")
    placed = null_safe_join(rows, sketched, keys, "inner").withColumns({"__in": _inside(len(wanted)), "__next": _next_bracket(len(wanted))})
    # a row between brackets counts just below the next one; above the last it does not matter
    return (placed.filter("__in OR __next IS NOT NULL").groupBy(*keys, "n", F.when(F.col("__in"), F.col("__v")).otherwise(F.col("__next")).alias("__v"), "__in")
            .agg(F.count(F.lit(1)).alias("__rows")))


def _edge(i: int) -> Column:
    return F.get("__edges", F.lit(i))


def _inside(brackets: int) -> Column:
    found = F.col("n") < ACCURACY
    for i in range(brackets):
        found = found | F.col("__v").between(_edge(2 * i), _edge(2 * i + 1))
    return found


def _next_bracket(brackets: int) -> Column:
    found = F.lit(None).cast("double")
    for i in reversed(range(brackets)):
        found = F.when(F.col("__v") < _edge(2 * i), _edge(2 * i)).otherwise(found)
    return found


def _position(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(p))


def _interpolate(p: float) -> Column:
    def at(rank: Column) -> Column:
        found = F.max(F.when(F.col("__in") & (F.col("__start") < rank) & (rank <= F.col("__end")), F.col("__v")))
        return F.coalesce(found, F.raise_error(F.lit("a bracket misses its rank")).cast("double"))
    low = F.floor(_position(p)) + 1
    high = F.least(low + 1, F.col("n"))
    share = _position(p) - F.floor(_position(p))
    return at(low) + (at(high) - at(low)) * share


def group_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5]).select(*by, F.col("quantiles")[0].alias("median"))


def quantile_literals(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Quantiles of a whole column as Python numbers (as many as ``probs``)."""
    row = exact_quantiles(df, [], value, probs).first()
    return [] if row is None else [q for q in row["quantiles"] if not math.isnan(q)]
