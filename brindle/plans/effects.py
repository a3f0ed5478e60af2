"""Additive models of shrunken group means.

A model is a global mean plus one effect per key, each fitted on what the effects before leave over.
The fit works on *cells*: rows reduced to (keys, rows, total, square), where ``total`` and ``square``
are the sum and the sum of squares of the residual. A raw row is a cell of one row. Taking an effect
off a cell needs no row, so once only coarse keys remain (a category, a year) the rows are reduced
to one cell per key combination and never read again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from brindle.functions.missing import strict_sum
from brindle.operators.aggregates import rmse, shrunken_effect
from brindle.operators.joins import null_safe_join
from brindle.storage import write_out


@dataclass(frozen=True)
class Effect:
    """``coarse`` marks keys with few values. A null key is a group like any other."""

    name: str
    key: str
    penalty: float
    coarse: bool = False

    def with_penalty(self, penalty: float) -> Effect:
        return replace(self, penalty=float(penalty))


# Fixed penalties used when none are tuned.
EFFECTS = (Effect("me", "movieId", 2.0), Effect("ue", "userId", 5.0),
           Effect("ge", "genres", 4.0, coarse=True), Effect("ye", "year", 4.0, coarse=True))


def join_effect(df: DataFrame, effect: Effect, table: DataFrame) -> DataFrame:
    return null_safe_join(df, table, [effect.key])


def row_cells(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Raw rows as cells of one row each. Those carry no ``rows`` and no ``square``, which follow from ``total``."""
    return df.select(*keys, F.col(target).alias("total"))


def whole_cells(cells: DataFrame) -> DataFrame:
    """Cells with ``rows`` and ``square``, added where they are left out."""
    if "rows" in cells.columns:
        return cells
    y = F.col("total")
    return cells.withColumns({"rows": F.lit(1).cast("bigint"), "square": y * y})


def take_off(cells: DataFrame, effect: Effect, table: DataFrame) -> DataFrame:
    """Cells whose residual no longer holds the effect."""
    if "rows" not in cells.columns:
        return join_effect(cells, effect, table).withColumn("total", F.col("total") - F.col(effect.name)).drop(effect.name)
    b, n = F.col(effect.name), F.col("rows")
    return (join_effect(cells, effect, table)
            .withColumn("square", F.col("square") - 2 * b * F.col("total") + n * b * b)
            .withColumn("total", F.col("total") - n * b).drop(effect.name))


def reduce_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return whole_cells(cells).groupBy(*keys).agg(F.sum("rows").alias("rows"), strict_sum(F.col("total")).alias("total"),
                                    strict_sum(F.col("square")).alias("square"))


def next_cells(cells: DataFrame, effect: Effect, table: DataFrame, later: list[Effect],
               carry: list[str]) -> DataFrame:
    """Take an effect off, and reduce once every later key is coarse.

    Until then the cells are written if more than the fit of the next effect reads them, rather than joined again.
    """
    cells = take_off(cells, effect, table)
    keys = [e.key for e in later] + carry
    cells = cells.select(*keys, *[c for c in ("rows", "total", "square") if c in cells.columns])
    if all(e.coarse for e in later) and not effect.coarse:
        cells = write_out(reduce_cells(cells, keys), "cells")
    elif not effect.coarse and len(later) > 1:
        cells = write_out(cells, "residuals", compact=True)
    return cells


def fit_effect(cells: DataFrame, effect: Effect, mu: float) -> DataFrame:
    """(key, effect) around the mean ``mu``, written out so that joins know its size."""
    centred = F.col("total") - F.lit(float(mu)) * F.col("rows")
    return write_out(shrunken_effect(whole_cells(cells), effect.key, centred, effect.penalty, effect.name, F.col("rows")),
                     f"effect-{effect.name}")


def fit_effects(train: DataFrame, effects: list[Effect], mu: float, target: str = "rating",
                first_mu: float | None = None) -> list[tuple[Effect, DataFrame]]:
    """Effect tables in order. ``first_mu`` centres the first effect on another mean."""
    cells = row_cells(train, [e.key for e in effects], target)
    fitted = []
    for i, effect in enumerate(effects):
        centre = first_mu if i == 0 and first_mu is not None else mu
        table = fit_effect(cells, effect, centre)
        fitted.append((effect, table))
        later = list(effects[i + 1:])
        if later:
            cells = next_cells(cells, effect, table, later, [])
    return fitted


def predict_ratings(df: DataFrame, fitted: list[tuple[Effect, DataFrame]], mu: float,
                    on_unseen: dict[str, str] | None = None, name: str = "predicted") -> DataFrame:
    """Add the prediction. ``on_unseen`` says per effect: zero, drop or propagate (the default)."""
    on_unseen = on_unseen or {}
    for effect, table in fitted:
        df = join_effect(df, effect, table)
        rule = on_unseen.get(effect.name, "propagate")
        if rule == "zero":
            df = df.withColumn(effect.name, F.coalesce(effect.name, F.lit(0.0)))
        elif rule == "drop":
            df = df.filter(F.col(effect.name).isNotNull())
    prediction = sum((F.col(e.name) for e, _ in fitted), F.lit(float(mu)))
    return df.withColumn(name, prediction)


def model_rmse(test: DataFrame, fitted: list[tuple[Effect, DataFrame]], mu: float, target: str = "rating",
               on_unseen: dict[str, str] | None = None) -> DataFrame:
    return rmse(predict_ratings(test, fitted, mu, on_unseen), target, "predicted")


def nested_rmses(test: DataFrame, fitted: list[tuple[Effect, DataFrame]], mu: float,
                 labels: list[str], target: str = "rating") -> DataFrame:
    """(pos, model, rmse): the global mean and each longer model, from one pass over the test rows."""
    scored = predict_ratings(test, fitted, mu)
    prediction, cols = F.lit(float(mu)), []
    for i, label in enumerate(labels, start=1):
        if i > 1:
            prediction = prediction + F.col(fitted[i - 2][0].name)
        error = F.pow(F.col(target) - prediction, F.lit(2.0))
        value = F.when(F.count(error) == F.count(F.lit(1)), F.sqrt(F.avg(error)))
        cols.append(F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(label).alias("model"), value.alias("rmse")))
    return scored.agg(F.array(*cols).alias("ladder")).select(F.inline("ladder"))
