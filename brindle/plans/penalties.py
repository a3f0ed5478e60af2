"""Penalty tuning by cross-validation from sufficient statistics.

The error of a held-out fold depends on the rows only through per-(key, fold) counts, sums and sums
of squares of the residual. One aggregation therefore serves every fold and every grid value: sums
outside a fold are totals minus the fold's own, and the grid is evaluated on groups, not on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from brindle.functions.numbers import double_array, grid_values, ratio
from brindle.operators.aggregates import arg_min_per_group
from brindle.operators.joins import grid_cross, null_safe_join
from brindle.plans.effects import Effect, next_cells, whole_cells
from brindle.storage import write_out

# Fixed grids: start, stop and step per effect.
GRIDS = {"me": grid_values(1, 3, 0.1), "ue": grid_values(3.5, 6.5, 0.1),
         "ge": grid_values(500, 700, 10), "ye": grid_values(0, 20, 1)}


def fold_means(train: DataFrame, fold: str, target: str) -> DataFrame:
    """(fold, mu): mean of the target outside each fold; one row per fold."""
    per_fold = train.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    every = W.partitionBy()
    return write_out(per_fold.select(fold, ((F.sum("s").over(every) - F.col("s"))
                                            / (F.sum("n").over(every) - F.col("n"))).alias("mu")), "fold-means")


def tuning_rows(train: DataFrame, effects: list[Effect], fold: str, target: str) -> DataFrame:
    """Cells with the fold and whether the row's first key also occurs outside its fold.

    A first key is unknown outside its fold exactly if all of its rows lie in one fold. The cells are written,
    since the sums and the residuals of the first effect read them.
    """
    first = effects[0].key
    spread = write_out(train.groupBy(first).agg((F.min(fold) != F.max(fold)).alias("known")), "spread")
    rows = null_safe_join(train, spread, [first])
    return write_out(rows.select(*[e.key for e in effects], fold, "known", F.col(target).alias("total")), "tuning-rows", compact=True)


def key_sums(cells: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """One row per (key, fold): all that the errors of the folds and the fit of the effect need."""
    scored = lambda c: F.sum(F.when(F.col("known"), F.col(c)).otherwise(0))
    return whole_cells(cells).groupBy(key, fold).agg(
        F.sum("rows").alias("n"), F.sum("total").alias("s"), F.count_if(F.col("total").isNull()).alias("missing"),
        scored("rows").alias("hn"), scored("total").alias("hs"), scored("square").alias("hq"))


def effect_from_sums(sums: DataFrame, effect: Effect, mu: float) -> DataFrame:
    """(key, effect) over all folds, equal to the fit on the cells."""
    total = F.when(F.sum("missing") == 0, F.sum("s") - F.lit(float(mu)) * F.sum("n"))
    fitted = sums.groupBy(effect.key).agg(ratio(total, F.sum("n") + F.lit(effect.penalty)).alias(effect.name))
    return write_out(fitted, f"effect-{effect.name}")


def tune_penalty(cells: DataFrame, key: str, means: DataFrame, grid: list[float], fold: str = "fold",
                 on_unseen: str = "propagate", lookup_grid: list[float] | None = None) -> DataFrame:
    """``penalty_errors`` of cells that carry ``known``; rows that are not known train but are not scored."""
    return penalty_errors(key_sums(cells, key, fold), key, means, grid, fold, on_unseen, lookup_grid)


def penalty_errors(sums: DataFrame, key: str, means: DataFrame, grid: list[float], fold: str = "fold",
                   on_unseen: str = "propagate", lookup_grid: list[float] | None = None) -> DataFrame:
    """(fold, pos, lam, rmse, part, unseen_key) for every fold and grid value.

    ``part`` is the squared error without the sum of squares that no penalty changes; penalties are
    compared by it, since the differences drown in the whole as groups grow. A scored group without
    rows outside the fold makes the error null and is named in ``unseen_key``, is left out, or counts
    as effect zero, by ``on_unseen``. ``lookup_grid`` reports the value at the same position of another grid.
    """
    group = W.partitionBy(key)  # at most one row per fold
    per = (sums.withColumn("cn", F.sum("n").over(group) - F.col("n"))
           .withColumn("cs", F.sum("s").over(group) - F.col("s"))
           .filter("hn > 0").join(F.broadcast(means), fold))
    unseen = F.col("cn") == 0
    if on_unseen == "drop":
        per = per.filter(~unseen)
    mu = F.col("mu")
    per = per.select(
        fold, "hn", unseen.alias("unseen"), F.when(unseen, F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("unseen_key"),
        "cn", (F.col("cs") - F.col("cn") * mu).alias("cs"), (F.col("hs") - F.col("hn") * mu).alias("hs"),
        (F.col("hq") - 2 * mu * F.col("hs") + F.col("hn") * mu * mu).alias("hq"))

    # the least text of a group can't be hashed on the way: every group at every grid value would be sorted
    names = [] if on_unseen == "drop" else [F.max("unseen").alias("unseen"), F.min("unseen_key").alias("unseen_key")]
    change = F.col("hn") * F.col("b") * F.col("b") - 2 * F.col("b") * F.col("hs")
    errors = (grid_cross(per, grid)
              .withColumn("b", F.when(F.col("unseen"), F.lit(0.0)).otherwise(F.col("cs") / (F.col("cn") + F.col("lam"))))
              .groupBy(fold, "pos", "lam").agg(F.sum(change).alias("part"), F.sum("hq").alias("hq"), F.sum("hn").alias("n"), *names))
    if not names:
        errors = errors.withColumn("unseen_key", F.lit(None).cast("string"))
    complete = ~F.col("unseen") if on_unseen == "propagate" else F.lit(True)
    value = F.when(complete, F.sqrt(F.greatest(F.col("hq") + F.col("part"), F.lit(0.0)) / F.col("n")))
    lam = F.element_at(double_array(lookup_grid), F.col("pos").cast("int")) if lookup_grid else F.col("lam")
    return errors.select(fold, F.col("pos").cast("bigint").alias("pos"), lam.alias("lam"), value.alias("rmse"),
                         F.when(complete, F.col("part")).alias("part"), "unseen_key")


def best_penalties(errors: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, best_pos, best, best_metric): the first of the least errors per fold, compared unrounded."""
    return arg_min_per_group(errors, [fold], "part", "pos", "lam", "rmse")


def tuned_penalty(errors: DataFrame, fold: str = "fold") -> float:
    """Mean over all folds of the best value; a fold without an error stops the tuning."""
    whole = errors.groupBy(fold).agg(F.count("part").alias("scored"), F.min("unseen_key").alias("key"))
    rows = whole.join(best_penalties(errors, fold), fold, "left").collect()  # one row per fold
    for row in rows:
        if not row["scored"]:
            raise ValueError(f"fold {row[fold]} has no error: key {row['key']} occurs in that fold only; choose on_unseen")
    return sum(row["best"] for row in rows) / len(rows)


def tune_effects(train: DataFrame, effects: list[Effect], mu: float, fold: str = "fold",
                 target: str = "rating", grids: dict[str, list[float]] | None = None,
                 lookup_grids: dict[str, list[float]] | None = None,
                 on_unseen: str = "drop") -> list[tuple[Effect, DataFrame]]:
    """Tune and fit the effects in order; each is tuned with the earlier ones fitted on all of ``train``.

    A key whose rows all lie in one fold has no effect outside it. Such rows are not scored unless
    ``on_unseen`` says otherwise: with "propagate" the first such fold stops the tuning.
    """
    grids = grids or GRIDS
    means = fold_means(train, fold, target)
    cells = tuning_rows(train, effects, fold, target)
    fitted = []
    for i, effect in enumerate(effects):
        sums = write_out(key_sums(cells, effect.key, fold), "key-sums", compact=True)
        errors = penalty_errors(sums, effect.key, means, grids[effect.name], fold, on_unseen,
                                (lookup_grids or {}).get(effect.name))
        effect = effect.with_penalty(tuned_penalty(errors, fold))
        table = effect_from_sums(sums, effect, mu)
        fitted.append((effect, table))
        later = list(effects[i + 1:])
        if later:
            cells = next_cells(cells, effect, table, later, [fold, "known"])
    return fitted
