"""The expression-level study: clean, screen, standardise, compare factors."""

from __future__ import annotations

import math

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from brindle.operators import statistics
from brindle.operators.aggregates import (accuracy, boxplot_stats, column_moments, count_by, impute_group_median, moment_range,
                                          null_counts, proportions, sort_desc, top_k_features)
from brindle.operators.columns import (choose_features, drop_listed, features_to_array, scatter_projection, select_columns_where,
                                       unpivot_levels)
from brindle.operators.levels import category_levels
from brindle.operators.normality import mvn_doornik_hansen, mvn_henze_zirkler
from brindle.operators.split import random_guess, split_stratified_class
from brindle.plans import classifiers as cls
from brindle.sources.reports import stack_metrics
from brindle.storage import write_out

# Own names of the ten models, in ladder order.
LADDER = ["random guess", "tree, chosen columns", "neighbours, chosen columns", "forest, chosen columns", "tree, all columns",
          "neighbours, all columns", "forest, all columns", "tree, components", "neighbours, components", "forest, components"]
VOTERS = ["forest, all columns", "forest, components", "neighbours, components"]


# Rows of the table that the study's limit of missing cells was chosen on.
STUDY_ROWS = 1080


def drop_sparse_and_impute(df: DataFrame, cols: list[str], group: str, limit: int = 50) -> tuple[DataFrame, list[str]]:
    """Drop columns with more than ``limit`` missing cells, fill the rest by the group median.

    The limit holds for up to ``STUDY_ROWS`` rows and grows with the rows beyond, so that a larger table of
    the same kind keeps the same columns. Returns the table and its kept columns. One job decides the column list.
    """
    counts = null_counts(df.withColumn("__rows", F.lit(None)), [*cols, "__rows"])  # all cells of __rows are missing
    most = F.lit(float(limit)) * F.greatest(F.lit(1.0), F.col("__rows") / F.lit(float(STUDY_ROWS)))
    sparse = select_columns_where(counts.select(*[(F.col(c) > most).alias(c) for c in cols]), bool)
    kept = [c for c in cols if c not in sparse]
    return impute_group_median(drop_listed(df, sparse), group, kept), kept


def class_separation_profile(df: DataFrame, cols: list[str], factors: list[str]) -> DataFrame:
    """Box statistics (factor, level, protein) of every column against every factor, in one go."""
    long = unpivot_levels(df, factors, cols, "protein", "value")
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    return boxplot_stats(long.select("protein", "value", F.inline(each)), ["factor", "level", "protein"],
                         "value")


def standardize(train: DataFrame, apply_to: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores of ``apply_to`` with the means and sds (n - 1) of ``train``; null for a column without values."""
    moments = {r["name"]: r for r in column_moments(train, cols).collect()}  # one row per column
    number = lambda v: "cast(null AS double)" if v is None or math.isnan(v) else f"{v!r}D"
    scaled = {c: F.expr(f"(`{c}` - {number(moments[c]['mean'])}) / nullif({number(moments[c]['sd'])}, 0D)") for c in cols}
    return apply_to.withColumns(scaled)


def prepared_expression(df: DataFrame, cols: list[str], group: str) -> tuple[DataFrame, list[str]]:
    """The cleaned table written once, and its kept columns."""
    clean, kept = drop_sparse_and_impute(df, cols, group)
    return write_out(clean, "clean"), kept


def screen(df: DataFrame, cols: list[str], wanted: list[str], factors: list[str]) -> DataFrame:
    """The profile of chosen columns only; others are not read."""
    return class_separation_profile(df, choose_features(cols, wanted), factors)


def even_steps(end: float, n: int) -> list[float]:
    """``n`` values from 0 to ``end``."""
    return [end * i / (n - 1) for i in range(n)]


@dataclass(frozen=True)
class Effort:
    """Grids and repetitions of the tuning; the defaults are the study's."""

    complexities: list[float] = field(default_factory=lambda: even_steps(0.05, 40))
    neighbours: list[int] = field(default_factory=lambda: list(range(2, 21)))
    tried: list[int] = field(default_factory=lambda: list(range(1, 9)))
    component_complexities: list[float] = field(default_factory=lambda: even_steps(0.05, 20))  # of the last tree on components
    component_neighbours: list[int] = field(default_factory=lambda: list(range(2, 21, 2)))
    trees: int = 500
    resamples: int = 25
    size_trees: int = 100  # of a forest while the number of components is tuned


@dataclass(frozen=True)
class Inputs:
    """Training and test rows, also standardised and as scores of the training rows' components."""

    train: DataFrame
    test: DataFrame
    scaled: tuple[DataFrame, DataFrame]
    components: cls.Components
    scores: tuple[DataFrame, DataFrame]


def model_inputs(clean: DataFrame, cols: list[str], key: str, label: str, p: float, seed: int) -> Inputs:
    flagged = write_out(split_stratified_class(clean, label, p, [key], seed), "parts")
    train, test = flagged.filter("not held_out").drop("held_out"), flagged.filter("held_out").drop("held_out")
    scaled = tuple(write_out(standardize(train, d, cols), "scaled") for d in (train, test))
    found = cls.Components(scaled[0], cols)
    scores = tuple(write_out(found.project(d).select(key, label, "features"), "scores") for d in scaled)
    return Inputs(train, test, scaled, found, scores)


def component_sizes(inputs: Inputs, kind: str, key: str, label: str, effort: Effort) -> DataFrame:
    """(size, accuracy) for every number of leading components from 2 on: the best over the grid of this kind of model."""
    train, most = cls.scores_array(inputs.scores[0]), len(inputs.components.cols)
    sizes = list(range(min(2, most), most + 1))
    if kind == "neighbours":
        return cls.tune_components(cls.tune_knn(train, key, label, effort.component_neighbours, effort.resamples, sizes=sizes))
    if kind == "tree":
        return cls.tune_components(cls.tune_tree(train, key, label, effort.complexities, effort.resamples, sizes=sizes))
    return cls.tune_components(cls.tune_forest(train, key, label, effort.tried, effort.size_trees, effort.resamples, sizes=sizes))


def model_predictions(inputs: Inputs, name: str, cols: list[str], chosen: list[str], key: str, label: str, effort: Effort) -> DataFrame:
    """(key, label, predicted) of one model of the ladder: tuned, refitted on all training rows, applied to the test rows.

    On components their number is tuned first; the model is then tuned and fitted on that many.
    """
    if name == "random guess":
        guessed = random_guess(inputs.test, category_levels(inputs.train, label), [key], 7)
        return guessed.select(key, label, F.col("guess").cast("string").alias("predicted"))
    kind, on = name.split(", ")
    if on == "components":
        size = int(cls.best_value(component_sizes(inputs, kind, key, label, effort), "size", None))
        train, test = (cls.scores_array(cls.leading(d, size)) for d in inputs.scores)
    else:
        train, test = (features_to_array(d, {"chosen columns": chosen, "all columns": cols}[on]) for d in (inputs.train, inputs.test))
    if kind == "neighbours":
        return cls.tune_refit_score_knn(train, test, key, label, effort.component_neighbours if on == "components" else effort.neighbours, effort.resamples).predictions
    if kind == "tree":
        return cls.tune_refit_score_tree(train, test, key, label, effort.component_complexities if on == "components" else effort.complexities, effort.resamples).predictions
    return cls.tune_refit_score_forest(train, test, key, label, effort.tried, effort.trees, effort.resamples).predictions


def as_text(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.withColumn(label, F.col(label).cast("string"))


def accuracy_ladder(predictions: dict[str, DataFrame], label: str) -> DataFrame:
    metrics = [(name, accuracy(as_text(d, label), label, "predicted")) for name, d in predictions.items()]
    return sort_desc(stack_metrics(metrics, "accuracy"), "accuracy", "pos")


def ensemble(predictions: dict[str, DataFrame], key: str, label: str) -> DataFrame:
    """(key, label, ensemble): the vote of three models, the second deciding where all differ."""
    df = None
    for place, name in enumerate(VOTERS):
        one = as_text(predictions[name], label).withColumnRenamed("predicted", f"vote_{place}")
        df = one if df is None else df.join(one.drop(label), key)
    return cls.vote_ensemble(df, "vote_0", "vote_1", "vote_2").select(key, label, "ensemble")


def expression_report(df: DataFrame, cols: list[str], chosen: list[str], key: str, label: str, factors: list[str],
                      p: float = 0.4, seed: int = 4021, effort: Effort = Effort()) -> dict[str, DataFrame]:
    """The whole study as named tables: cleaning, balance, screening, normality, components, ten models, vote."""
    clean, kept = prepared_expression(df, cols, label)
    inputs = model_inputs(clean, kept, key, label, p, seed)
    train = inputs.train
    pairs = write_out(statistics.correlation_pairs(train, kept), "pairs")
    scores = cls.scores_array(inputs.scores[0])
    named = scores.select(label, *[F.col("features")[i].alias(f"PC{i + 1}") for i in range(min(4, len(kept)))])
    importance = write_out(cls.forest_importance(train, key, label, kept, 6, effort.trees)[1], "importance")
    models = {name: write_out(model_predictions(inputs, name, kept, chosen, key, label, effort), "predictions") for name in LADDER}
    voted = ensemble(models, key, label)
    return {
        "nulls": null_counts(df, cols), "clean": clean, "balance": proportions(clean, label),
        "train_balance": count_by(train, label), "test_balance": count_by(inputs.test, label),
        "moments": column_moments(train, kept), "moment_range": moment_range(train, kept),
        "near_zero_variance": statistics.near_zero_variance(train, kept), "correlations": pairs,
        "correlation_bands": statistics.correlation_bands(pairs, len(kept)),
        "doornik_hansen": mvn_doornik_hansen(train, kept), "henze_zirkler": mvn_henze_zirkler(train, kept, key),
        "separation": class_separation_profile(clean, kept, factors), "explained": inputs.components.explained(train),
        "loadings": inputs.components.loadings(train),
        "scatter": scatter_projection(named, list(zip(named.columns[1:], named.columns[2:])), label),
        "importance": importance, "top_features": top_k_features(importance, "importance", "feature", 20),
        "ladder": accuracy_ladder(models, label), "ensemble": voted, "ensemble_accuracy": accuracy(voted, label, "ensemble"),
    }
