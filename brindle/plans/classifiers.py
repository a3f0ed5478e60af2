"""Trees, forests, neighbours and principal components: fit, tune, compare, vote."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, ElementwiseProduct, IndexToString, StringIndexer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window as W, functions as F

from brindle.functions.hashing import hash_integer, row_hash
from brindle.operators.aggregates import cumulative_share
from brindle.operators.columns import features_to_array, features_to_vector
from brindle.operators.neighbours import classify_knn, votes_of_resamples
from brindle.operators.split import resample_weight
from brindle.plans import trees
from brindle.storage import write_out

SEED = 4021  # fixed seed of the fits


def with_label_index(train: DataFrame, label: str) -> StringIndexer:
    """Label codes in the order of the sorted levels."""
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)


def fit_tree(train: DataFrame, min_info_gain: float = 0.0, weight: str | None = None, max_depth: int = 30,
             min_rows: int = 7, features: str = "features") -> Model:
    """Classification tree. The complexity grid becomes a grid over the least gain of a split."""
    tree = DecisionTreeClassifier(featuresCol=features, labelCol="label_index", impurity="gini", maxDepth=max_depth,
                                  minInstancesPerNode=min_rows, minInfoGain=min_info_gain, seed=SEED)
    return (tree.setWeightCol(weight) if weight else tree).fit(train)


def fit_forest(train: DataFrame, mtry: int, trees: int = 500, weight: str | None = None, max_depth: int = 20,
               features: str = "features") -> Model:
    """Random forest that tries ``mtry`` features per split."""
    forest = RandomForestClassifier(featuresCol=features, labelCol="label_index", impurity="gini", numTrees=trees,
                                    featureSubsetStrategy=str(mtry), maxDepth=max_depth, seed=SEED)
    return (forest.setWeightCol(weight) if weight else forest).fit(train)


def predict_labels(model: Model, df: DataFrame, levels: list[str], name: str = "predicted") -> DataFrame:
    names = IndexToString(inputCol="prediction", outputCol=name, labels=levels)
    return names.transform(model.transform(df)).drop("rawPrediction", "probability", "prediction")


def classify(train: DataFrame, test: DataFrame, cols: list[str], label: str,
             fit: Callable[[DataFrame], Model]) -> tuple[DataFrame, Model]:
    """Predictions for ``test`` (its columns plus ``predicted`` as text), and the fitted model."""
    index = with_label_index(train, label)
    model = fit(index.transform(features_to_vector(train, cols)))
    return predict_labels(model, features_to_vector(test, cols), index.labels).drop("features"), model


def gini_importance(model: Model, cols: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance) scaled so that the least is 0 and the largest 100."""
    values = model.featureImportances.toArray()
    low, span = values.min(), (values.max() - values.min()) or 1.0
    rows = [(c, float(100.0 * (v - low) / span)) for c, v in zip(cols, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model: Model, scored: DataFrame, cols: list[str], key: str, seed: int = SEED,
                           block_rows: int = 10000) -> DataFrame:
    """(feature, importance): loss of accuracy when one feature is taken from another random row.

    Rows are dealt into random blocks by a hash of the key, and each takes the feature of the next
    row of its block, the last that of the first: a permutation, made by windows of bounded size.
    ``scored`` has ``features`` and ``label_index``.
    """
    blocks = max(1, math.ceil(scored.count() / block_rows))
    h = row_hash([key], seed)
    dealt = (scored.select(key, "label_index", vector_to_array("features").alias("x")).withColumn("__h", h)
             .withColumn("__block", F.pmod(hash_integer(F.reverse("__h")), F.lit(blocks))))
    order = W.partitionBy("__block").orderBy("__h")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    donor = F.coalesce(F.lead("x").over(order), F.first("x").over(whole))
    changed = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("donor", i)).otherwise(v))
    # j = -1 changes nothing and gives the accuracy to compare with.
    rows = (dealt.withColumn("donor", donor)
            .withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
            .select("j", "label_index", array_to_vector(changed).alias("features")))
    hits = model.transform(rows).groupBy("j").agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double")).alias("a"))
    hits = write_out(hits, "hits")
    base = hits.filter("j = -1").select("a").scalar()
    names = F.expr("array(" + ", ".join(f"'{c}'" for c in cols) + ")")
    return hits.filter("j >= 0").select(F.get(names, F.col("j")).alias("feature"), (base - F.col("a")).alias("importance"))


def in_threads(tasks: list[Callable], parallelism: int) -> list:
    """Run driver-side fits side by side; each is a set of Spark jobs."""
    if parallelism <= 1:
        return [task() for task in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(task)) for task in tasks]]


def tune_classifier(train: DataFrame, key: str, fit: Callable[[DataFrame, float], Model], grid: list[float],
                    resamples: int = 25, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """(pos, value, accuracy): mean accuracy on the held-out rows of weighted resamples.

    ``train`` has ``features`` and ``label_index``; ``fit(rows, value)`` must use the column ``weight``,
    which is an expression of the row's key: no copy of the rows is made.
    """
    whole = write_out(train.select(key, "features", "label_index"), "tuning")

    def held_out_accuracy(resample: int, value: float) -> float | None:
        rows = whole.withColumn("weight", resample_weight([key], seed, resample))
        scored = fit(rows.filter("weight > 0"), value).transform(rows.filter("weight = 0"))
        return scored.agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0]

    cells = [(i, float(v), b) for i, v in enumerate(grid, start=1) for b in range(1, resamples + 1)]
    found = in_threads([lambda v=v, b=b: held_out_accuracy(b, v) for _, v, b in cells], parallelism)
    rows = [(i, v, b, a) for (i, v, b), a in zip(cells, found)]
    table = train.sparkSession.createDataFrame(rows, "pos bigint, value double, resample bigint, accuracy double")
    return table.groupBy("pos", "value").agg(F.avg("accuracy").alias("accuracy"))


def tune_tree(train: DataFrame, key: str, label: str, complexities: list[float], resamples: int = 25, seed: int = SEED,
              sizes: list[int] | None = None, features: str = "features") -> DataFrame:
    """(size, pos, value, accuracy) of trees pruned to every complexity, for every number of leading features, in one job."""
    data = trees.binned(train, key, label, resamples, seed, features)
    return trees.tune_trees(data, complexities, sizes or [len(data.edges)], resamples)


def tune_forest(train: DataFrame, key: str, label: str, tried: list[int], number: int = 500, resamples: int = 25, seed: int = SEED,
                sizes: list[int] | None = None, features: str = "features") -> DataFrame:
    """(size, pos, value, accuracy) of forests for every number of tried features and of leading features, in one job."""
    data = trees.binned(train, key, label, resamples, seed, features)
    return trees.tune_forests(data, tried, sizes or [len(data.edges)], resamples, number)


def best_value(tuned: DataFrame, value: str = "value", pos: str | None = "pos") -> float:
    """The first value of the highest accuracy."""
    first = F.min(F.struct((-F.col("accuracy")).alias("a"), F.col(pos or value).alias("p"), F.col(value).alias("v")))
    return tuned.filter("accuracy IS NOT NULL").agg(first.alias("b")).first()["b"]["v"]


@dataclass(frozen=True)
class Tuned:
    """The outcome of tuning, refitting and scoring: the grid's accuracies, the value taken, the predictions."""

    table: DataFrame
    best: float
    predictions: DataFrame  # key, label, predicted


def classify_tree(train: DataFrame, test: DataFrame, key: str, label: str, complexity: float, seed: int = SEED, features: str = "features") -> DataFrame:
    """(key, label, predicted) of one tree of all training rows, pruned by weakest links."""
    data = trees.binned(train, key, label, 0, seed, features)
    return trees.predict(data, trees.fit_tree(data, complexity), test, key, label, features)


def classify_forest(train: DataFrame, test: DataFrame, key: str, label: str, tried: int, number: int = 500, seed: int = SEED,
                    features: str = "features") -> DataFrame:
    """(key, label, predicted) of a forest of all training rows."""
    data = trees.binned(train, key, label, 0, seed, features)
    return trees.predict(data, trees.fit_forest(data, tried, number), test, key, label, features)


def forest_importance(train: DataFrame, key: str, label: str, cols: list[str], tried: int, number: int = 500, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(feature, importance) twice: the mean loss of out-of-bag accuracy, and that loss in standard errors, scaled to 0 to 100."""
    found = write_out(trees.forest_importance(trees.binned(features_to_array(train, cols), key, label, 0, seed), tried, number), "importance")
    return found.select(F.get(F.lit(cols), F.col("feature")).alias("feature"), "importance"), trees.named_importance(found, cols)


def tune_refit_score_tree(train: DataFrame, test: DataFrame, key: str, label: str, complexities: list[float], resamples: int = 25,
                          features: str = "features") -> Tuned:
    """Tune the complexity on the training rows, fit them all with the best, predict the test rows."""
    table = write_out(tune_tree(train, key, label, complexities, resamples, features=features), "tuned")
    best = best_value(table)
    return Tuned(table, best, classify_tree(train, test, key, label, best, features=features))


def tune_refit_score_forest(train: DataFrame, test: DataFrame, key: str, label: str, tried: list[int], number: int = 500,
                            resamples: int = 25, features: str = "features") -> Tuned:
    """The same for the number of features that a split of a forest tries."""
    table = write_out(tune_forest(train, key, label, tried, number, resamples, features=features), "tuned")
    best = best_value(table)
    return Tuned(table, best, classify_forest(train, test, key, label, int(best), number, features=features))


def tune_refit_score_knn(train: DataFrame, test: DataFrame, key: str, label: str, ks: list[int], resamples: int = 25,
                         features: str = "features") -> Tuned:
    """The same for the number of neighbours; ``features`` is an array column."""
    table = write_out(tune_knn(train, key, label, ks, resamples, features=features), "tuned")
    best = int(best_value(table, "k", None))
    predicted = classify_knn(train, test, key, label, best, features)
    return Tuned(table, best, test.select(key, label).join(predicted, key).withColumn("predicted", F.col("predicted").cast("string")))


def tune_knn(train: DataFrame, key: str, label: str, ks: list[int], resamples: int = 25, seed: int = SEED,
             sizes: list[int] | None = None, features: str = "features") -> DataFrame:
    """(size, k, accuracy) for every k, and every number of leading features, from one pass of comparisons."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: resample_weight([key], seed, b))
    per = votes_of_resamples(train, key, label, ks, draws, features, sizes)
    accuracy = F.when(F.col("n") > 0, F.col("hits") / F.col("n"))
    return per.groupBy("size", "k").agg(F.avg(accuracy).alias("accuracy"))


class Components:
    """Principal components of standardised columns, each with its largest loading positive."""

    def __init__(self, train: DataFrame, cols: list[str], k: int | None = None):
        self.cols = cols
        vectors = features_to_vector(train, cols, "raw")
        self.model = PCA(k=k or len(cols), inputCol="raw", outputCol="unsigned").fit(vectors)
        loadings = self.model.pc.toArray()
        largest = abs(loadings).argmax(axis=0)
        self.signs = [1.0 if loadings[i, j] >= 0 else -1.0 for j, i in enumerate(largest)]

    def project(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Scores of standardised rows as a vector column."""
        signed = ElementwiseProduct(scalingVec=Vectors.dense(self.signs), inputCol="unsigned", outputCol=name)
        return signed.transform(self.model.transform(features_to_vector(df, self.cols, "raw"))).drop("raw", "unsigned")

    def loadings(self, df: DataFrame) -> DataFrame:
        """(feature, component, loading)."""
        m = self.model.pc.toArray() * self.signs
        rows = [(c, j + 1, float(m[i, j])) for i, c in enumerate(self.cols) for j in range(m.shape[1])]
        return df.sparkSession.createDataFrame(rows, "feature string, component bigint, loading double")

    def explained(self, df: DataFrame) -> DataFrame:
        """(component, variance_share, share, cumulative) in component order."""
        rows = [(i, float(v)) for i, v in enumerate(self.model.explainedVariance.toArray(), start=1)]
        table = df.sparkSession.createDataFrame(rows, "component bigint, variance_share double")
        return cumulative_share(table, "component", "variance_share")


def leading(df: DataFrame, size: int, source: str = "features", name: str = "features") -> DataFrame:
    """Only the first ``size`` entries of a vector column."""
    cut = VectorSlicer(inputCol=source, outputCol="__cut", indices=list(range(size))).transform(df)
    return cut.drop(source).withColumnRenamed("__cut", name)


def tune_components(tuned: DataFrame) -> DataFrame:
    """(size, accuracy): the best accuracy over the grid with each number of leading components."""
    return tuned.groupBy("size").agg(F.max("accuracy").alias("accuracy"))


def vote_ensemble(df: DataFrame, first: str, second: str, third: str, name: str = "ensemble") -> DataFrame:
    """Majority of three predictions; three different ones fall to the second."""
    a, b, c = F.col(first), F.col(second), F.col(third)
    return df.withColumn(name, F.when((a == b) | (a == c), a).otherwise(b))


def scores_array(df: DataFrame, name: str = "features") -> DataFrame:
    return df.withColumn(name, vector_to_array(name))
