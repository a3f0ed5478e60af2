"""Aggregations, proportions, distribution summaries and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.functions.missing import is_missing, strict_avg, strict_sum
from brindle.functions.numbers import ratio, squared_error
from brindle.operators.columns import unpivot_levels
from brindle.operators.joins import null_safe_join
from brindle.operators.ordering import ranged, running_sum
from brindle.operators.quantiles import exact_quantiles
from brindle.storage import write_out


def global_mean(df: DataFrame, col: str, na_rm: bool = False) -> DataFrame:
    return df.agg(strict_avg(F.col(col), na_rm).alias("mean"))


def group_mean(df: DataFrame, key: str, value: str, more_than: int | None = None) -> DataFrame:
    """Mean and row count per group, for groups with strictly more than ``more_than`` rows."""
    means = df.groupBy(key).agg(F.avg(value).alias("avg"), F.count(F.lit(1)).alias("n"))
    return means if more_than is None else means.filter(F.col("n") > more_than)


def group_mean_filtered(df: DataFrame, key: str, value: str, keep: list) -> DataFrame:
    return df.filter(F.col(key).isin(keep)).groupBy(key).agg(F.avg(value).alias("avg"))


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, a null counting as one more value."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[(count(F.col(c)) + F.max(F.col(c).isNull().cast("bigint"))).alias(c) for c in cols])


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def proportions(df: DataFrame, key: str) -> DataFrame:
    """Share of the non-null rows per class."""
    total = df.agg(F.count(key)).scalar()
    counted = count_by(df.filter(F.col(key).isNotNull()), key)
    return counted.withColumn("share", F.col("n") / total)


def two_level_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per group, then mean, sd, minimum, median and maximum over the groups."""
    means = write_out(df.groupBy(key).agg(F.avg(value).alias("avg")), "means")
    median = exact_quantiles(means, [], "avg", [0.5]).select(F.col("quantiles")[0]).scalar()
    stats = means.agg(F.avg("avg").alias("mean_avg"), F.stddev_samp("avg").alias("sd_avg"),
                      F.min("avg").alias("min_avg"), F.max("avg").alias("max_avg"))
    return stats.withColumn("median_avg", median)


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: missing cells per column."""
    floating = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.agg(*[F.count_if(is_missing(F.col(c), c in floating)).alias(c) for c in cols])


def shrunken_effect(df: DataFrame, key: str, residual: Column, penalty: float | Column,
                    name: str = "effect", rows: Column | None = None) -> DataFrame:
    """Sum of residuals over (rows + penalty) per group.

    Every row of the group counts, and a null residual makes the effect null. ``rows`` is given when
    the input is pre-aggregated and ``residual`` already a sum over that many rows.
    """
    count = F.count(F.lit(1)) if rows is None else F.sum(rows)
    penalty = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    return df.groupBy(key).agg(ratio(strict_sum(residual), count + penalty).alias(name))


def rmse(df: DataFrame, y: str | Column, yhat: str | Column, na_rm: bool = False) -> DataFrame:
    y, yhat = (F.col(c) if isinstance(c, str) else c for c in (y, yhat))
    return df.agg(F.sqrt(strict_avg(squared_error(y, yhat), na_rm)).alias("rmse"))


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def column_summary(df: DataFrame, numeric: list[str], text: list[str] = ()) -> DataFrame:
    """One row per column: extremes, quartiles, mean and nulls for numbers, length for text."""
    long = unpivot_levels(df.select(*[F.col(c).cast("double").alias(c) for c in numeric]),
                          [], numeric, "name", "value")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    moments = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("length"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["name"], "value", [0.25, 0.5, 0.75]).select(
        "name", *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))])
    out = moments.join(quartiles, "name", "left")
    if text:
        lengths = unpivot_levels(df, [], list(text), "name", "value").groupBy("name").agg(
            F.count(F.lit(1)).alias("length"), F.count_if(F.col("value").isNull()).alias("nulls"))
        out = out.unionByName(lengths, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def column_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, mean, sd, variance) per column, missing values left out."""
    long = unpivot_levels(df, [], cols, "name", "value").filter(~F.isnan("value"))
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                    F.var_samp("value").alias("variance"))


def moment_range(df: DataFrame, cols: list[str]) -> DataFrame:
    return column_moments(df, cols).agg(
        F.min("sd").alias("min_sd"), F.max("sd").alias("max_sd"),
        F.min("variance").alias("min_variance"), F.max("variance").alias("max_variance"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin over [min, max], the last one closed; empty bins included."""
    extremes = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = extremes.select("lo").scalar(), extremes.select("hi").scalar()
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.floor(ratio(F.col(col) - F.col("lo"), width)) + 1
    counted = (df.filter(F.col(col).isNotNull()).select(F.col(col), lo.alias("lo"), hi.alias("hi"))
               .groupBy(F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    frame = (df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"), lo.alias("lo"), hi.alias("hi"))
             .select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("left_edge"),
                     (F.col("lo") + F.col("bin") * width).alias("right_edge")))
    return frame.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def boxplot_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outliers per group."""
    boxes = exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
    boxes = write_out(boxes.select(*by, "n", *[F.col("quantiles")[i].alias(q)
                                              for i, q in enumerate(("q1", "median", "q3"))]), "boxes")
    v = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    rows = df.select(*by, value).filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    return (null_safe_join(rows, boxes, by, "inner").groupBy(*by, "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"),
                 F.count_if(~inside).alias("outliers")))


def mean_of_tuned(best: DataFrame, col: str) -> DataFrame:
    return best.agg(F.avg(col).alias("tuned"))


def group_medians(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """One row per group: the group, and its median of every column in a column of the same name."""
    long = unpivot_levels(df, [group], cols, "name", "value")
    medians = exact_quantiles(long, [group, "name"], "value", [0.5])
    return medians.groupBy(group).agg(*[F.max(F.when(F.col("name") == c, F.col("quantiles")[0])).alias(c) for c in cols])


def impute_group_median(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Fill missing cells by the median of the same group; a group without values stays as it is."""
    medians = write_out(group_medians(df, group, cols), "medians")
    joined = null_safe_join(df, medians.select(group, F.struct(*cols).alias("__medians")), [group])
    filled = {c: F.when(is_missing(F.col(c)), F.col("__medians")[c]).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(filled).drop("__medians")


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Each row's share of the total and the running share, for tables of any length."""
    total = df.agg(F.sum(value)).scalar()
    shares = ranged(df.withColumn("share", F.col(value) / total), [order], "shares")
    return running_sum(shares, [], [order], F.col("share"), "cumulative").drop("__part")


def arg_min_per_group(df: DataFrame, group: list[str], metric: str, pos: str, value: str, report: str | None = None) -> DataFrame:
    """Value at the least metric per group: nulls ignored, the first position wins a tie.

    ``report`` names another column to return in place of the metric.
    """
    best = F.min(F.struct(*[F.col(c) for c in dict.fromkeys([metric, pos, value, report or metric])]))
    return (df.filter(F.col(metric).isNotNull()).groupBy(*group).agg(best.alias("b"))
            .select(*group, F.col(f"b.{pos}").alias("best_pos"), F.col(f"b.{value}").alias("best"),
                    F.col(f"b.{report or metric}").alias("best_metric")))


def arg_max(df: DataFrame, metric: str, pos: str) -> DataFrame:
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(pos)))
    return (df.filter(F.col(metric).isNotNull()).agg(best.alias("b"))
            .select(F.col(f"b.{pos}").alias("best_pos"), (-F.col("b.m")).alias("best_metric")))


def sort_desc(df: DataFrame, metric: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(tie))


def top_k_features(df: DataFrame, metric: str, tie: str, k: int) -> DataFrame:
    return sort_desc(df, metric, tie).limit(k)
