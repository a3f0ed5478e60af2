"""Near-zero variance, correlation and one-way analysis of variance."""

from __future__ import annotations

from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window as W, functions as F

from brindle.functions.numbers import ratio
from brindle.functions.tails import f_tail_column
from brindle.operators.columns import features_to_vector, unpivot_levels
from brindle.storage import write_out


def near_zero_variance(df: DataFrame, cols: list[str], freq_cut: float = 95 / 5,
                       unique_cut: float = 10.0) -> DataFrame:
    """(name, freq_ratio, percent_unique, zero_variance, near_zero) per column."""
    long = unpivot_levels(df, [], cols, "name", "value")
    counts = (long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("known", F.col("value").isNotNull()))
    totals = counts.groupBy("name").agg(F.sum("n").alias("rows"), F.count_if("known").alias("values"))
    # The rank limit runs before the shuffle, so a column sends two rows per input partition.
    place = F.row_number().over(W.partitionBy("name").orderBy(F.col("n").desc(), "value"))
    top = counts.filter("known").withColumn("place", place).filter("place <= 2").groupBy("name").agg(
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"))
    single = F.col("values") <= 1
    out = totals.join(top, "name", "left").select(
        "name", F.coalesce(F.col("first") / F.col("second"), F.lit(0.0)).alias("freq_ratio"),
        (100.0 * F.col("values") / F.col("rows")).alias("percent_unique"), single.alias("zero_variance"))
    rare = (F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut)
    return out.withColumn("near_zero", F.col("zero_variance") | rare)


def correlation_matrix(df: DataFrame, cols: list[str]):
    """Pearson matrix as a numpy array; columns squared in size, whatever the number of rows."""
    vectors = features_to_vector(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    return Correlation.corr(vectors.select("features"), "features").head()[0].toArray()


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_i, col_j, r) for the upper triangle."""
    r = correlation_matrix(df, cols)
    rows = [(cols[i], cols[j], float(r[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "col_i string, col_j string, r double")


def correlation_bands(pairs: DataFrame, columns: int, cutoffs: tuple[float, ...] = (0.9, 0.7, 0.5),
                      denominator: str = "full") -> DataFrame:
    """Share of pairs above each cutoff, of the full square or of the distinct pairs."""
    whole = columns * columns if denominator == "full" else columns * (columns - 1) / 2
    counted = pairs.agg(F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), (F.count_if(F.abs("r") > c) / F.lit(float(whole))).alias("share"))
        for c in cutoffs]).alias("bands"))
    return counted.select(F.inline("bands"))


def anova_oneway(df: DataFrame, y: str, group: str, p_value: bool = True) -> DataFrame:
    """Sums of squares, degrees of freedom, F and its upper tail, from per-group moments."""
    groups = write_out(
        df.filter(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
            F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("within")), "groups")
    grand = groups.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    out = (groups.withColumn("grand", grand)
           .agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("ss_between"),
                F.sum("within").alias("ss_within"),
                (F.count(F.lit(1)) - 1).alias("df_between"),
                (F.sum("n") - F.count(F.lit(1))).alias("df_within"))
           .withColumn("f", ratio(ratio(F.col("ss_between"), F.col("df_between")),
                                  ratio(F.col("ss_within"), F.col("df_within")))))
    return out.withColumn("p", f_tail_column(F.col("f"), F.col("df_between"), F.col("df_within"))) if p_value else out
