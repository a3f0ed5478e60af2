"""Multivariate normality: the Doornik-Hansen and the Henze-Zirkler test.

Only p x p matrices and p sums reach the driver. The matrix products over rows run in the tasks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brindle.functions.tails import chi2_tail, normal_tail
from brindle.operators.aggregates import column_moments
from brindle.operators.columns import features_to_array
from brindle.operators.statistics import correlation_matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=cols)


def _moments(df: DataFrame, cols: list[str]):
    """Rows, means, sds (divisor n) and correlation matrix."""
    n = df.count()
    found = {r["name"]: r for r in column_moments(df, cols).collect()}
    mean = np.array([found[c]["mean"] for c in cols])
    sd = np.array([found[c]["sd"] for c in cols]) * math.sqrt((n - 1) / n)
    return n, mean, sd, correlation_matrix(df, cols)


def mvn_doornik_hansen(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (n, p, statistic, df, p_value): transformed skewness and kurtosis of rotated columns."""
    df = _complete(df, cols)
    n, mean, sd, corr = _moments(df, cols)
    eigenvalues, h = np.linalg.eigh(corr)
    rotate = h @ np.diag(eigenvalues ** -0.5) @ h.T
    p = len(cols)

    def power_sums(batches):
        total = np.zeros((p, 4))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            r = ((x - mean) / sd) @ rotate
            total += np.stack([(r ** k).sum(axis=0) for k in (1, 2, 3, 4)], axis=1)
        yield pa.RecordBatch.from_pydict({"j": np.arange(p, dtype="int64"),
                                          **{f"s{k}": total[:, k - 1] for k in (1, 2, 3, 4)}})

    sums = (features_to_array(df, cols).select("features")
            .mapInArrow(power_sums, "j bigint, s1 double, s2 double, s3 double, s4 double")
            .groupBy("j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3, 4)])
            .orderBy("j").collect())
    m1, m2, m3, m4 = (np.array([row[f"s{k}"] for row in sums]) / n for k in (1, 2, 3, 4))
    variance = m2 - m1 ** 2
    skew = (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / variance ** 1.5
    kurtosis = (m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4) / variance ** 2
    statistic = float((_skew_score(skew, n) ** 2 + _kurtosis_score(skew, kurtosis, n) ** 2).sum())
    return df.sparkSession.createDataFrame(
        [(n, p, statistic, 2 * p, chi2_tail(statistic, 2 * p))],
        "n bigint, p bigint, statistic double, df bigint, p_value double")


def _skew_score(skew, n: int):
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    y = skew * math.sqrt((w2 - 1) * (n + 1) * (n + 3) / (12.0 * (n - 2)))
    return np.arcsinh(y) / math.sqrt(math.log(math.sqrt(w2)))


def _kurtosis_score(skew, kurtosis, n: int):
    b1 = skew ** 2
    d = (n - 3.0) * (n + 1) * (n * n + 15 * n - 4)
    a = (n - 2.0) * (n + 5) * (n + 7) * (n * n + 27 * n - 70) / (6 * d)
    c = (n - 7.0) * (n + 5) * (n + 7) * (n * n + 2 * n - 5) / (6 * d)
    k = (n + 5.0) * (n + 7) * (n ** 3 + 37 * n * n + 11 * n - 313) / (12 * d)
    alpha = a + b1 * c
    chi = 2 * k * (kurtosis - 1 - b1)
    return (np.cbrt(chi / (2 * alpha)) - 1 + 1 / (9 * alpha)) * np.sqrt(9 * alpha)


def mvn_henze_zirkler(df: DataFrame, cols: list[str], key: str, block_rows: int = 2048) -> DataFrame:
    """One row (n, p, statistic, p_value) from the kernel sum over all pairs of rows.

    Rows are dealt into blocks of about ``block_rows`` by a hash of ``key``. A task takes one pair of
    blocks and returns two numbers, so no pair of rows is ever written. The work is quadratic in the
    rows by definition of the test.
    """
    df = _complete(df, cols)
    n, mean, sd, corr = _moments(df, cols)
    p = len(cols)
    eigenvalues, h = np.linalg.eigh(corr * np.outer(sd, sd))
    whiten = h @ np.diag(eigenvalues ** -0.5)
    beta = (n * (2 * p + 1) / 4.0) ** (1.0 / (p + 4)) / math.sqrt(2.0)
    blocks = max(1, math.ceil(n / block_rows))

    def kernel_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        rows = (np.vstack(pdf["features"].to_numpy()) - mean) @ whiten
        member = pdf["block"].to_numpy()
        a, b = rows[member == i], rows[member == j]
        na, nb = (a ** 2).sum(axis=1), (b ** 2).sum(axis=1)
        distance = np.maximum(na[:, None] + nb[None, :] - 2 * a @ b.T, 0.0)
        pairs = np.exp(-beta ** 2 / 2 * distance).sum() * (1 if i == j else 2)
        single = np.exp(-beta ** 2 / (2 * (1 + beta ** 2)) * na).sum() if i == j else 0.0
        return pd.DataFrame({"pairs": [pairs], "single": [single]})

    dealt = (features_to_array(df, cols)
             .select("features", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("features", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    sums = (dealt.groupBy("i", "j").applyInPandas(kernel_sums, "pairs double, single double")
            .agg(F.sum("pairs").alias("pairs"), F.sum("single").alias("single")).first())
    b2 = beta ** 2
    statistic = (sums["pairs"] / n - 2 * (1 + b2) ** (-p / 2) * sums["single"] + n * (1 + 2 * b2) ** (-p / 2))
    return df.sparkSession.createDataFrame(
        [(n, p, float(statistic), _henze_zirkler_tail(statistic, b2, p))],
        "n bigint, p bigint, statistic double, p_value double")


def _henze_zirkler_tail(statistic: float, b2: float, p: int) -> float:
    a, w = 1 + 2 * b2, (1 + b2) * (1 + 3 * b2)
    mu = 1 - a ** (-p / 2) * (1 + p * b2 / a + p * (p + 2) * b2 ** 2 / (2 * a ** 2))
    s2 = (2 * (1 + 4 * b2) ** (-p / 2)
          + 2 * a ** (-p) * (1 + 2 * p * b2 ** 2 / a ** 2 + 3 * p * (p + 2) * b2 ** 4 / (4 * a ** 4))
          - 4 * w ** (-p / 2) * (1 + 3 * p * b2 ** 2 / (2 * w) + p * (p + 2) * b2 ** 4 / (2 * w ** 2)))
    # With many columns the variance is far below one: log1p keeps it.
    spread = math.log1p(s2 / mu ** 2)
    location, scale = math.log(mu) - spread / 2, math.sqrt(spread)
    return normal_tail((math.log(statistic) - location) / scale)
