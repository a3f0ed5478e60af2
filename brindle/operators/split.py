"""Reproducible hold-outs and folds.

Rows are ordered by a hash of their key. A hold-out of ``r`` rows is then every row whose hash is
not above the r-th smallest one, so the split needs only that one hash per stratum: rows are never
shuffled or sorted, however large a stratum is. The r-th smallest hash is found by counting rows
per (stratum, hash prefix) and ranking the one prefix that holds rank r.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.functions.hashing import hash_fraction, hash_integer, row_hash
from brindle.operators.joins import null_safe_join, semi_join_keys
from brindle.operators.quantiles import quantile_literals
from brindle.storage import write_out

_QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


# Strata up to which the cut hashes travel as literals; beyond, as a table joined to the rows.
LITERAL_STRATA = 100


# Rows up to which the table of wanted ranks is broadcast.
BROADCAST_RANKS = 5000
# Rows of one hash prefix that a single task may sort; a longer prefix is tried beyond.
PREFIX_ROWS = 5_000_000


def _prefix_ranks(rows: DataFrame, strata: list[str], ranks: Callable[[Column], Column]) -> DataFrame:
    """(strata, __prefix, __rows, __pos): where in which prefix the wanted ranks lie."""
    stratum = W.partitionBy(*strata)
    upto = stratum.orderBy("__prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_prefix = (rows.groupBy(*strata, "__prefix").agg(F.count(F.lit(1)).alias("__rows"))
                  .withColumn("__n", F.sum("__rows").over(stratum))
                  .withColumn("__end", F.sum("__rows").over(upto))
                  .withColumn("__before", F.col("__end") - F.col("__rows")))
    here = F.filter(ranks(F.col("__n")), lambda r: (r > F.col("__before")) & (r <= F.col("__end")))
    return per_prefix.select(*strata, "__prefix", "__rows",
                             F.explode(F.transform(here, lambda r: r - F.col("__before"))).alias("__pos"))


def _small_or_written(ranks: DataFrame) -> tuple[DataFrame, int]:
    """The table as a broadcast of checked size, or else written out; and its largest prefix."""
    found = ranks.limit(BROADCAST_RANKS + 1).collect()
    if len(found) <= BROADCAST_RANKS:
        table = ranks.sparkSession.createDataFrame(found, ranks.schema)
        return F.broadcast(table), max((r["__rows"] for r in found), default=0)
    table = write_out(ranks, "ranks")
    return table, table.agg(F.max("__rows")).first()[0]


def hash_cuts(hashed: DataFrame, strata: list[str], ranks: Callable[[Column], Column],
              prefix_digits: int = 3, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(strata, __cuts): the hashes ``__h`` at the 1-based ``ranks(n)`` of every stratum, ascending."""
    while True:
        rows = hashed.select(*strata, "__h", F.substring("__h", 1, prefix_digits).alias("__prefix"))
        wanted, largest = _small_or_written(_prefix_ranks(rows, strata, ranks))
        if largest <= prefix_rows or prefix_digits >= 12:
            break
        prefix_digits += 2
    wanted = wanted.drop("__rows")
    near = null_safe_join(rows, wanted.select(*strata, "__prefix").distinct(), [*strata, "__prefix"], "left_semi")
    place = F.row_number().over(W.partitionBy(*strata, "__prefix").orderBy("__h"))
    copies = F.count(F.lit(1)).over(W.partitionBy(*strata, "__prefix", "__h"))
    ranked = near.withColumn("__pos", place.cast("bigint")).withColumn("__copies", copies)
    hits = null_safe_join(ranked, wanted, [*strata, "__prefix", "__pos"], "inner")
    # a cut through rows of one key would take all or none of them
    unique = F.when(F.col("__copies") > 1, F.raise_error(F.lit("the key is not unique per row")).cast("string")).otherwise(F.col("__h"))
    hits = hits.withColumn("__h", unique)
    return hits.groupBy(*strata).agg(F.sort_array(F.collect_list("__h")).alias("__cuts"))


def _held_out_rows(p: float) -> Callable[[Column], Column]:
    return lambda n: F.array(F.ceil(F.round(n * F.lit(float(p)), 9)))


def _fold_ends(k: int) -> Callable[[Column], Column]:
    # Fold f holds the ranks up to ceil(f * n / k).
    return lambda n: F.array(*[F.floor((n * j + (k - 1)) / F.lit(k)).cast("bigint") for j in range(1, k)])


def _stratified(df: DataFrame, stratum: str, key: list[str], seed: int, cut_count: int,
                ranks: Callable[[Column], Column], result: Callable[[Column, list[Column]], Column],
                name: str) -> DataFrame:
    """Add ``result(hash, cuts of the row's stratum)``.

    The hash is compared with plain expressions, not inside a lambda: there it would be computed
    again for every cut.
    """
    hashed = df.withColumn("__h", row_hash(key, seed))
    cuts = hash_cuts(hashed, [stratum], ranks)
    found = cuts.limit(LITERAL_STRATA + 1).collect()
    if len(found) > LITERAL_STRATA:
        joined = null_safe_join(hashed, write_out(cuts, "cuts"), [stratum])
        ends = [F.get("__cuts", F.lit(j)) for j in range(cut_count)]
        return joined.withColumn(name, result(F.col("__h"), ends)).drop("__h", "__cuts")
    ends = []
    for j in range(cut_count):
        end = F.lit(None).cast("string")
        for row in found:
            if j < len(row["__cuts"]):
                end = F.when(F.col(stratum).eqNullSafe(F.lit(row[stratum])), F.lit(row["__cuts"][j])).otherwise(end)
        ends.append(end)
    return hashed.withColumn(name, result(F.col("__h"), ends)).drop("__h")


def _is_held_out(h: Column, ends: list[Column]) -> Column:
    return F.coalesce(h <= ends[0], F.lit(False))


def _fold(h: Column, ends: list[Column]) -> Column:
    return sum((F.when(h > end, 1).otherwise(0) for end in ends), F.lit(1))


def split_stratified_class(df: DataFrame, cls: str, p: float, key: list[str], seed: int,
                           name: str = "held_out") -> DataFrame:
    """Flag ``ceil(p * n)`` rows of every class. ``key`` must be unique per row."""
    return _stratified(df, cls, key, seed, 1, _held_out_rows(p), _is_held_out, name)


def numeric_strata(df: DataFrame, y: str, name: str = "__stratum", groups: int = 5) -> DataFrame:
    """Bin a numeric target between its distinct quantiles, lowest value included.

    Five break points give at most four bins, so a table keyed by the bin is always tiny.
    """
    probs = _QUARTERS if groups == 5 else [i / (groups - 1) for i in range(groups)]
    breaks = sorted(set(quantile_literals(df, y, probs)))
    below = sum((F.when(F.col(y) > F.lit(b), 1).otherwise(0) for b in breaks), F.lit(0))
    return df.withColumn(name, F.when(F.col(y).isNotNull(), F.greatest(below, F.lit(1))))


def split_stratified_numeric(df: DataFrame, y: str, p: float, key: list[str], seed: int,
                             groups: int = 5, name: str = "held_out") -> DataFrame:
    """Flag ``ceil(p * n)`` rows of every quantile bin of ``y``."""
    binned = numeric_strata(df, y, groups=groups)
    return _stratified(binned, "__stratum", key, seed, 1, _held_out_rows(p), _is_held_out,
                       name).drop("__stratum")


def kfold_stratified(df: DataFrame, y: str, k: int, key: list[str], seed: int,
                     groups: int = 5, name: str = "fold") -> DataFrame:
    """Folds 1..k whose sizes within a bin differ by at most one: equal blocks of the hash order."""
    binned = numeric_strata(df, y, groups=groups)
    return _stratified(binned, "__stratum", key, seed, k - 1, _fold_ends(k), _fold, name).drop("__stratum")


def hash_split(df: DataFrame, p: float, key: list[str], seed: int, name: str = "held_out") -> DataFrame:
    """Approximate share ``p`` from one expression per row: no job before, no shuffle."""
    return df.withColumn(name, hash_fraction(row_hash(key, seed)) < F.lit(float(p)))


def _flagged(rows: DataFrame, train: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a flag: every key value, null included, also occurs in ``train``."""
    known = F.lit(True)
    for key in keys:
        seen = train.select(key).distinct().withColumn(f"__seen_{key}", F.lit(True))
        rows = null_safe_join(rows, seen, [key])
        known = known & F.coalesce(F.col(f"__seen_{key}"), F.lit(False))
    return rows.withColumn(name, known).drop(*[f"__seen_{k}" for k in keys])


def known_key_flag(df: DataFrame, held_out: str, keys: list[str], name: str = "known") -> DataFrame:
    """True where every key value of the row, null included, also occurs among the rows not held out.

    That holds for the rows not held out themselves: only the others are moved and joined.
    """
    is_train = F.col(held_out).eqNullSafe(F.lit(False))
    train = df.filter(is_train)
    return train.withColumn(name, F.lit(True)).unionByName(_flagged(df.filter(~is_train), train, keys, name))


def holdout_known_keys(test: DataFrame, train: DataFrame, keys: list[str],
                       return_removed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep held-out rows whose keys all occur in ``train``; the others go back to it or are dropped."""
    if not return_removed:
        return semi_join_keys(test, train, keys), train
    flagged = write_out(_flagged(test, train, keys, "__known"), "flagged", compact=True)
    return (flagged.filter("__known").drop("__known"),
            flagged.filter("NOT __known").drop("__known").unionByName(train))


def random_guess(df: DataFrame, levels: DataFrame, key: list[str], seed: int,
                 name: str = "guess") -> DataFrame:
    """A uniformly random label per row; ``levels`` has (code 1..n, level)."""
    ordered = levels.agg(F.sort_array(F.collect_list(F.struct("code", "level"))).alias("all")).select(F.col("all.level"))
    every = ordered.scalar()  # the classes, one array for the whole job
    code = F.pmod(hash_integer(row_hash(key, seed)), F.size(every).cast("bigint"))
    return df.withColumn(name, F.get(every, code.cast("int")))


def poisson_cuts(digits: int = 8) -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, ... as far as a hash of ``digits`` hex digits can tell from 1."""
    cuts, total, term = [], 0.0, math.exp(-1)
    while 1 - total > 16.0 ** -digits:
        total += term
        cuts.append(total)
        term /= len(cuts)
    return cuts


def resample_weight(key: list[str], seed: int, resample: int | Column) -> Column:
    """A Poisson(1) weight of the row in one resample, from its key alone; 0 means held out there."""
    number = F.lit(resample) if isinstance(resample, int) else resample
    u = hash_fraction(F.md5(F.concat_ws("#", row_hash(key, seed), number.cast("string"))))
    return sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in poisson_cuts()), F.lit(0)).cast("double")


def bootstrap_weights(df: DataFrame, resamples: int, key: list[str], seed: int,
                      name: str = "weight") -> DataFrame:
    """Every row once per resample with its weight."""
    each = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    return each.withColumn(name, resample_weight(key, seed, F.col("resample")))
