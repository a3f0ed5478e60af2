"""Exact k nearest neighbours by blocks, behind an index of cells for large tables.

``nearest_neighbours`` compares blocks of rows with blocks. Without resamples a task holds one scored block and its k nearest so far, and reads
the known blocks one after the other; with resamples, training and scored rows are dealt into blocks by a hash of their key, a task compares one block
with one block and returns at most ``k`` candidates per scored row, and the candidates are merged. ``votes_of_resamples`` votes where the
neighbours are found, over all resamples and numbers of columns at once. No task holds more than two blocks and no table of pairs exists.

``indexed_neighbours`` first puts every row into the cell of its nearest pivot, a training row; a cell's radius is its farthest
training row. A scored row is compared with its own cell, which bounds its k-th distance, and then only with cells whose pivot is
not farther away than that bound and the radius together: by the triangle inequality no other cell can hold a neighbour.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle import jvm
from brindle.storage import write_out

MOST_PIVOTS = 1000
BLOCK_ROWS = 512  # rows of a block of the kernel
MOST_IN_REACH = 0.1  # share of all pairs up to which an index saves work
ROUTED_ROWS = 64  # that are dealt to cells at a time
KEPT = 4  # rows kept while resamples are compared, times the neighbours wanted

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dealt(df: DataFrame, key: str, blocks: int, other: int, mine: str, theirs: str) -> DataFrame:
    return (df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))))


def _blocks(df: DataFrame, by: list[str], block_rows: int) -> int:
    """Blocks that the largest ``by`` group needs."""
    sizes = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    return max(1, math.ceil((sizes.agg(F.max("count")).first()[0] or 0) / block_rows))


def smallest(values: np.ndarray, take: int) -> np.ndarray:
    """Columns of the ``take`` smallest values per row in order, the smaller column first among equal values."""
    if take >= values.shape[1]:
        return np.argsort(values, axis=1, kind="stable")
    found = np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)
    held = np.take_along_axis(values, found, axis=1)
    out = np.take_along_axis(found, np.argsort(held, axis=1, kind="stable"), axis=1)
    # rows in which values equal to the last one were left out
    tied = (values <= held.max(axis=1)[:, None]).sum(axis=1) > take
    out[tied] = np.argsort(values[tied], axis=1, kind="stable")[:, :take]
    return out


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, label: str, k: int,
                       features: str = "features", by: list[str] | None = None,
                       sizes: list[int] | None = None, weight: str | None = None,
                       block_rows: int = 2048) -> DataFrame:
    """(by, size, key, place, label, weight, distance): the ``k`` nearest training rows of each row.

    ``by`` columns (such as a resample number) are never mixed. ``sizes`` asks for the neighbours by
    the leading 2, 3, ... features in one go. Ties in distance go to the smaller training key.
    """
    by = by or []
    if not by and not sizes and not weight:
        return _nearest_by_kernel(train, test, key, label, k, features)
    test_blocks, train_blocks = (_blocks(d, by, block_rows) for d in (test, train))
    weight_col = F.col(weight).cast("double") if weight else F.lit(1.0)
    left = _dealt(test.select(*by, key, F.col(features).alias("x")),
                  key, test_blocks, train_blocks, "tb", "rb")
    right = _dealt(train.select(*by, key, F.col(features).alias("x"), F.col(label).alias("label"),
                                weight_col.alias("weight")),
                   key, train_blocks, test_blocks, "rb", "tb")
    return _merged(_candidates(left, right, [*by, "tb", "rb"], by, key, k, sizes), [*by, "size", key], k)


def _in_key_order(df: DataFrame, *then: str) -> DataFrame:
    """Rows of one ``key`` in one partition, partitions and rows in order of the key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, "key").sortWithinPartitions("key", *then)


def _blocks_of(rows: DataFrame) -> DataFrame:
    """(number, rows): blocks of rows (key, x, id, code, draws), in order, for Neighbours.java, numbered in order of the key, which no two blocks share."""
    most = BLOCK_ROWS

    def pack(table: pa.Table) -> bytes:
        n, keys = table.num_rows, table["key"].combine_chunks()
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(n, -1)
        fresh = np.ones(n, bool)
        fresh[1:] = _changes(keys)
        group = np.where(keys.is_null().to_numpy(zero_copy_only=False), -1, np.cumsum(fresh))
        draws = table["draws"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8)
        head = np.array([n, x.shape[1], len(draws) // n, 0], "<i4")
        return b"".join(a.tobytes() for a in (head, np.ascontiguousarray(x.T), table["id"].to_numpy().astype("<i8"), table["code"].to_numpy().astype("<i4"), group.astype("<i4"), draws))

    def run(batches):
        part, made, rest = TaskContext.get().partitionId(), 0, None
        for batch in _and_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
            while rest is not None and rest.num_rows and (batch is None or rest.num_rows > most):
                ends = np.flatnonzero(_changes(rest["key"].combine_chunks())[most - 1:])
                if not len(ends) and batch is not None:
                    break
                size = most + int(ends[0]) if len(ends) else rest.num_rows
                number = part << 16 | made
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(rest.slice(0, size))], pa.binary())], names=["number", "rows"])
                rest, made = rest.slice(size), made + 1

    return rows.mapInArrow(run, "number long, rows binary")


def _and_end(batches):
    yield from batches
    yield None


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a key differs from the one before; nulls are alike."""
    a, b = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _met(scored: DataFrame, known: DataFrame, setting: str, schema: str) -> DataFrame:
    """Every scored block with every block of known rows. A task reads the known rows block after block from their files: none are copied."""
    spark = scored.sparkSession
    parts = max(1, min(scored.count(), max(32, 8 * spark.sparkContext.defaultParallelism)))
    left = scored.select("number", "rows").repartitionByRange(parts, "number")
    right = known.select(F.col("number").alias("other"), F.col("rows").alias("others")).coalesce(1)
    kernel = jvm.instance(spark, "Neighbours", "Neighbours").set(setting)
    return jvm.over_partitions(left.crossJoin(right.hint("shuffle_replicate_nl")), kernel, schema)


def _nearest_by_kernel(train: DataFrame, test: DataFrame, key: str, label: str, k: int, features: str) -> DataFrame:
    """``nearest_neighbours`` of all features, without resamples."""
    given = lambda df, *more: write_out(_in_key_order(df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), *more))
                                        .withColumn("id", F.monotonically_increasing_id()), "rows")
    known, scored = given(train, F.col(label).alias("label")), given(test)
    width = known.agg(F.max(F.size("x"))).first()[0] or 0
    bare = lambda df: df.select("key", "x", "id", F.lit(0).alias("code"), F.array().cast("array<tinyint>").alias("draws"))
    blocks = [write_out(_blocks_of(_in_key_order(bare(df), "id")), "blocks") for df in (scored, known)]
    found = write_out(_met(*blocks, f"near;{k};{k};0;{width};1", "scored long, known long, distance double"), "near")
    named = (found.join(scored.select(F.col("id").alias("scored"), F.col("key").alias(key)), "scored")
             .join(known.select(F.col("id").alias("known"), F.col("key").alias("near"), "label"), "known"))
    return _merged(named.select(F.lit(width).alias("size"), key, "near", "label", F.lit(1.0).alias("weight"), "distance"), ["size", key], k)


def votes_of_resamples(train: DataFrame, key: str, label: str, ks: list[int], draws: Column, features: str = "features", sizes: list[int] | None = None) -> DataFrame:
    """(resample, size, k, hits, n): how many rows that a resample left out are given their label by their ``k`` nearest rows of the resample, by
    ``size`` leading features, and how many have one to compare.

    ``draws`` is each key's weights in the resamples. All resamples are looked up in one pass over the pairs: each row keeps KEPT times as many near rows as
    are wanted, of which a resample takes its own; a block of rows for which these are too few is looked up again with more.
    """
    levels = train.agg(F.sort_array(F.collect_set(label)).alias("all")).first()["all"]
    kind, k = dict(train.dtypes)[label], max(ks)
    code = F.coalesce(F.array_position(F.lit(levels).cast(f"array<{kind}>"), F.col(label)), F.lit(0)) if levels else F.lit(0)
    rows = train.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("id"), code.cast("int").alias("code"), draws.cast("array<tinyint>").alias("draws"))
    blocks = write_out(_blocks_of(_in_key_order(rows)), "blocks")
    wanted = sorted(set(sizes)) if sizes else [train.agg(F.max(F.size(features))).first()[0] or 0]
    grid, left, many, done = ",".join(map(str, sorted(set(ks)))), blocks, KEPT * k, None
    while True:
        found = write_out(_met(left, blocks, f"vote;{k};{many};{len(levels)};{','.join(map(str, wanted))};{grid}", "resample int, size int, k int, hits long, n long, seen long"), "votes")
        good, again = found.where("resample > 0"), found.where("resample < 0").select(F.col("hits").alias("number"))
        done = good if done is None else done.unionByName(good)
        if again.isEmpty():
            break
        left, many = write_out(blocks.join(again, "number", "left_semi"), "blocks"), 4 * many
    return done.groupBy("resample", "size", "k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def _merged(candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy("distance", "near"))
    return candidates.withColumn("place", place).filter(F.col("place") <= k)


def _candidates(left: DataFrame, right: DataFrame, groups: list[str], by: list[str], key: str, k: int, sizes: list[int] | None) -> DataFrame:
    """At most ``k`` candidates of every scored row from each pair of blocks, a pair being rows of equal ``groups``."""
    wanted = sorted(sizes) if sizes else None

    def compare(scored: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "size", key, "near", "label", "weight", "distance"]
        if scored.empty or known.empty:
            return pd.DataFrame({c: [] for c in columns})
        known = known.sort_values(key, kind="stable")
        a, b = np.vstack(scored["x"].to_numpy()), np.vstack(known["x"].to_numpy())
        take = min(k, len(b))
        parts, squared, done = [], np.zeros((len(a), len(b))), 0
        for size in wanted or [a.shape[1]]:
            for j in range(done, size):
                squared += (a[:, j][:, None] - b[:, j][None, :]) ** 2
            done = size
            order = smallest(squared, take)
            at = order.ravel()
            part = {c: np.repeat(scored[c].to_numpy(), take) for c in [*by, key]}
            part |= {"size": size, "near": known[key].to_numpy()[at], "label": known["label"].to_numpy()[at],
                     "weight": known["weight"].to_numpy()[at],
                     "distance": np.sqrt(np.take_along_axis(squared, order, axis=1)).ravel()}
            parts.append(pd.DataFrame(part))
        return pd.concat(parts)[columns]

    types = {**dict(left.dtypes), "label": dict(right.dtypes)["label"]}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "size int", f"`{key}` {types[key]}",
                        f"near {types[key]}", f"label {types['label']}", "weight double", "distance double"])
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(compare, schema)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * x @ pivots.T, 0.0))


def _in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell``, the nearest pivot, and ``away``, its distance, to rows with an array ``x``."""
    def place(batches):
        for frame in batches:
            gaps = _distances(np.vstack(frame["x"].to_numpy()), pivots) if len(frame) else np.zeros((0, 1))
            yield frame.assign(cell=gaps.argmin(axis=1), away=gaps.min(axis=1)) if len(frame) else frame.assign(cell=0, away=0.0)

    return df.mapInPandas(place, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "cell int", "away double"]))


def _near_cells(pivots: np.ndarray, radii: dict[int, float]):
    """A function of rows with ``x``, ``cell`` and ``bound``: (row, cell) is true for cells besides the own that may hold a neighbour of the row."""
    reach = np.full(len(pivots), -np.inf)  # a cell without training rows is out of reach
    for cell, radius in radii.items():
        reach[cell] = radius

    def near(frame: pd.DataFrame) -> np.ndarray:
        gaps = _distances(np.vstack(frame["x"].to_numpy()), pivots)
        bound = frame["bound"].fillna(np.inf).to_numpy(float)
        # room for rounding, so that a neighbour at the very edge is not lost
        found = (gaps - reach[None, :] <= bound[:, None] + 1e-6 * (1 + gaps)) & np.isfinite(reach)[None, :]
        found[np.arange(len(frame)), frame["cell"].to_numpy()] = False
        return found

    return near


def _within_reach(scored: DataFrame, pivots: np.ndarray, radii: dict[int, float]) -> DataFrame:
    """(row, cell) for the cells besides a scored row's own that may hold one of its neighbours; ``bound`` is null if none is known."""
    near = _near_cells(pivots, radii)

    def route(batches):
        for frame in batches:
            for at in range(0, len(frame), ROUTED_ROWS):  # a row may come out once per cell
                some = frame.iloc[at:at + ROUTED_ROWS]
                row, cell = np.nonzero(near(some))
                yield some.iloc[row].assign(cell=cell)

    return scored.mapInPandas(route, ", ".join(f"`{c}` {t}" for c, t in scored.dtypes))


def _rows_within_reach(scored: DataFrame, pivots: np.ndarray, radii: dict[int, float], counts: dict[int, int]) -> int:
    """How many pairs of a scored row and a training row of another cell the index leaves to compare."""
    near, rows = _near_cells(pivots, radii), np.array([counts.get(c, 0) for c in range(len(pivots))], np.int64)

    def count(batches):
        for frame in batches:
            if len(frame):
                yield pd.DataFrame({"pairs": [int((near(frame) @ rows).sum())]})

    return scored.mapInPandas(count, "pairs long").agg(F.sum("pairs")).first()[0] or 0


def _dealt_by_cell(df: DataFrame, sizes: DataFrame, key: str, mine: str, theirs: str, own: str, other: str) -> DataFrame:
    """Blocks inside cells, as many as each cell needs; ``sizes`` has a row per cell."""
    return (df.join(F.broadcast(sizes), "cell").withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other))


def _by_cell(scored: DataFrame, known: DataFrame, key: str, k: int, block_rows: int) -> DataFrame:
    """Candidates of scored rows from the training rows of their cell."""
    blocks = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    sizes = write_out(blocks(scored, "tn").join(blocks(known, "rn"), "cell"), "cells")
    left = _dealt_by_cell(scored.select(key, "x", "cell"), sizes, key, "tb", "rb", "tn", "rn")
    right = _dealt_by_cell(known.select(key, "x", "label", "weight", "cell"), sizes, key, "rb", "tb", "rn", "tn")
    return _candidates(left, right, ["cell", "tb", "rb"], [], key, k, None)


def _in_reach(train: DataFrame, test: DataFrame, key: str, label: str, k: int, features: str, block_rows: int, pivots: int):
    """(training rows in cells, scored rows with their bounds, candidates from the own cells, pivots, radius by cell, rows by cell)."""
    known = train.select(key, F.col(features).alias("x"), F.col(label).alias("label"), F.lit(1.0).alias("weight"))
    # at most MOST_PIVOTS rows, the first by hash, reach the driver and the tasks
    many = min(pivots, max(1, math.ceil(train.count() / block_rows)))
    rows = known.orderBy(F.xxhash64(F.col(key), F.lit("pivot")), key).limit(many).select("x").collect()
    centres = np.array([r["x"] for r in rows], float)
    known = write_out(_in_cells(known, centres), "known")
    scored = write_out(_in_cells(test.select(key, F.col(features).alias("x")), centres), "scored")
    cells = known.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()
    own = write_out(_merged(_by_cell(scored, known, key, k, block_rows), ["size", key], k), "own-cell")
    bounds = own.filter(F.col("place") == k).select(key, F.col("distance").alias("bound"))
    return known, scored.join(bounds, key, "left"), own, centres, {r["cell"]: r["radius"] for r in cells}, {r["cell"]: r["rows"] for r in cells}


def routed_rows(train: DataFrame, test: DataFrame, key: str, label: str, k: int, features: str = "features", block_rows: int = 2048,
                pivots: int = MOST_PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows in cells, scored rows in the other cells within reach, candidates from the own cells)."""
    known, bounded, own, centres, radii, _ = _in_reach(train, test, key, label, k, features, block_rows, pivots)
    other = write_out(_within_reach(bounded, centres, radii), "other-cells")
    return known, other.select(key, "x", "cell"), own


def indexed_neighbours(train: DataFrame, test: DataFrame, key: str, label: str, k: int, features: str = "features", block_rows: int = 2048) -> DataFrame:
    """What ``nearest_neighbours`` gives, without comparing cells that are too far apart. A table of one block has one cell.

    Where the columns have so little structure that more than MOST_IN_REACH of all pairs are left, all are compared: the index would copy each row to most cells.
    """
    if train.limit(block_rows + 1).count() <= block_rows:
        return nearest_neighbours(train, test, key, label, k, features, block_rows=block_rows)
    known, bounded, own, centres, radii, rows = _in_reach(train, test, key, label, k, features, block_rows, MOST_PIVOTS)
    bounded = write_out(bounded, "bounded")
    if _rows_within_reach(bounded, centres, radii, rows) > MOST_IN_REACH * bounded.count() * sum(rows.values()):
        return nearest_neighbours(train, test, key, label, k, features, block_rows=block_rows)
    other = write_out(_within_reach(bounded, centres, radii), "other-cells").select(key, "x", "cell")
    return _merged(own.drop("place").unionByName(_by_cell(other, known, key, k, block_rows)), ["size", key], k)


def vote(neighbours: DataFrame, keys: list[str], k: int | Column) -> DataFrame:
    """Majority label among the first ``k`` neighbours; the least label wins a tie.

    A neighbour of weight w stands for w equal rows, of which only those within the first k vote.
    """
    return _elected(_counted(neighbours, keys), keys, F.lit(k) if isinstance(k, int) else k)


def vote_each(neighbours: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """``vote`` for every one of ``ks``, in a column ``k``; neighbours are ordered once, and only those that vote are repeated."""
    every = _counted(neighbours, keys).withColumn("k", F.explode(F.lit(sorted(ks))))
    return _elected(every, [*keys, "k"], F.col("k"))


def _counted(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``end``, the weight up to and with each neighbour."""
    upto = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return neighbours.withColumn("end", F.sum("weight").over(upto))


def _elected(counted: DataFrame, keys: list[str], k: Column) -> DataFrame:
    voting = counted.withColumn("votes", F.least("weight", k - (F.col("end") - F.col("weight")))).filter(F.col("votes") > 0)
    ballots = voting.groupBy(*keys, "label").agg(F.sum("votes").alias("votes"))
    return (ballots.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("label"))).alias("b"))
            .select(*keys, F.col("b.label").alias("predicted")))


def classify_knn(train: DataFrame, test: DataFrame, key: str, label: str, k: int,
                 features: str = "features", block_rows: int = 2048) -> DataFrame:
    """(key, predicted) for every test row."""
    near = indexed_neighbours(train, test, key, label, k, features, block_rows)
    return vote(near, [key], k)
