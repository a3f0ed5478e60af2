"""Many trees in one job: grown on binned rows, pruned by weakest links, scored on the rows they did not see.

Columns are cut into at most BINS bins at quantiles of the training rows, so a row is one byte per column.
A tree's weights are a function of the row's hash and the tree's number: no resample is ever copied, and the rows
a tree did not see are known wherever the row is. A unit is some trees of one model (a resample, a number of leading columns, a
number of columns tried per split); all units of a grid are one table, grown and scored in one job.

Growing follows two steps (as in PLANET, Panda et al., VLDB 2009). Nodes of more than BLOCK_ROWS rows are split level by level: each
block of rows adds up the weights per (node, column, bin, class) for all trees of a group, the partial histograms are summed, and the
best cut of each node is chosen from the sums. A node with fewer rows gets them into one task, which
grows what is below. Both steps use the same whole sums and the same choice, so they give the same
trees; where a node has few pairs of rows of one class, these are summed in place of a histogram per class. Rows that fit into one block are below the bound from the start.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brindle import jvm
from brindle.functions.hashing import row_hash
from brindle.operators.split import resample_weight
from brindle.storage import write_out

BINS = 32
BLOCK_ROWS = 100_000
CELLS = 200_000  # of one array of sums in a task
ENTRIES = 400_000  # (tree, row) pairs that grow together
FEW = (64, 160)  # pairs of rows of one class in a node up to which these are cheaper than a histogram
GROUPS = 256  # of units at most; each meets every block of rows in a task of its own
MOST_PARTS = 4096  # tasks of a pass over all pairs of blocks and groups
OPEN = -2  # feature of a node that is not decided yet
_U = np.uint64


@dataclass(frozen=True)
class Shape:
    """When a node is left as it is."""

    least_split: int = 2
    least_rows: int = 1
    depth: int = 30


TREE, FOREST = Shape(20, 7, 30), Shape(2, 1, 20)


def mixed(x: np.ndarray | np.uint64) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = np.array(x, np.uint64, ndmin=1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


def poisson_cuts(mean: int) -> np.ndarray:
    """Probabilities of at most 0, 1, 2, ... draws."""
    terms = np.arange(mean + 40)
    return np.cumsum(np.exp(-float(mean) + terms * math.log(mean) - np.array([math.lgamma(t + 1) for t in terms])))


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws with whole means from uniform numbers."""
    out = np.zeros(mean.shape, np.int64)
    for m in np.unique(mean[mean > 0]):
        at = mean == m
        out[at] = np.searchsorted(poisson_cuts(int(m)), u[at], side="right")
    return out


@dataclass
class Trees:
    """Nodes of some trees: ``left`` is the place of a node's left child, the right one follows it."""

    tree: np.ndarray
    heap: np.ndarray  # 1 for a root, 2h and 2h + 1 for the children of h
    feature: np.ndarray  # below 0 where the tree ends
    cut: np.ndarray  # bins up to this one go left
    counts: np.ndarray  # weights per class
    left: np.ndarray
    root: np.ndarray  # place of each tree's root

    @classmethod
    def of(cls, tree: np.ndarray, heap: np.ndarray, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray, trees: int) -> Trees:
        order = np.lexsort((heap, tree))
        tree, heap, feature, cut, counts = tree[order], heap[order], feature[order], cut[order], counts[order]
        place = tree.astype(np.int64) << 32 | heap
        left = np.searchsorted(place, tree.astype(np.int64) << 32 | 2 * heap)
        return cls(tree, heap, feature, cut, counts, left, np.searchsorted(tree, np.arange(trees)))

    def leaves(self, x: np.ndarray, tree: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The place where each (tree, row) ends."""
        at, flat = self.root.take(tree), x.ravel()
        begin, on = row * x.shape[1], np.flatnonzero(self.feature.take(at) >= 0)
        node = at.take(on)
        while len(on):
            node = self.left.take(node) + (flat.take(begin.take(on) + self.feature.take(node)) > self.cut.take(node))
            at[on] = node
            further = np.flatnonzero(self.feature.take(node) >= 0)
            on, node = on.take(further), node.take(further)
        return at


def tried(keys: np.ndarray, heap: np.ndarray, size: int, mtry: int) -> np.ndarray:
    """The columns that each node tries, in order; all if ``mtry`` is 0."""
    if not 0 < mtry < size:
        return np.tile(np.arange(size), (len(keys), 1))
    node, found = mixed(keys ^ mixed(heap.astype(np.uint64))), np.empty((len(keys), mtry), np.int64)
    for a in range(0, len(keys), step := max(1, CELLS // size)):
        order = mixed(node[a:a + step, None] + np.arange(size, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        found[a:a + step] = order.argmin(axis=1)[:, None] if mtry == 1 else np.argpartition(order, mtry - 1, axis=1)[:, :mtry]
    return np.sort(found, axis=1)


def _bins_of(x: np.ndarray, row: np.ndarray, columns: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """(entry, tried column)."""
    return x.ravel().take((row * x.shape[1])[:, None] + columns.take(slot, axis=0)).astype(np.int64)


def _running(sums: np.ndarray) -> np.ndarray:
    """Running sums along the first axis, in place: whole rows are added, which is faster than ``cumsum``."""
    for b in range(1, len(sums)):
        sums[b] += sums[b - 1]
    return sums


def histograms(slot: np.ndarray, x: np.ndarray, row: np.ndarray, label: np.ndarray, w: np.ndarray, columns: np.ndarray, classes: int) -> np.ndarray:
    """Weights per (bin, class, slot, tried column); ``slot``, ``row``, ``label`` and ``w`` have one entry per (tree, row)."""
    slots, k = columns.shape
    cell = _bins_of(x, row, columns, slot)
    cell *= classes * slots * k
    cell += (label * (slots * k) + slot * k)[:, None] + np.arange(k)
    return np.bincount(cell.ravel(), np.repeat(w, k), BINS * classes * slots * k).reshape(BINS, classes, slots, k)


def _purest(squares: np.ndarray, dot: np.ndarray, n_left: np.ndarray, n: np.ndarray, whole: np.ndarray, columns: np.ndarray, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and bin with the largest sum of squared class weights per weight of both sides, from sums per (bin, slot and tried column); column -1
    where none gains. Sums are whole numbers, so equal splits get equal values in any order; the first of equals is taken."""
    n_right, (slots, k) = n - n_left, columns.shape
    with np.errstate(divide="ignore", invalid="ignore"):
        found = squares / n_left + (whole - 2 * dot + squares) / n_right
    found = np.where((n_left < least_rows) | (n_right < least_rows), -1, found)
    tops, each = found.max(axis=0).reshape(slots, k), np.arange(slots)
    best = tops.argmax(axis=1)
    cut = found.take(each * k + best, axis=1).argmax(axis=0)
    gains = tops[each, best] > (whole / n)[each * k] * (1 + 1e-12)
    return np.where(gains, columns[each, best], -1), np.where(gains, cut, -1)


def best_cuts(hist: np.ndarray, columns: np.ndarray, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and bin of the split with the largest gain of the Gini index; column -1 where none gains. First of equals. ``hist`` is used up."""
    running = _running(hist.reshape(BINS, hist.shape[1], -1))
    total, left = running[-1], running[:-1]
    n, whole = total.sum(axis=0), (total * total).sum(axis=0)
    n_left, squares, dot = left.sum(axis=1), np.einsum("bcs,bcs->bs", left, left), np.einsum("bcs,cs->bs", left, total)
    return _purest(squares, dot, n_left, n, whole, columns, least_rows)


def pairs_of_class(node: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many entries of the same node and class come before each one, itself included; entries are in order of (node, class)."""
    at, fresh = np.arange(len(node)), np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (y[1:] != y[:-1])
    return at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1


def best_cuts_of_pairs(node: np.ndarray, bins: np.ndarray, w: np.ndarray, own: np.ndarray, pairs: np.ndarray, n: np.ndarray, whole: np.ndarray, columns: np.ndarray,
                       least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``best_cuts`` of nodes with few pairs of rows of one class: the square of a class's weight left of a cut is the sum over its pairs that lie there.

    ``bins`` is (entry, tried column), ``own`` the weight of the entry's class in its node, ``pairs`` as ``pairs_of_class`` gives it.
    """
    slots, k = columns.shape
    cell = bins * (slots * k)
    cell += (node * k)[:, None] + np.arange(k)
    one = np.repeat(np.arange(len(node)), pairs)
    other = one - (np.arange(len(one)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
    both = w.take(one) * w.take(other) * (1 + (one != other))
    sums = lambda at, load: _running(np.bincount(at.ravel(), np.repeat(load, k), BINS * slots * k).reshape(BINS, -1)[:-1])
    # a pair lies left of a cut when the larger of its bins does
    squares = sums(np.maximum(cell.take(one, axis=0), cell.take(other, axis=0)), both)
    return _purest(squares, sums(cell, w * own), sums(cell, w), np.repeat(n, k), np.repeat(whole, k), columns, least_rows)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, mtry: int, keys: np.ndarray, shape: Shape,
         heap: int = 1) -> Trees:
    """One tree per row of ``weight`` (tree, row) over bins ``x``, level by level; ``heap`` is where they begin."""
    by_class = np.argsort(y, kind="stable")
    x, label = x[by_class], y[by_class]
    tree, row = np.nonzero(weight[:, by_class])
    # entries (tree, row) stay in order of their node, and of their class within it
    w, label, slot, size = weight[tree, by_class[row]].astype(float), label[row], tree, x.shape[1]
    owner, at = np.arange(len(weight)), np.full(len(weight), heap, np.int64)
    made: list[tuple] = []
    placed = 0
    while len(owner):
        counts = np.bincount(slot * classes + label, w, len(owner) * classes).reshape(-1, classes)
        total = counts.sum(axis=1)
        feature, cut = np.full(len(owner), -1), np.full(len(owner), -1)
        is_ready = (total >= shape.least_split) & (counts.max(axis=1) < total) & (at < 1 << shape.depth)
        ready, on = np.flatnonzero(is_ready), np.flatnonzero(is_ready.take(slot))
        row, w, label, slot = row.take(on), w.take(on), label.take(on), slot.take(on)
        if len(ready):
            columns = tried(keys[owner[ready]], at[ready], size, mtry)
            rows = np.bincount(slot, minlength=len(owner))[ready]
            first, before = np.cumsum(rows) - rows, pairs_of_class(slot, label)
            pairs = np.bincount(slot, before, len(owner))[ready]
            for few, most in zip((0, *FEW), (*FEW, None)):
                tier = np.flatnonzero((pairs > few) & (pairs <= most)) if most else np.flatnonzero(pairs > few)
                step = max(1, CELLS // (columns.shape[1] * (max(most, 2 * BINS) if most else BINS * classes)))
                for a in range(0, len(tier), step):
                    some = tier[a:a + step]
                    node, own, tries = np.repeat(np.arange(len(some)), rows[some]), counts[ready[some]], columns[some]
                    entry = np.arange(len(node)) + np.repeat(first[some] - (np.cumsum(rows[some]) - rows[some]), rows[some])
                    if most is None:
                        found = best_cuts(histograms(node, x, row[entry], label[entry], w[entry], tries, classes), tries, shape.least_rows)
                    else:
                        found = best_cuts_of_pairs(node, _bins_of(x, row[entry], tries, node), w[entry], own[node, label[entry]], before[entry],
                                                   own.sum(axis=1), (own * own).sum(axis=1), tries, shape.least_rows)
                    feature[ready[some]], cut[ready[some]] = found
        parts = feature >= 0
        child = 2 * (np.cumsum(parts) - 1)
        placed += len(owner)
        made.append((owner, at, feature, cut, counts, placed + child))  # the next level follows this one
        on = np.flatnonzero(parts.take(slot))
        old, moved = slot.take(on), row.take(on)
        slot = child.take(old) + (x.ravel().take(moved * size + feature.take(old)) > cut.take(old))
        owner, at = np.repeat(owner[parts], 2), (2 * at[parts][:, None] + np.arange(2)).ravel()
        order = np.argsort(slot.astype(np.uint16) if len(owner) <= 1 << 16 else slot, kind="stable")  # short numbers are dealt, not compared
        slot, row, on = slot.take(order), moved.take(order), on.take(order)
        w, label = w.take(on), label.take(on)
    return Trees(*(np.concatenate(c) for c in zip(*made)), np.arange(len(weight)))


def weakest_links(heap: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The complexity at which each split of one tree is given up, as a share of the root's errors; -1 for leaves.

    Again and again the split that saves the fewest errors per leaf below it is collapsed (Breiman et al. 1984); the
    tree for a complexity is the grown one without splits whose value is not above it.
    """
    errors = dict(zip(heap.tolist(), (counts.sum(axis=1) - counts.max(axis=1)).tolist()))
    inner = {h for h, f in zip(heap.tolist(), feature.tolist()) if f >= 0}
    below, leaves, found = dict(errors), dict.fromkeys(errors, 1), {}
    for h in sorted(inner, reverse=True):
        below[h], leaves[h] = below[2 * h] + below[2 * h + 1], leaves[2 * h] + leaves[2 * h + 1]
    saved = lambda h: (errors[h] - below[h]) / (leaves[h] - 1)
    queue = [(saved(h), h) for h in inner]
    heapq.heapify(queue)
    level, scale = 0.0, max(errors[int(heap.min())], 1e-300)
    while queue:
        value, h = heapq.heappop(queue)
        if h in found or value != saved(h):
            continue  # collapsed with an ancestor, or queued anew since
        level = max(level, value / scale)
        gone = [h]
        while gone:
            g = gone.pop()
            found[g] = level
            gone += [c for c in (2 * g, 2 * g + 1) if c in inner and c not in found]
        more, fewer = errors[h] - below[h], leaves[h] - 1
        while h:
            if h in below:
                below[h], leaves[h] = below[h] + more, leaves[h] - fewer
                if h not in found:
                    heapq.heappush(queue, (saved(h), h))
            h //= 2
    return np.array([found.get(h, -1.0) for h in heap.tolist()])


def pruned_labels(trees: Trees, values: np.ndarray, x: np.ndarray, grid: list[float]) -> np.ndarray:
    """Class codes (complexity, row) of the one tree's pruned versions; ``values`` as ``weakest_links`` gives them."""
    at, row = np.full(len(x), trees.root[0]), np.arange(len(x))
    value, label = [values[at]], [trees.counts[at].argmax(axis=1)]
    while (on := np.flatnonzero(trees.feature[at] >= 0)).size:
        at[on] = trees.left[at[on]] + (x[row[on], trees.feature[at[on]]] > trees.cut[at[on]])
        value.append(values[at])
        label.append(trees.counts[at].argmax(axis=1))
    value, label = np.array(value), np.array(label)
    # values fall on the way down, so the first that is not above the complexity ends it
    return np.stack([label[(value <= c).argmax(axis=0), row] for c in grid])


@dataclass(frozen=True)
class Binned:
    """Training rows as (h, block, y, x, draws), with what is needed to bin others and to name classes."""

    rows: DataFrame
    edges: list[np.ndarray]
    levels: list[str]
    blocks: int
    key: str
    seed: int

    def apply(self, df: DataFrame, features: str = "features") -> DataFrame:
        """The columns of ``df`` and ``x``, the bins of its features."""
        return _with_bins(df, features, self.edges)


def _bins(features: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    values = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
    return np.stack([np.searchsorted(e, values[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _with_bins(df: DataFrame, features: str, edges: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = _bins(batch.column(batch.schema.get_field_index(features)), edges)
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != features]
            names = [f.name for f in batch.schema if f.name != features]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary())], names=[*names, "x"])

    others = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != features)
    return df.mapInArrow(run, f"{others}, x binary")


def binned(train: DataFrame, key: str, label: str, resamples: int = 0, seed: int = 4021, features: str = "features") -> Binned:
    """``features`` is an array column; the draws of resample b are the weights of ``resample_weight``."""
    size = F.max(F.size(features))
    first = train.agg(size, F.count("*"), F.sort_array(F.collect_set(F.col(label).cast("string")))).first()
    width, count, levels = first[0] or 0, first[1], first[2]
    shares = [i / BINS for i in range(1, BINS)]
    cuts = train.agg(*[F.percentile_approx(F.get(features, F.lit(j)), shares, 10000).alias(f"c{j}") for j in range(width)]).first() if width else []
    edges = [np.unique(np.array(c if c is not None else [0.0], float)) for c in cuts]
    blocks = 1 + (count - 1) // BLOCK_ROWS if count else 1
    h = F.xxhash64(row_hash([key], seed))
    draws = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: resample_weight([key], seed, b).cast("tinyint")) if resamples else F.array().cast("array<tinyint>")
    code = F.array_position(F.lit(levels).cast("array<string>"), F.col(label).cast("string")) - 1
    rows = train.select(h.alias("h"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"), code.cast("int").alias("y"), draws.alias("draws"), F.col(features).alias("features"))
    return Binned(write_out(_with_bins(rows.where("y IS NOT NULL"), "features", edges), "binned"), edges, levels, blocks, key, seed)


@dataclass(frozen=True)
class Unit:
    """Some trees of one model. Resample 0 is all rows; ``mtry`` 0 tries all columns and draws no rows."""

    model: int
    resample: int
    size: int
    mtry: int = 0
    first: int = 0
    trees: int = 1


UNIT = "model long, resample int, size int, mtry int, first int, trees int"
NODE = "model long, tree int, heap long, feature int, cut int, counts array<double>"


def tree_keys(seed: int, resample: int, trees: np.ndarray) -> np.ndarray:
    """One hash per tree, the same for every number of columns, so that these are compared on the same draws."""
    return mixed(mixed(_U(seed) + (_U(resample) << _U(32))) + np.asarray(trees, np.uint64))


class _Block:
    """The rows of one block in a task."""

    def __init__(self, table: pa.Table, seed: int):
        self.h = table["h"].to_numpy().view(np.uint64)
        order = np.argsort(self.h, kind="stable")
        self.h = self.h[order]
        self.y = table["y"].to_numpy()[order].astype(np.int64)
        self.x = np.frombuffer(b"".join(table["x"].to_pylist()), np.uint8).reshape(len(order), -1)[order]
        draws = table["draws"].combine_chunks()
        self.draws = (draws.flatten().to_numpy().reshape(len(order), -1) if len(order) else np.zeros((0, 0), np.int8))[order]
        self.seed = seed

    def given(self, unit: Unit) -> np.ndarray:
        """How often each row is in the unit's resample."""
        return np.ones(len(self.h), np.int64) if unit.resample == 0 else self.draws[:, unit.resample - 1].astype(np.int64)

    def keys(self, unit: Unit, trees: np.ndarray) -> np.ndarray:
        return tree_keys(self.seed, unit.resample, trees)

    def weights(self, unit: Unit, trees: np.ndarray) -> np.ndarray:
        given = np.broadcast_to(self.given(unit), (len(trees), len(self.h)))
        if not unit.mtry:
            return given
        u = (mixed(self.h[None, :] ^ self.keys(unit, trees)[:, None]) >> _U(11)) / float(1 << 53)
        return poisson(given, u)

    def grown(self, unit: Unit, classes: int, shape: Shape):
        """(tree numbers, weights, trees) in batches that fit the memory."""
        step = max(1, ENTRIES // max(1, len(self.h)))
        for a in range(unit.first, unit.first + unit.trees, step):
            numbers = np.arange(a, min(a + step, unit.first + unit.trees))
            weights = self.weights(unit, numbers)
            yield numbers, weights, grow(self.x[:, :unit.size], self.y, weights, classes, unit.mtry, self.keys(unit, numbers), shape)


def _units(table: pa.Table) -> list[Unit]:
    return [Unit(**{k: int(v) for k, v in r.items() if k in Unit.__dataclass_fields__}) for r in table.to_pylist()]


def _groups(units: list[Unit]) -> int:
    return max(1, min(GROUPS, len(units)))


def _meet(rows: DataFrame, others: DataFrame, blocks: int, groups: int, fn, schema: str) -> DataFrame:
    """Every block of ``rows`` with every group of ``others``, one pair after the other in at most MOST_PARTS tasks."""
    keys, parts = ["block", "group"], min(groups * blocks, MOST_PARTS)
    left = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(parts, *keys)
    right = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)})


def _node_columns(model: int, numbers: np.ndarray, t: Trees) -> list:
    return [np.full(len(t.tree), model), numbers[t.tree], t.heap, t.feature, t.cut, list(t.counts)]


def _joined(schema: str, parts: list[list]) -> pa.Table:
    return pa.concat_tables([_table(schema, p) for p in parts]) if parts else _table(schema, [[] for _ in schema.split(", ")])


def unit_table(data: Binned, units: list[Unit]) -> DataFrame:
    """One row per unit, dealt to the groups."""
    rows = [(u.model, u.resample, u.size, u.mtry, u.first, u.trees, i % _groups(units)) for i, u in enumerate(units)]
    return data.rows.sparkSession.createDataFrame(rows, f"{UNIT}, group int")


def grown(data: Binned, units: list[Unit], shape: Shape) -> DataFrame:
    """The nodes of all trees of all units (NODE), written once."""
    classes, seed, table = len(data.levels), data.seed, unit_table(data, units)
    if data.blocks == 1:
        def run(rows: pa.Table, given: pa.Table) -> pa.Table:
            block = _Block(rows, seed)
            return _joined(NODE, [_node_columns(u.model, numbers, t) for u in _units(given) for numbers, _, t in block.grown(u, classes, shape)])

        return write_out(_meet(data.rows, table, 1, _groups(units), run, NODE), "trees")
    return _grown_by_levels(data, table, _groups(units), shape)


PLACED = f"{NODE}, resample int, size int, mtry int, first int, trees int, group int"


def _trees_of(nodes: pa.Table) -> list[tuple[Unit, np.ndarray, Trees]]:
    """The trees among rows of PLACED, one unit per model, with their numbers."""
    out, model = [], nodes["model"].to_numpy()
    for m in np.unique(model):
        part = nodes.filter(pa.array(model == m))
        numbers, tree = np.unique(part["tree"].to_numpy(), return_inverse=True)
        r = part.slice(0, 1).to_pylist()[0]
        counts = np.array([c if c is not None else [] for c in part["counts"].to_pylist()], object)
        width = max((len(c) for c in counts), default=0)
        counts = np.array([c if len(c) == width else [0.0] * width for c in counts], float).reshape(len(counts), -1)
        trees = Trees.of(tree, *(part[c].to_numpy() for c in ("heap", "feature", "cut")), counts, len(numbers))
        out.append((Unit(int(m), r["resample"], r["size"], r["mtry"]), numbers, trees))
    return out


def _at_open_nodes(block: _Block, unit: Unit, numbers: np.ndarray, trees: Trees):
    """(places of open nodes, entries: place, row, weight) of the rows that end in them."""
    weights = block.weights(unit, numbers)
    tree, row = np.nonzero(weights)
    end = trees.leaves(block.x, tree, row)
    on = trees.feature[end] == OPEN
    return end[on], row[on], weights[tree[on], row[on]]


def _grown_by_levels(data: Binned, table: DataFrame, groups: int, shape: Shape) -> DataFrame:
    classes, seed, blocks = len(data.levels), data.seed, data.blocks
    params = table.select("model", "resample", "size", "mtry", "first", "trees", "group")

    def placed(nodes: DataFrame) -> DataFrame:
        own = F.col("tree").between(F.col("first"), F.col("first") + F.col("trees") - 1)
        return nodes.join(F.broadcast(params), "model").where(own).select(*[f.split(" ")[0] for f in PLACED.split(", ")])

    hists = "model long, tree int, heap long, size int, mtry int, resample int, block int, hist binary"

    def partial(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and nodes.num_rows:
            block = _Block(rows, seed)
            for unit, numbers, trees in _trees_of(nodes):
                end, row, w = _at_open_nodes(block, unit, numbers, trees)
                places, slot = np.unique(end, return_inverse=True)
                columns = tried(block.keys(unit, numbers)[trees.tree[places]], trees.heap[places], unit.size, unit.mtry)
                step = max(1, CELLS // (max(1, columns.shape[1]) * BINS * classes))
                for a in range(0, len(places), step):
                    on = (slot >= a) & (slot < a + step)
                    hist = histograms(slot[on] - a, block.x, row[on], block.y[row[on]], w[on].astype(float), columns[a:a + step], classes)
                    some, n = places[a:a + step], hist.shape[2]
                    out.append([np.full(n, unit.model), numbers[trees.tree[some]], trees.heap[some], np.full(n, unit.size), np.full(n, unit.mtry),
                                np.full(n, unit.resample), np.full(n, rows["block"][0].as_py()), [hist[:, :, i].tobytes() for i in range(n)]])
        return _joined(hists, out)

    def added(part: pa.Table) -> np.ndarray:
        total = 0.0
        for h in part["hist"]:
            total = total + np.frombuffer(h.as_buffer(), float)
        return total

    def sum_up(part: pa.Table) -> pa.Table:
        r = part.drop_columns(["hist"]).slice(0, 1).to_pylist()[0]
        return _joined(hists, [[[r[c]] for c in ("model", "tree", "heap", "size", "mtry", "resample", "block")] + [[added(part).tobytes()]]])

    decided = f"{NODE}, weight double"

    def decide(part: pa.Table) -> pa.Table:
        r = part.drop_columns(["hist"]).slice(0, 1).to_pylist()[0]
        hist = added(part)
        columns = tried(tree_keys(seed, r["resample"], [r["tree"]]), np.array([r["heap"]]), r["size"], r["mtry"])
        hist = hist.reshape(BINS, classes, 1, columns.shape[1])
        counts = hist[:, :, 0, 0].sum(axis=0)
        feature, cut = -1, -1
        if counts.sum() >= shape.least_split and counts.max() < counts.sum() and r["heap"] < 1 << shape.depth:
            feature, cut = (int(v[0]) for v in best_cuts(hist.copy(), columns, shape.least_rows))
        out = [(r["model"], r["tree"], r["heap"], feature, cut, list(counts), float(counts.sum()))]
        if feature >= 0:
            left = float(hist[:cut + 1, :, 0, int(np.flatnonzero(columns[0] == feature)[0])].sum())
            out += [(r["model"], r["tree"], 2 * r["heap"] + side, OPEN, -1, None, n) for side, n in enumerate((left, float(counts.sum()) - left))]
        return _table(decided, list(zip(*out)))

    start = params.select("model", F.explode(F.sequence("first", F.col("first") + F.col("trees") - 1)).alias("tree"), F.lit(1).cast("long").alias("heap"),
                          F.lit(OPEN).alias("feature"), F.lit(-1).alias("cut"), F.lit(None).cast("array<double>").alias("counts"))
    closed, large, small = None, write_out(start, "open"), []
    while not large.isEmpty():
        others = large if closed is None else large.unionByName(closed)
        for s in small:
            others = others.unionByName(s.withColumn("feature", F.lit(-1)))  # rows that end there wait for the last step
        sums = _meet(data.rows, placed(others), blocks, groups, partial, hists).withColumn("block", F.col("block") % 32)
        keys = ["model", "tree", "heap"]
        fresh = write_out(sums.groupBy(*keys, "block").applyInArrow(sum_up, hists).groupBy(*keys).applyInArrow(decide, decided), "level")
        done = fresh.where(F.col("feature") != OPEN).drop("weight")
        closed = done if closed is None else closed.unionByName(done)
        small.append(fresh.where((F.col("feature") == OPEN) & (F.col("weight") <= BLOCK_ROWS)).drop("weight"))
        large = fresh.where((F.col("feature") == OPEN) & (F.col("weight") > BLOCK_ROWS)).drop("weight")

    routed = "model long, tree int, heap long, size int, mtry int, resample int, y int, w long, x binary"

    def route(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and nodes.num_rows:
            block = _Block(rows, seed)
            for unit, numbers, trees in _trees_of(nodes):
                end, row, w = _at_open_nodes(block, unit, numbers, trees)
                n = len(end)
                out.append([np.full(n, unit.model), numbers[trees.tree[end]], trees.heap[end], np.full(n, unit.size), np.full(n, unit.mtry), np.full(n, unit.resample),
                            block.y[row], w, [r.tobytes() for r in block.x[row, :unit.size]]])
        return _joined(routed, out)

    def finish(part: pa.Table) -> pa.Table:
        r = part.drop_columns(["x"]).slice(0, 1).to_pylist()[0]
        x = np.frombuffer(b"".join(part["x"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
        made = grow(x, part["y"].to_numpy().astype(np.int64), part["w"].to_numpy()[None, :], classes, r["mtry"],
                    tree_keys(seed, r["resample"], [r["tree"]]), shape, r["heap"])
        return _joined(NODE, [_node_columns(r["model"], np.array([r["tree"]]), made)])

    waiting = closed
    for s in small:
        waiting = waiting.unionByName(s)
    rest = _meet(data.rows, placed(waiting), blocks, groups, route, routed).groupBy("model", "tree", "heap").applyInArrow(finish, NODE)
    return write_out(closed.unionByName(rest), "trees")


def _placed(data: Binned, nodes: DataFrame, units: list[Unit]) -> DataFrame:
    """Grown nodes with their units' parameters, by group, for a pass over the blocks."""
    table = unit_table(data, units)
    own = F.col("tree").between(F.col("first"), F.col("first") + F.col("trees") - 1)
    return nodes.join(F.broadcast(table), "model").where(own).select(*[f.split(" ")[0] for f in PLACED.split(", ")])


def _scored(data: Binned, units: list[Unit], shape: Shape, score, schema: str) -> DataFrame:
    """``score(block, unit, batches)`` of every unit, batches being (tree numbers, weights, trees); rows of ``schema`` per block."""
    classes, seed = len(data.levels), data.seed
    if data.blocks == 1:
        def grow_and_score(rows: pa.Table, given: pa.Table) -> pa.Table:
            block = _Block(rows, seed)
            return _joined(schema, [score(block, u, block.grown(u, classes, shape)) for u in _units(given)])

        return write_out(_meet(data.rows, unit_table(data, units), 1, _groups(units), grow_and_score, schema), "scored")

    def only_score(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return _joined(schema, [])
        block = _Block(rows, seed)
        return _joined(schema, [score(block, u, [(numbers, block.weights(u, numbers), t)]) for u, numbers, t in _trees_of(nodes)])

    return write_out(_meet(data.rows, _placed(data, grown(data, units, shape), units), data.blocks, _groups(units), only_score, schema), "scored")


def packed(data: Binned, shape: Shape) -> DataFrame:
    """The rows of a table of one block as one row ``block``, laid out for the kernels of Forests.java."""
    classes, width, seed = len(data.levels), len(data.edges), data.seed

    def pack(batches):
        block = _Block(pa.Table.from_batches(batches), seed)
        draws = block.draws.astype(np.int8)
        most = max(1, int(draws.max(initial=0)))
        cuts = [poisson_cuts(m) if m else np.zeros(0) for m in range(most + 1)]
        head = np.array([len(block.h), width, draws.shape[1], classes, shape.least_split, shape.least_rows, shape.depth, len(cuts)], "<i4").tobytes()
        out = [head, np.array([seed], "<i8").tobytes(), *[np.array([len(c)], "<i4").tobytes() + c.astype("<f8").tobytes() for c in cuts],
               block.h.astype("<u8").tobytes(), block.y.astype("<i4").tobytes(), draws.tobytes(), block.x.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["block"])

    rows = data.rows.select("h", "y", "draws", "x").coalesce(1)
    return write_out(rows.mapInArrow(pack, "block binary"), "packed")


def _hits_of_forests(data: Binned, units: list[Unit], shape: Shape) -> DataFrame:
    """(size, mtry, resample, hits, n) of forests on a table of one block, grown and scored by the kernel.

    Units that differ only in their number of leading columns are one row, as their trees have most nodes in common.
    """
    families: dict[tuple, list[int]] = {}
    for u in units:
        families.setdefault((u.resample, u.mtry, u.first, u.trees), []).append(u.size)
    given = [(b, ",".join(map(str, sorted(sizes))), m, first, trees) for (b, m, first, trees), sizes in families.items()]
    given.sort(key=lambda g: -g[2])  # the longest first
    spark = data.rows.sparkSession
    table = spark.createDataFrame(given, "resample int, sizes string, mtry int, first int, trees int").repartition(min(len(given), MOST_PARTS // 4))
    found = jvm.function(spark, "Forests", "ForestHits", "array<bigint>")("block", "resample", "sizes", "mtry", "first", "trees")
    # one row, a block of at most BLOCK_ROWS rows
    scored = write_out(table.crossJoin(F.broadcast(packed(data, shape))).select("resample", "sizes", "mtry", found.alias("found")), "scored")
    each = F.posexplode(F.split("sizes", ",").cast("array<int>")).alias("at", "size")
    return (scored.select("resample", "mtry", "found", each)
            .select("size", "mtry", "resample", F.get("found", "at").alias("hits"), F.element_at("found", -1).alias("n")))


def tune_trees(data: Binned, complexities: list[float], sizes: list[int], resamples: int, shape: Shape = TREE) -> DataFrame:
    """(size, pos, value, accuracy): mean accuracy on held-out rows of trees pruned to each complexity, one tree per (size, resample)."""
    units = [Unit(i, b, s) for i, (s, b) in enumerate((s, b) for s in sizes for b in range(1, resamples + 1))]
    grid, classes = [float(c) for c in complexities], len(data.levels)

    def score(block: _Block, unit: Unit, batches) -> list:
        held = np.flatnonzero(block.given(unit) == 0)
        for _, _, trees in batches:
            found = pruned_labels(trees, weakest_links(trees.heap, trees.feature, trees.counts), block.x[held], grid)
            hits = (found == block.y[held]).sum(axis=1)
        n = len(grid)
        return [np.full(n, unit.size), np.full(n, unit.resample), np.arange(1, n + 1), hits, np.full(n, len(held))]

    return _accuracies(_scored(data, units, shape, score, "size int, resample int, pos int, hits long, n long"), ["size"], grid)


def tune_forests(data: Binned, tried_columns: list[int], sizes: list[int], resamples: int, trees: int, shape: Shape = FOREST) -> DataFrame:
    """(size, pos, value, accuracy) of forests over numbers of leading columns and of columns tried per split."""
    # more columns tried than there are is all of them, grown once
    cells = [(s, m, b) for s in sizes for m in sorted({int(min(t, s)) for t in tried_columns}) for b in range(1, resamples + 1)]
    units = [Unit(i, b, s, m, 0, trees) for i, (s, m, b) in enumerate(cells)]
    grid, classes = [float(m) for m in tried_columns], len(data.levels)
    if data.blocks == 1:
        places = F.posexplode(F.lit([int(m) for m in tried_columns])).alias("at", "tried")
        found = _hits_of_forests(data, units, shape).select("*", places).where("mtry = least(tried, size)")
        return _accuracies(found.withColumn("pos", F.col("at") + 1), ["size"], grid)

    def score(block: _Block, unit: Unit, batches) -> list:
        held = np.flatnonzero(block.given(unit) == 0)
        votes = np.zeros((len(held), classes))
        for numbers, _, made in batches:
            tree, row = np.divmod(np.arange(len(numbers) * len(held)), max(1, len(held)))
            label = made.counts.argmax(axis=1)[made.leaves(block.x, tree, held[row])]
            votes += np.bincount(row * classes + label, minlength=votes.size).reshape(votes.shape)
        hits = int((votes.argmax(axis=1) == block.y[held]).sum()) if len(held) else 0
        at = [p for p, m in enumerate(tried_columns, start=1) if min(m, unit.size) == unit.mtry]
        n = len(at)
        return [[unit.size] * n, [unit.resample] * n, at, [hits] * n, [len(held)] * n]

    return _accuracies(_scored(data, units, shape, score, "size int, resample int, pos int, hits long, n long"), ["size"], grid)


def _accuracies(scored: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    per = scored.groupBy(*by, "resample", "pos").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    value = F.get(F.lit(grid), F.col("pos") - 1)
    return (per.groupBy(*by, "pos").agg(F.avg(F.when(F.col("n") > 0, F.col("hits") / F.col("n"))).alias("accuracy"))
            .select(*[F.col(c).cast("long") for c in by], F.col("pos").cast("long"), value.alias("value"), "accuracy"))


def forest_units(size: int, mtry: int, trees: int, each: int = 25) -> list[Unit]:
    """One forest on all rows, dealt out in parts of ``each`` trees."""
    return [Unit(i, 0, size, min(mtry, size), a, min(each, trees - a)) for i, a in enumerate(range(0, trees, each))]


def fit_forest(data: Binned, mtry: int, trees: int = 500, shape: Shape = FOREST) -> tuple[DataFrame, list[Unit]]:
    """A forest's nodes and units."""
    units = forest_units(len(data.edges), mtry, trees)
    return grown(data, units, shape), units


def fit_tree(data: Binned, complexity: float, shape: Shape = TREE) -> tuple[DataFrame, list[Unit]]:
    """The nodes of one tree, pruned by weakest links."""
    units = [Unit(0, 0, len(data.edges))]

    def prune(nodes: pa.Table) -> pa.Table:
        heap, feature = nodes["heap"].to_numpy(), nodes["feature"].to_numpy().copy()
        feature[weakest_links(heap, feature, np.array(nodes["counts"].to_pylist(), float)) <= complexity] = -1
        ends = set(heap[feature < 0].tolist())
        above = lambda h: any(h >> i in ends for i in range(1, int(h).bit_length()))
        kept = nodes.set_column(nodes.schema.get_field_index("feature"), "feature", pa.array(feature, pa.int32()))
        return kept.filter(pa.array([not above(h) for h in heap.tolist()], pa.bool_()))

    return write_out(grown(data, units, shape).groupBy("model", "tree").applyInArrow(prune, NODE), "pruned"), units


def predict(data: Binned, model: tuple[DataFrame, list[Unit]], df: DataFrame, key: str, label: str, features: str = "features") -> DataFrame:
    """(key, label, predicted): the class with the most votes of the trees; the first of equals."""
    nodes, units = model
    classes, kind = len(data.levels), {c: t for c, t in df.dtypes}
    blocks = 1 + max(0, df.count() - 1) // BLOCK_ROWS
    h = F.xxhash64(row_hash([key], data.seed))
    rows = write_out(data.apply(df.select(key, label, features), features).withColumn("block", F.pmod(h, F.lit(blocks)).cast("int"))
                     .withColumn("at", F.monotonically_increasing_id()), "to-predict")

    def run(given: pa.Table, grown_nodes: pa.Table) -> pa.Table:
        out = []
        if given.num_rows and grown_nodes.num_rows:
            x = np.frombuffer(b"".join(given["x"].to_pylist()), np.uint8).reshape(given.num_rows, -1)
            at, votes = given["at"].to_numpy(), np.zeros((given.num_rows, classes))
            for _, numbers, trees in _trees_of(grown_nodes):
                for t in range(len(numbers)):
                    label_of = trees.counts.argmax(axis=1)[trees.leaves(x, np.full(len(x), t), np.arange(len(x)))]
                    votes[np.arange(len(x)), label_of] += 1
            row, label_at = np.nonzero(votes)
            out.append([at[row], label_at, votes[row, label_at]])
        return _joined("at long, code int, votes double", out)

    votes = _meet(rows.select("at", "block", "x"), _placed(data, nodes, units), blocks, _groups(units), run, "at long, code int, votes double")
    best = (votes.groupBy("at", "code").agg(F.sum("votes").alias("votes")).groupBy("at")
            .agg(F.max(F.struct("votes", (-F.col("code")).alias("less"))).alias("best")).select("at", (-F.col("best.less")).alias("code")))
    named = F.get(F.lit(data.levels).cast("array<string>"), F.col("code"))
    return rows.join(best, "at").select(key, label, named.alias("predicted"))


def forest_importance(data: Binned, mtry: int, trees: int = 500, shape: Shape = FOREST) -> DataFrame:
    """(feature, importance, share, error): mean loss of accuracy per tree, on the rows it did not draw, when one column's values
    change places among them; ``error`` is its standard error over the trees, ``feature`` a column's position from 0.

    A column that a tree doesn't use loses nothing there. The values change places within a block of rows, which is dealt by hash.
    """
    units, seed = forest_units(len(data.edges), mtry, trees), data.seed

    def score(block: _Block, unit: Unit, batches) -> list:
        out = []
        for numbers, weights, made in batches:
            for t in range(len(numbers)):
                left_out = np.flatnonzero(weights[t] == 0)
                if not len(left_out):
                    continue
                labels, rows = made.counts.argmax(axis=1), np.arange(len(left_out))
                x, y = block.x[left_out], block.y[left_out]
                used = np.unique(made.feature[(made.tree == t) & (made.feature >= 0)])
                base = int((labels[made.leaves(x, np.full(len(x), t), rows)] == y).sum())
                out.append((int(numbers[t]), -1, base, len(x)))
                for f in used:
                    order = np.argsort(mixed(block.h[left_out] ^ mixed(_U(seed) + _U(int(numbers[t]) * 1000003 + int(f)))), kind="stable")
                    moved = x.copy()
                    moved[order, f] = x[np.roll(order, 1), f]
                    out.append((int(numbers[t]), int(f), int((labels[made.leaves(moved, np.full(len(x), t), rows)] == y).sum()), len(x)))
        return list(zip(*out)) if out else [[], [], [], []]

    per = _scored(data, units, shape, score, "tree int, feature int, hits long, n long").groupBy("tree", "feature").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    base = per.where("feature = -1").select("tree", F.col("hits").alias("all_hits"))
    loss = per.where("feature >= 0").join(base, "tree").select("feature", ((F.col("all_hits") - F.col("hits")) / F.col("n")).alias("loss"))
    # trees that do not use the column count with a loss of 0
    sums = loss.groupBy("feature").agg(F.sum("loss").alias("s"), F.sum(F.col("loss") * F.col("loss")).alias("q"))
    every = data.rows.sparkSession.range(len(data.edges)).select(F.col("id").cast("int").alias("feature"))
    full = every.join(sums, "feature", "left").fillna(0.0, ["s", "q"])
    mean = F.col("s") / trees
    spread = F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / max(1, trees - 1), F.lit(0.0)) / trees)
    return full.select("feature", mean.alias("importance"), spread.alias("error"))


def named_importance(found: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, importance): the loss in standard errors, scaled so that the least is 0 and the largest 100."""
    ratio = F.when(F.col("error") > 0, F.col("importance") / F.col("error")).otherwise(F.lit(0.0))
    rated = found.select(F.get(F.lit(cols), F.col("feature")).alias("feature"), ratio.alias("r"))
    ends = F.broadcast(rated.agg(F.min("r").alias("low"), F.max("r").alias("high")))  # one row
    return rated.crossJoin(ends).select("feature", F.when(F.col("high") > F.col("low"), 100 * (F.col("r") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0)).alias("importance"))
