"""The tree grower: single trees by plain Python, both ways of growing, pruning over all subtrees, out-of-bag losses."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from brindle.plans import classifiers as cls, trees


def plain_tree(x, y, w, classes, mtry, key, shape, heap=1):
    """One tree, one node and one cut at a time: {heap: (feature, cut, counts)}."""
    counts = np.bincount(y, w, classes)
    out, best, n = {heap: (-1, -1, tuple(counts))}, (float((counts ** 2).sum()) / max(counts.sum(), 1) * (1 + 1e-12), -1, -1), counts.sum()
    if n >= shape.least_split and counts.max() < n and heap < 1 << shape.depth:
        for f in trees.tried(np.array([key]), np.array([heap]), x.shape[1], mtry)[0]:
            for cut in range(trees.BINS - 1):
                left = np.bincount(y[x[:, f] <= cut], w[x[:, f] <= cut], classes)
                right = counts - left
                if min(left.sum(), right.sum()) >= max(shape.least_rows, 1):
                    purity = (left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum()
                    if purity > best[0]:
                        best = (purity, int(f), cut)
    if best[1] >= 0:
        out[heap] = (best[1], best[2], tuple(counts))
        for side, on in enumerate((x[:, best[1]] <= best[2], x[:, best[1]] > best[2])):
            out |= plain_tree(x[on], y[on], w[on], classes, mtry, key, shape, 2 * heap + side)
    return out


def as_dict(t: trees.Trees, tree: int) -> dict:
    on = t.tree == tree
    return {int(h): (int(f), int(c), tuple(n)) for h, f, c, n in zip(t.heap[on], t.feature[on], t.cut[on], t.counts[on])}


def random_rows(seed: int, n: int = 120, width: int = 5, classes: int = 3):
    rng = np.random.default_rng(seed)
    values = rng.normal(0, 1, (n, width))
    y = (values[:, 0] + values[:, 1] * values[:, 2] + rng.normal(0, 0.4, n) > 0).astype(int) + (values[:, 3] > 1) * (classes > 2)
    return values, y


@pytest.mark.parametrize("mtry, shape", [(0, trees.TREE), (0, trees.FOREST), (1, trees.FOREST), (3, trees.Shape(5, 2, 4))])
def test_batches_of_trees_equal_single_ones(mtry, shape):
    for seed in range(4):
        values, y = random_rows(seed, 20 + 60 * seed)
        x = np.stack([np.searchsorted(np.quantile(v, np.arange(1, 32) / 32), v) for v in values.T], axis=1).astype(np.int64)
        rng = np.random.default_rng(seed)
        weight = rng.poisson(1, (4, len(y))).astype(np.int64)
        weight[3] = 0
        keys = trees.mixed(np.arange(4))
        got = trees.grow(x, y, weight, 3, mtry, keys, shape)
        for t in range(4):
            assert as_dict(got, t) == plain_tree(x[weight[t] > 0], y[weight[t] > 0], weight[t][weight[t] > 0], 3, mtry, keys[t], shape)


def test_few_rows_and_histograms_choose_alike(monkeypatch):
    values, y = random_rows(5, 200)
    x = np.stack([np.searchsorted(np.quantile(v, np.arange(1, 32) / 32), v) for v in values.T], axis=1).astype(np.int64)
    weight, keys = np.random.default_rng(1).poisson(1, (10, 200)).astype(np.int64), trees.mixed(np.arange(10))
    one = trees.grow(x, y, weight, 3, 2, keys, trees.FOREST)
    monkeypatch.setattr(trees, "FEW", ())
    monkeypatch.setattr(trees, "CELLS", 500)
    two = trees.grow(x, y, weight, 3, 2, keys, trees.FOREST)
    assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in ("tree", "heap", "feature", "cut", "counts"))


@pytest.mark.parametrize("classes", [1, 3, 9])
def test_pairs_and_histograms_choose_alike(monkeypatch, classes):
    """Nodes of any size by pairs of rows only, and by histograms only, one or many at a time; children are where ``left`` says."""
    rng = np.random.default_rng(classes)
    x, y = rng.integers(0, 32, (150, 6)).astype(np.uint8), rng.integers(0, classes, 150)
    x[:, 5] = 7  # a column that cannot split, and rows that are alike
    x[:30] = x[0]
    weight, keys, found = rng.poisson(1, (12, 150)).astype(np.int64), trees.mixed(np.arange(12)), []
    for pairs, cells in (((10**6,), 200_000), ((), 200_000), ((3, 20), 500)):
        monkeypatch.setattr(trees, "FEW", pairs)
        monkeypatch.setattr(trees, "CELLS", cells)
        found.append(trees.grow(x, y, weight, classes, 3, keys, trees.FOREST))
    for t in found[1:]:
        assert all(np.array_equal(getattr(found[0], k), getattr(t, k)) for k in ("tree", "heap", "feature", "cut", "counts", "left", "root"))
    inner = found[0].feature >= 0
    for side in (0, 1):
        child = found[0].left[inner] + side
        assert np.array_equal(found[0].heap[child], 2 * found[0].heap[inner] + side) and np.array_equal(found[0].tree[child], found[0].tree[inner])
    assert inner.any() == (classes > 1)


def subtrees(nodes: dict, h: int = 1):
    """All prunings, as sets of the splits that stay."""
    yield frozenset()
    if nodes[h][0] >= 0:
        for a, b in itertools.product(subtrees(nodes, 2 * h), subtrees(nodes, 2 * h + 1)):
            yield frozenset({h}) | a | b


def test_weakest_links_over_all_subtrees():
    tried = 0
    for seed in range(30):
        values, y = random_rows(seed, 60, 4, 2)
        x = np.stack([np.searchsorted(np.quantile(v, np.arange(1, 32) / 32), v) for v in values.T], axis=1).astype(np.int64)
        t = trees.grow(x, y, np.ones((1, 60), np.int64), 2, 0, trees.mixed(np.arange(1)), trees.Shape(6, 3, 4))
        nodes = as_dict(t, 0)
        every = list(subtrees(nodes))
        if not 3 < len(every) < 4000:
            continue
        errors = {h: sum(n[2]) - max(n[2]) for h, n in nodes.items()}

        def cost(kept, share):
            ends = [h for h in nodes if h not in kept and (h == 1 or h // 2 in kept)]
            return sum(errors[h] for h in ends) + share * errors[1] * len(ends), len(ends)

        values_of = dict(zip(t.heap.tolist(), trees.weakest_links(t.heap, t.feature, t.counts)))
        for share in (0.0, 0.011, 0.02, 0.047, 0.1, 0.3, 1.0):
            kept = {h for h, v in values_of.items() if v > share}
            least = min((round(cost(k, share)[0], 9), cost(k, share)[1]) for k in every)
            assert (round(cost(kept, share)[0], 9), cost(kept, share)[1]) == least
            label = trees.pruned_labels(t, np.array([values_of[h] for h in t.heap.tolist()]), x, [share])[0]
            for r in range(60):
                h = 1
                while h in kept:
                    h = 2 * h + int(x[r, nodes[h][0]] > nodes[h][1])
                assert label[r] == np.argmax(nodes[h][2])
        tried += 1
    assert tried > 10


@pytest.fixture(scope="module")
def table(spark):
    values, y = random_rows(3, 240, 4)
    return spark.createDataFrame([(i, [float(t) for t in v], f"c{c}") for i, (v, c) in enumerate(zip(values, y))], "id long, features array<double>, c string")


def nodes_of(df) -> list:
    return sorted((r["model"], r["tree"], r["heap"], r["feature"], r["cut"], tuple(r["counts"])) for r in df.collect())


@pytest.fixture(scope="module")
def few_groups():
    kept, trees.GROUPS = trees.GROUPS, 4
    yield
    trees.GROUPS = kept


def test_levels_over_blocks_equal_growing_in_a_task(table, few_groups, monkeypatch):
    """A table of many blocks: large nodes are split from summed histograms, the same trees come out and score alike."""
    units = [trees.Unit(0, 0, 4, 2, 0, 2), trees.Unit(1, 0, 4, 2, 2, 1), trees.Unit(2, 2, 3, 1, 0, 2)]
    data = trees.binned(table, "id", "c", 2)
    alone = trees.Unit(0, 1, 4)
    whole, single = nodes_of(trees.grown(data, units, trees.FOREST)), nodes_of(trees.grown(data, [alone], trees.TREE))
    tuned = {tuple(r)[:3]: r["accuracy"] for r in trees.tune_trees(data, [0.0, 0.05], [2, 4], 2).collect()}
    monkeypatch.setattr(trees, "BLOCK_ROWS", 90)
    parted = trees.binned(table, "id", "c", 2)
    assert data.blocks == 1 and parted.blocks == 3
    assert nodes_of(trees.grown(parted, units, trees.FOREST)) == whole
    assert nodes_of(trees.grown(parted, [alone], trees.TREE)) == single
    again = {tuple(r)[:3]: r["accuracy"] for r in trees.tune_trees(parted, [0.0, 0.05], [2, 4], 2).collect()}
    assert again == pytest.approx(tuned)


def test_a_grid_of_trees_equals_one_fit_each(table, few_groups):
    sizes, complexities = [2, 4], [0.0, 0.02, 0.1]
    data = trees.binned(table, "id", "c", 3)
    got = {(r["size"], r["value"]): r["accuracy"] for r in cls.tune_tree(table, "id", "c", complexities, 3, sizes=sizes).collect()}
    rows = data.rows.collect()
    x, y = np.array([list(r["x"]) for r in rows]), np.array([r["y"] for r in rows])
    for size, c in itertools.product(sizes, complexities):
        shares = []
        for b in range(3):
            w = np.array([r["draws"][b] for r in rows])
            one = trees.grow(x[:, :size], y, w[None], 3, 0, trees.mixed(np.arange(1)), trees.TREE)
            found = trees.pruned_labels(one, trees.weakest_links(one.heap, one.feature, one.counts), x[w == 0], [c])[0]
            shares.append(np.mean(found == y[w == 0]))
        assert got[size, c] == pytest.approx(np.mean(shares))
    best = cls.tune_components(cls.tune_tree(table, "id", "c", complexities, 3, sizes=sizes))
    assert {r["size"]: r["accuracy"] for r in best.collect()} == pytest.approx({s: max(v for (n, _), v in got.items() if n == s) for s in sizes})


def test_forests_vote_and_tune(table, few_groups):
    tuned = {(r["size"], r["value"]): r["accuracy"] for r in cls.tune_forest(table, "id", "c", [1, 2, 3], 20, 3, sizes=[2, 4]).collect()}
    assert set(tuned) == set(itertools.product([2, 4], [1.0, 2.0, 3.0]))
    assert tuned[2, 2.0] == tuned[2, 3.0] and tuned[4, 2.0] > tuned[2, 2.0] > 0.5
    predicted = cls.classify_forest(table, table, "id", "c", 2, 20)
    assert predicted.where("c = predicted").count() > 230 == predicted.count() - 10
    pruned = cls.classify_tree(table, table, "id", "c", 0.03)
    assert 150 < pruned.where("c = predicted").count() < 240
    stump = cls.classify_tree(table, table, "id", "c", 1.0)
    assert stump.select("predicted").distinct().count() == 1


def test_out_of_bag_loss_by_hand(table, few_groups):
    number = 15
    data = trees.binned(table, "id", "c")
    found = {r["feature"]: (r["importance"], r["error"]) for r in trees.forest_importance(data, 2, number).collect()}
    rows = sorted(data.rows.collect(), key=lambda r: r["h"] % 2**64)
    x, y, h = np.array([list(r["x"]) for r in rows]), np.array([r["y"] for r in rows]), np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    forest = {}
    for r in trees.grown(data, trees.forest_units(4, 2, number), trees.FOREST).collect():
        forest.setdefault(r["tree"], {})[r["heap"]] = (r["feature"], r["cut"], r["counts"])
    keys = trees.tree_keys(data.seed, 0, np.arange(number))

    def label(nodes, row):
        at = 1
        while nodes[at][0] >= 0:
            at = 2 * at + int(row[nodes[at][0]] > nodes[at][1])
        return int(np.argmax(nodes[at][2]))

    losses = np.zeros((number, 4))
    for t in range(number):
        u = (trees.mixed(h ^ keys[t]) >> np.uint64(11)) / float(1 << 53)
        out = np.flatnonzero(trees.poisson(np.ones(len(h), np.int64), u) == 0)
        base = np.mean([label(forest[t], x[i]) == y[i] for i in out])
        for f in {n[0] for n in forest[t].values() if n[0] >= 0}:
            order = out[np.argsort(trees.mixed(h[out] ^ trees.mixed(np.uint64(data.seed) + np.uint64(t * 1000003 + f))), kind="stable")]
            moved = x.copy()
            moved[order, f] = x[np.roll(order, 1), f]
            losses[t, f] = base - np.mean([label(forest[t], moved[i]) == y[i] for i in out])
    for f in range(4):
        assert found[f] == pytest.approx((losses[:, f].mean(), losses[:, f].std(ddof=1) / np.sqrt(number)), abs=1e-9)
    loss, scaled = cls.forest_importance(table.selectExpr("id", "c", *[f"features[{i}] AS v{i}" for i in range(4)]), "id", "c", ["v0", "v1", "v2", "v3"], 2, number)
    assert {r["feature"]: r["importance"] for r in loss.collect()} == pytest.approx({f"v{f}": found[f][0] for f in range(4)})
    by_name = {r["feature"]: r["importance"] for r in scaled.collect()}
    assert max(by_name.values()) == pytest.approx(100) and min(by_name.values()) == 0 and by_name["v0"] > by_name["v1"]


def test_poisson_draws():
    u = (np.arange(100_000) + 0.5) / 100_000
    for mean in (1, 3):
        drawn = trees.poisson(np.full(len(u), mean), u)
        assert drawn.mean() == pytest.approx(mean, abs=1e-3) and drawn.var() == pytest.approx(mean, abs=1e-2)
    assert not trees.poisson(np.zeros(5, np.int64), u[-5:]).any()


def test_rows_without_a_class_and_tables_of_one_class(spark, few_groups):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [0.0, 1.0], None)], "id long, features array<double>, c string")
    assert {r["predicted"] for r in cls.classify_forest(df, df, "id", "c", 1, 5).collect()} == {"a"}
    assert cls.tune_tree(df, "id", "c", [0.0], 2).count() == 1


@pytest.mark.parametrize("seed, classes, shape", [(1, 3, trees.FOREST), (2, 2, trees.Shape(5, 2, 4)), (3, 12, trees.FOREST), (4, 1, trees.FOREST)])
def test_forests_of_the_kernel_hit_what_grown_trees_hit(spark, seed, classes, shape):
    """One tree kept over all numbers of columns votes as trees grown for each number by themselves; rows that are alike, columns that cannot split, nodes of all sizes."""
    rng = np.random.default_rng(seed)
    values, y = rng.integers(0, 40, (400, 6)).astype(float), rng.integers(0, classes, 400)
    values[:, 3], values[:, 4] = 1.0, values[:, 0]
    values[:40], y[100:] = values[0], np.where(rng.random(300) < 0.7, (values[100:, 0] + values[100:, 5]) % classes, y[100:])
    table = spark.createDataFrame([(i, v.tolist(), f"c{c:02d}") for i, (v, c) in enumerate(zip(values, y))], "id long, features array<double>, c string")
    data = trees.binned(table, "id", "c", 2)
    units = [trees.Unit(i, b, s, m, 3 * (b - 1), 12) for i, (b, s, m) in enumerate((b, s, m) for b in (1, 2) for m in (1, 2, 4) for s in (2, 3, 5, 6) if m <= s)]
    got = {(r["resample"], r["mtry"], r["size"]): (r["hits"], r["n"]) for r in trees._hits_of_forests(data, units, shape).collect()}
    rows = sorted(data.rows.collect(), key=lambda r: r["h"] % 2**64)
    x, y, h = np.array([list(r["x"]) for r in rows], np.uint8), np.array([r["y"] for r in rows]), np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    for u in units:
        given = np.array([r["draws"][u.resample - 1] for r in rows], np.int64)
        keys = trees.tree_keys(data.seed, u.resample, np.arange(u.first, u.first + u.trees))
        drawn = np.stack([trees.poisson(given, (trees.mixed(h ^ k) >> np.uint64(11)) / float(1 << 53)) for k in keys])
        made, held = trees.grow(x[:, :u.size], y, drawn, len(data.levels), u.mtry, keys, shape), np.flatnonzero(given == 0)
        votes = np.zeros((len(held), len(data.levels)))
        for t in range(u.trees):
            votes[np.arange(len(held)), made.counts.argmax(axis=1)[made.leaves(x, np.full(len(held), t), held)]] += 1
        assert got.pop((u.resample, u.mtry, u.size)) == ((votes.argmax(axis=1) == y[held]).sum(), len(held))
    assert not got
