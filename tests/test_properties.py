"""Properties and brute-force comparisons on small fixtures, with hot groups included."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brindle.functions import tails
from brindle.operators import aggregates as agg, columns, joins, levels, neighbours, normality, split, statistics
from brindle.operators.quantiles import exact_quantiles
from brindle.plans import classifiers as cls, effects, penalties, ratings_study as study
from brindle.sources import views
from brindle.storage import write_out


@pytest.fixture(scope="module")
def rated(spark, small):
    return write_out(views.rated(spark, small), "rated")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 4)) * 4
    data = [(i, i % 3, *map(float, centre[i % 3] + rng.normal(size=4))) for i in range(240)]
    return spark.createDataFrame(data, "id bigint, c bigint, a double, b double, d double, e double")


COLS = ["a", "b", "d", "e"]


def test_quantiles_match_numpy_with_hot_and_null_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([2.5]), None: rng.exponential(size=77)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    # A coarse sketch gives wide brackets; the result must not depend on it.
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        assert got[g]["quantiles"] == pytest.approx(list(np.quantile(vs, probs)), abs=1e-12)


def test_hold_out_is_the_least_hashes(spark, rated):
    out = split.split_stratified_numeric(rated, "rating", 0.1, ["row_id"], 1)
    binned = split.numeric_strata(out, "rating").withColumn("h", split.row_hash(["row_id"], 1))
    sizes = binned.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("held_out").alias("k"),
                                            F.max(F.when(F.col("held_out"), F.col("h"))).alias("top"),
                                            F.min(F.when(~F.col("held_out"), F.col("h"))).alias("rest")).collect()
    assert all(r["k"] == math.ceil(round(0.1 * r["n"], 9)) and r["top"] < r["rest"] for r in sizes)


def test_long_prefixes_and_table_of_cuts_give_the_same_split(spark, rated, monkeypatch):
    plain = split.split_stratified_class(rated, "genres", 0.3, ["row_id"], 4).filter("held_out").select("row_id")
    wanted = plain.collect()
    monkeypatch.setattr(split, "LITERAL_STRATA", 3)
    short = split.hash_cuts
    monkeypatch.setattr(split, "hash_cuts", lambda h, s, r: short(h, s, r, prefix_digits=1, prefix_rows=2))
    again = split.split_stratified_class(rated, "genres", 0.3, ["row_id"], 4).filter("held_out").select("row_id")
    assert sorted(wanted) == sorted(again.collect())


def test_folds_are_disjoint_covering_and_balanced(spark, rated):
    folded = split.numeric_strata(split.kfold_stratified(rated, "rating", 10, ["row_id"], 3), "rating")
    assert folded.filter("fold is null or fold < 1 or fold > 10").count() == 0
    sizes = folded.groupBy("__stratum", "fold").count().groupBy("__stratum").agg(F.max("count") - F.min("count"), F.count("fold"))
    assert all(r[1] <= 1 and r[2] == 10 for r in sizes.collect())


def test_hash_split_share(spark, rated):
    share = split.hash_split(rated, 0.2, ["row_id"], 1).agg(F.avg(F.col("held_out").cast("double"))).first()[0]
    assert abs(share - 0.2) < 0.03


def test_bootstrap_weights_are_poisson(spark, rated):
    r = split.bootstrap_weights(rated.select("row_id"), 5, ["row_id"], 1).agg(
        F.avg("weight"), F.var_samp("weight"), F.avg((F.col("weight") == 0).cast("double"))).first()
    assert (r[0], r[1], r[2]) == pytest.approx((1, 1, math.exp(-1)), abs=0.03)


def test_levels_are_sorted(spark, rated):
    got = [r["level"] for r in levels.category_levels(rated, "genres").orderBy("code").collect()]
    assert got == sorted({r[0] for r in rated.select("genres").distinct().collect()})


def test_tuning_equals_row_by_row(spark):
    """With keys seen in one fold only, so that unseen groups and unknown items occur."""
    rng = np.random.default_rng(3)
    data = [(int(m), int(u), float(rng.integers(1, 11)) / 2, int(f)) for m, u, f in
            zip(np.where(rng.random(400) < 0.35, 0, rng.integers(1, 60, 400)), rng.integers(0, 90, 400), rng.integers(1, 5, 400))]
    train = spark.createDataFrame(data, "movieId bigint, userId bigint, rating double, fold bigint")
    chosen = list(effects.EFFECTS[:2])
    means = penalties.fold_means(train, "fold", "rating")
    cells = penalties.tuning_rows(train, chosen, "fold", "rating")
    table = effects.fit_effect(cells, chosen[0], 3.0)
    me = dict(map(tuple, table.collect()))
    user_cells = effects.next_cells(cells, chosen[0], table, chosen[1:], ["fold", "known"])
    for rule in ("propagate", "drop", "zero"):
        got = {(r["fold"], r["lam"]): r["rmse"] for r in penalties.tune_penalty(user_cells, "userId", means, [0.0, 2.0], on_unseen=rule).collect()}
        for (fold, lam), value in got.items():
            out = [d for d in data if d[3] != fold]
            mu = np.mean([d[2] for d in out])
            sums = {}
            for m, u, y, _ in out:
                s, n = sums.get(u, (0.0, 0))
                sums[u] = (s + y - mu - me[m], n + 1)
            errors, missing, known = [], False, {d[0] for d in out}
            for m, u, y, f in data:
                if f != fold or m not in known:
                    continue
                if u not in sums:
                    missing = True
                    if rule != "zero":
                        continue
                s, n = sums.get(u, (0.0, 1))
                errors.append((y - mu - me[m] - s / (n + lam)) ** 2)
            if rule == "propagate" and missing:
                assert value is None
            else:
                assert value == pytest.approx(math.sqrt(np.mean(errors)), abs=1e-10)


def test_penalty_limits(spark, rated):
    mu = study.mean_rating(rated)
    huge, none = (effects.fit_effects(rated, [effects.EFFECTS[0].with_penalty(p)], mu)[0][1] for p in (1e12, 0.0))
    assert huge.agg(F.max(F.abs("me"))).first()[0] < 1e-6
    means = rated.groupBy("movieId").agg((F.avg("rating") - mu).alias("m"))
    assert none.join(means, "movieId").agg(F.max(F.abs(F.col("me") - F.col("m")))).first()[0] < 1e-9


def test_training_error_falls_without_penalty(spark, rated):
    mu = study.mean_rating(rated)
    fitted = effects.fit_effects(rated, [e.with_penalty(0) for e in effects.EFFECTS], mu)
    values = [r["rmse"] for r in effects.nested_rmses(rated, fitted, mu, study.MODELS).orderBy("pos").collect()]
    assert values == sorted(values, reverse=True)


def test_cells_equal_rows(spark, rated):
    """Effects from reduced cells equal those from rows joined with every earlier effect."""
    mu = study.mean_rating(rated)
    fitted = effects.fit_effects(rated, list(effects.EFFECTS), mu)
    joined = effects.predict_ratings(rated, fitted[:3], mu)
    direct = agg.shrunken_effect(joined, "year", F.col("rating") - F.col("predicted"), 4.0, "direct")
    gap = joins.null_safe_join(fitted[3][1], direct, ["year"]).agg(F.max(F.abs(F.col("ye") - F.col("direct"))), F.count("direct")).first()
    assert gap[0] < 1e-9 and gap[1] == fitted[3][1].count()


def test_neighbours_match_brute_force_over_many_blocks(spark, points):
    train, test = points.filter("id % 5 <> 0"), points.filter("id % 5 = 0")
    arrays = [columns.features_to_array(d, COLS) for d in (train, test)]
    near = neighbours.nearest_neighbours(*arrays, "id", "c", 4, block_rows=17)
    got = {(r["id"], r["place"]): r["near"] for r in near.collect()}
    x, y = (np.array([[r["id"], *[r[c] for c in COLS]] for r in d.collect()]) for d in (train, test))
    for row in y:
        order = np.argsort(((x[:, 1:] - row[1:]) ** 2).sum(axis=1), kind="stable")[:4]
        assert [got[(int(row[0]), p)] for p in (1, 2, 3, 4)] == [int(x[i, 0]) for i in order]


def test_indexed_neighbours_are_exact_and_compare_a_share_of_the_pairs(spark):
    """Clustered rows, with ties at equal places, rows far off, and cells without scored rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 20, (12, 5))
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(0, 0.5, (700, 5)), rng.normal(0, 60, (20, 5)), np.zeros((30, 5))])
    rows = [(i, [float(t) for t in v], int(i % 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>, c long")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    plain = neighbours.nearest_neighbours(train, test, "id", "c", 5, block_rows=2000)
    indexed = neighbours.indexed_neighbours(train, test, "id", "c", 5, block_rows=25)
    as_rows = lambda d: sorted((r["id"], r["place"], r["near"], r["label"], round(r["distance"], 9)) for r in d.collect())
    assert as_rows(indexed) == as_rows(plain)
    known, other, own = neighbours.routed_rows(train, test, "id", "c", 5, block_rows=25)
    per_cell = {r["cell"]: r["count"] for r in known.groupBy("cell").count().collect()}
    compared = sum(per_cell.get(r["cell"], 0) for r in other.collect())
    assert len(per_cell) > 5 and compared < 0.45 * train.count() * test.count()  # the 20 far rows have wide cells


def test_weighted_votes(spark):
    near = spark.createDataFrame([(1, 1, "b", 2.0), (1, 2, "a", 3.0), (2, 1, "b", 1.0), (2, 2, "a", 1.0)],
                                 "id int, place int, label string, weight double")
    got = {k: {r["id"]: r["predicted"] for r in neighbours.vote(near, ["id"], k).collect()} for k in (2, 5)}
    assert got == {2: {1: "b", 2: "a"}, 5: {1: "a", 2: "a"}}


def test_tail_probabilities():
    assert tails.f_tail(3.0873, 2, 100) == pytest.approx(0.05, abs=1e-5)
    assert tails.chi2_tail(9.4877, 4) == pytest.approx(0.05, abs=1e-5)
    assert tails.chi2_tail(2.0, 4) == pytest.approx(math.exp(-1) * 2, abs=1e-12)
    assert tails.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-7)


def _hz(x):
    n, p = x.shape
    s = np.linalg.inv(np.cov(x.T, bias=True))
    gap = x[:, None, :] - x[None, :, :]
    d = np.einsum("ijk,kl,ijl->ij", gap, s, gap)
    own = np.einsum("ik,kl,il->i", x - x.mean(0), s, x - x.mean(0))
    b = (n * (2 * p + 1) / 4) ** (1 / (p + 4)) / math.sqrt(2)
    return (np.exp(-b * b / 2 * d).sum() / n - 2 * (1 + b * b) ** (-p / 2) * np.exp(-b * b / (2 * (1 + b * b)) * own).sum()
            + n * (1 + 2 * b * b) ** (-p / 2))


def test_normality_tests(spark):
    rng = np.random.default_rng(8)
    normal = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    skewed = rng.exponential(size=(200, 4))
    for x, is_normal in ((normal, True), (skewed, False)):
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, d double, e double")
        hz = normality.mvn_henze_zirkler(df, COLS, "id", block_rows=30).first()
        dh = normality.mvn_doornik_hansen(df, COLS).first()
        assert hz["statistic"] == pytest.approx(_hz(x), rel=1e-9)
        assert (hz["p_value"] > 0.01) == is_normal and (dh["p_value"] > 0.01) == is_normal


def test_correlation(spark, points):
    m = statistics.correlation_matrix(points, COLS)
    assert np.allclose(m, m.T) and np.all(np.abs(m) <= 1 + 1e-12)


def test_components(spark, points):
    found = cls.Components(points, COLS)
    shares = found.explained(points).orderBy("component").collect()
    assert shares[-1]["cumulative"] == pytest.approx(1) and shares[0]["share"] >= shares[1]["share"]
    scores = np.array([r["s"] for r in found.project(points).select(vector_to_array("features").alias("s")).collect()])
    off = np.corrcoef(scores.T) - np.eye(4)
    assert np.abs(off).max() < 1e-8
    top = found.loadings(points).groupBy("component").agg(F.max_by("loading", F.abs("loading"))).collect()
    assert all(r[1] > 0 for r in top)


def test_classifiers_separate_and_importance_is_scaled(spark, points):
    train, test = points.filter("id % 4 <> 0"), points.filter("id % 4 = 0")
    for fit in (cls.fit_tree, lambda rows: cls.fit_forest(rows, 2, 15)):
        predicted, model = cls.classify(train, test, COLS, "c", fit)
        hit = predicted.agg(F.avg((F.col("predicted") == F.col("c").cast("string")).cast("double"))).first()[0]
        assert hit > 0.85
    found = cls.gini_importance(model, COLS, train)
    assert found.agg(F.max("importance")).first()[0] == 100
    scored = cls.with_label_index(train, "c").transform(columns.features_to_vector(test, COLS))
    lost = cls.permutation_importance(model, scored, COLS, "id", block_rows=20).agg(F.max("importance")).first()[0]
    assert lost > 0.05


def test_tuning_of_classifiers(spark, points):
    ready = cls.with_label_index(points, "c").transform(columns.features_to_vector(points, COLS))
    got = cls.tune_classifier(ready, "id", lambda rows, g: cls.fit_tree(rows, g, "weight", 4), [0.0, 0.9], resamples=2)
    acc = {r["value"]: r["accuracy"] for r in got.collect()}
    assert acc[0.0] > 0.8 > acc[0.9]
    knn = cls.tune_knn(columns.features_to_array(points, COLS), "id", "c", [2, 5], resamples=3, sizes=[2, 4])
    assert {(r["size"], r["k"]) for r in knn.collect()} == {(2, 2), (2, 5), (4, 2), (4, 5)}
    assert knn.filter("size = 4").agg(F.min("accuracy")).first()[0] > 0.85


def test_tuning_queries_cover_the_whole_grids(spark, small, monkeypatch):
    """The grower is only asked here: 40 complexities or 8 mtry, 25 resamples, all sizes, the study's numbers of trees."""
    from brindle.plans import trees
    from registry import expression_queries as registered

    seen = []
    answer = spark.createDataFrame([(2, 1, 1.0, 0.5)], "size long, pos long, value double, accuracy double")
    monkeypatch.setattr(trees, "tune_trees", lambda data, grid, sizes, resamples: seen.append((grid, sizes, resamples)) or answer)
    monkeypatch.setattr(trees, "tune_forests", lambda data, grid, sizes, resamples, number: seen.append((grid, sizes, resamples, number)) or answer)
    every, all_columns = list(range(2, len(registered.KEPT) + 1)), [len(registered.KEPT)]
    complexities = [0.05 * i / 39 for i in range(40)]
    for name in ("tune_components_tree", "tune_classifier_tree", "tune_components_forest", "tune_classifier_forest"):
        registered.QUERIES[name][0](spark, small)
    assert seen == [(complexities, every, 25), (complexities, all_columns, 25), (list(range(1, 9)), every, 25, 100), (list(range(1, 9)), all_columns, 25, 500)]


def test_models_on_components_use_the_best_number_of_them(spark, monkeypatch):
    """Two components carry the class, the others are noise: the models must not be fitted on all."""
    from brindle.plans import expression_study as study

    rng = np.random.default_rng(5)
    data = []
    for i in range(160):
        c = i % 4
        x = rng.normal(0, 0.3, 6) + np.repeat([c % 2, c // 2 * 1.5], 3) * 3
        data.append((i, *map(float, x), c))
    names = [f"v{j}" for j in range(6)]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names) + ", c long")
    effort = study.Effort([0.0], [2, 3], [1], [0.0], [2, 3], 5, 2, 3)
    inputs = study.model_inputs(df, names, "id", "c", 0.4, 4021)
    widths = []
    for act in ("tune_refit_score_tree", "tune_refit_score_forest", "tune_refit_score_knn"):
        def spy(train, test, *rest, real=getattr(cls, act), **named):
            widths.append({len(d.first()["features"]) for d in (train, test)})
            return real(train, test, *rest, **named)
        monkeypatch.setattr(cls, act, spy)
    for kind in ("neighbours", "tree", "forest"):
        tuned = {r["size"]: r["accuracy"] for r in study.component_sizes(inputs, kind, "id", "c", effort).collect()}
        best = min(tuned, key=lambda n: (-tuned[n], n))
        assert set(tuned) == {2, 3, 4, 5, 6} and best < 6
        found = study.model_predictions(inputs, f"{kind}, components", names, names[:3], "id", "c", effort)
        assert widths.pop() == {best} and not widths
        assert found.filter(F.col("predicted") == F.col("c").cast("string")).count() > 0.9 * inputs.test.count()


def test_registered_studies_are_tuned_in_full():
    from brindle.plans.expression_study import Effort
    from registry import expression_queries as registered

    assert registered.EFFORT == Effort() and (Effort().trees, Effort().resamples, Effort().size_trees) == (500, 25, 100)
    assert len(Effort().complexities) == 40 and len(Effort().component_complexities) == 20 and Effort().complexities[-1] == Effort().component_complexities[-1] == 0.05
    assert Effort().component_neighbours == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20]


def test_imputation_leaves_known_cells(spark, small):
    df = views.proteins(spark, small).select("MouseID", "class", "p00", "p05")
    full = agg.impute_group_median(df, "class", ["p00", "p05"])
    both = df.join(full.withColumnsRenamed({"p00": "q00", "p05": "q05"}), "MouseID")
    r = both.agg(F.count_if(F.col("p00") != F.col("q00")), F.count_if(F.col("q00").isNull()), F.count_if(F.col("q05").isNull())).first()
    assert tuple(r) == (0, 0, 0)


def test_doornik_hansen_statistic_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.gamma(2.0, 1.0, (400, 3)) @ np.array([[1, .3, 0], [0, 1, .2], [.1, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    row = normality.mvn_doornik_hansen(df, ["a", "b", "c"]).first().asDict()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    r = z @ vectors @ np.diag(values ** -0.5) @ vectors.T
    n, d = len(x), r - r.mean(0)
    m2, m3, m4 = (np.mean(d ** k, 0) for k in (2, 3, 4))
    s, k = m3 / m2 ** 1.5, m4 / m2 ** 2
    # skewness after D'Agostino, kurtosis after Wilson and Hilferty (Doornik and Hansen 2008)
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + np.sqrt(2 * (beta - 1))
    delta, y = 1 / np.sqrt(np.log(np.sqrt(w2))), s * np.sqrt((w2 - 1) / 2 * (n + 1) * (n + 3) / (6 * (n - 2)))
    z1 = delta * np.log(y + np.sqrt(y * y + 1))
    dd = (n - 3) * (n + 1) * (n * n + 15 * n - 4)
    a = (n - 2) * (n + 5) * (n + 7) * (n * n + 27 * n - 70) / (6 * dd)
    c = (n - 7) * (n + 5) * (n + 7) * (n * n + 2 * n - 5) / (6 * dd)
    kk = (n + 5) * (n + 7) * (n ** 3 + 37 * n * n + 11 * n - 313) / (12 * dd)
    alpha = a + s * s * c
    chi = np.maximum(k - 1 - s * s, 0) * 2 * kk
    z2 = ((chi / (2 * alpha)) ** (1 / 3) - 1 + 1 / (9 * alpha)) * np.sqrt(9 * alpha)
    statistic = next(v for name, v in row.items() if "stat" in name.lower() or name.lower() in ("e", "ep"))
    assert statistic == pytest.approx(float((z1 ** 2 + z2 ** 2).sum()), rel=1e-6)


def test_expression_report_has_every_table(spark):
    rng = np.random.default_rng(11)
    names = [f"v{i}" for i in range(6)]
    data = []
    for i in range(120):
        c = i % 3
        x = rng.normal(0, 1, 6) + np.array([c, -c, 0, 2 * c, 0, 1])
        data.append((i, *[None if (i * 7 + j) % 29 == 0 else float(v) for j, v in enumerate(x)], i % 2, c))
    schema = "id long, " + ", ".join(f"{n} double" for n in names) + ", f long, c long"
    from brindle.plans.expression_study import LADDER, Effort, expression_report
    report = expression_report(spark.createDataFrame(data, schema), names, names[:3], "id", "c", ["f", "c"],
                               effort=Effort([0.0, 0.05], [2, 3], [1, 2], [0.0], [2], 5, 2, 3))
    ladder = {r["model"]: r["accuracy"] for r in report["ladder"].collect()}
    assert len(ladder) == len(LADDER) and report["ensemble_accuracy"].first()[0] > 0.6
    assert report["scatter"].select("pair").distinct().count() == 3 and report["top_features"].count() == 6
    assert report["clean"].filter(" OR ".join(f"{n} IS NULL" for n in names)).count() == 0
    for name, table in report.items():
        assert table.columns, name


def test_quantiles_of_groups_of_all_shapes(spark):
    from brindle.operators import quantiles

    rng = np.random.default_rng(1)
    n, probs = 24_000, [0.0, 0.25, 0.5, 0.75, 1.0, 0.333, 0.999]
    group = rng.integers(0, 4, n)
    value = np.select([group == 0, group == 1, group == 2], [rng.integers(0, 5, n), rng.normal(0, 1, n), rng.exponential(1, n) ** 8], 1.0)
    names = np.where(group == 3, None, group.astype(str)).tolist() + [f"few{i % 7}" for i in range(40)] + ["one", "gap", "gap"]
    values = value.tolist() + rng.normal(size=40).tolist() + [7.0, None, float("nan")]
    df = spark.createDataFrame(list(zip(names, values)), "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(names) - {"gap"}
    for name in got:
        own = [v for g, v in zip(names, values) if g == name and v is not None and v == v]
        assert got[name]["n"] == len(own) and np.allclose(got[name]["quantiles"], np.quantile(own, probs), rtol=1e-12, atol=0)
    known = [v for v in values if v is not None and v == v]
    assert np.allclose(quantiles.quantile_literals(df, "v", probs), np.quantile(known, probs), rtol=1e-12, atol=0)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_a_report_is_refused_not_cut(spark):
    from brindle.sources.reports import markdown

    assert markdown(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]
    with pytest.raises(ValueError):
        markdown(spark.range(3), limit=2)


def test_neighbours_by_the_index_and_by_the_kernel_are_alike(spark, monkeypatch):
    """The index answers if it leaves few pairs, else all pairs are compared; both give the same rows, equal distances included."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "id long, features array<double>, c long")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    found = []
    for most in (2.0, -1.0):
        monkeypatch.setattr(neighbours, "MOST_IN_REACH", most)
        near = neighbours.indexed_neighbours(train, test, "id", "c", 5, block_rows=25)
        found.append(sorted((r["id"], r["place"], r["near"], r["label"], round(r["distance"], 9)) for r in near.collect()))
    assert found[0] == found[1] and len(found[0]) == 75 * 5
    for i in range(0, 300, 4):
        order = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(300) if j % 4)[:5]
        assert [(r[2], r[4]) for r in found[0] if r[0] == i] == [(j, round(d ** 0.5, 9)) for d, j in order]


def test_votes_of_resamples_by_hand(spark, monkeypatch):
    """Blocks of few rows, equal distances, weights, keys that come twice or are null, rows without a class; the same if too few rows are kept at first."""
    rng = np.random.default_rng(9)
    x, key = rng.integers(0, 4, (120, 3)).astype(float), [*range(100), *range(15), *[None] * 5]
    label = [None if i % 17 == 3 else f"c{int(v[0] + v[1]) % 3}" for i, v in enumerate(x)]
    weights = {k: [int(w) for w in rng.poisson(1, 3)] for k in range(100)} | {None: [1, 1, 0]}
    draws = [weights[k] for k in key]
    df = spark.createDataFrame([(k, v.tolist(), c, d) for k, v, c, d in zip(key, x, label, draws)], "id long, features array<double>, c string, d array<int>")
    expected = {}
    for b, size, k in ((b, size, k) for b in range(3) for size in (2, 3) for k in (1, 2, 6)):
        hits = n = 0
        for one in range(100):
            if weights[one][b]:
                continue
            rows = [i for i in range(120) if key[i] == one]
            near = [sorted((((x[i, :size] - x[j, :size]) ** 2).sum(), -1 if key[j] is None else key[j], j) for j in range(120) if draws[j][b] > 0)[:6] for i in rows]
            votes, left = {}, k
            for d, _, j in sorted(sum(near, []))[:6]:
                votes[label[j]], left = votes.get(label[j], 0) + min(left, draws[j][b]), max(0, left - draws[j][b])
            found = min((-v, c or "", c) for c, v in votes.items() if v > 0)[2]
            n += sum(label[i] is not None and found is not None for i in rows)
            hits += sum(label[i] is not None and label[i] == found for i in rows)
        expected[b + 1, size, k] = hits, n
    unlike = {}
    for kept in (4, 1):
        monkeypatch.setattr(neighbours, "KEPT", kept)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
        got = neighbours.votes_of_resamples(df, "id", "c", [1, 2, 6], F.col("d"), sizes=[2, 3])
        unlike[kept] = {(r["resample"], r["size"], r["k"]): (r["hits"], r["n"]) for r in got.collect()}
    assert unlike[4] == unlike[1]
    # rows of one key and equal distances have no order of their own
    assert set(unlike[4]) == set(expected) and all(abs(unlike[4][c][0] - expected[c][0]) <= 3 and unlike[4][c][1] == pytest.approx(expected[c][1], abs=3) for c in expected)
