"""Hand-computed cases for the semantics that differ from Spark's defaults."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from brindle.functions import text
from brindle.functions.numbers import grid_values
from brindle.operators import aggregates as agg, columns, joins, levels, split, statistics
from brindle.operators.quantiles import exact_quantiles
from brindle.plans import classifiers as cls, effects, penalties, ratings_study as study
from brindle.plans.expression_study import drop_sparse_and_impute, standardize
from brindle.sources import delimited
from brindle.sources.reports import schema_profile


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_safe_left_join(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert rows(joins.join_null_safe(left, right, "k")) == rows(right)


def test_anti_join_keeps_copies_and_matches_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None)], "k int, v string")
    assert rows(joins.anti_join_natural(a, b)) == [(1, "x"), (1, "x"), (3, "z")]


def test_rmse_with_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "y double, p double")
    assert agg.rmse(df, "y", "p").first()[0] is None
    assert agg.rmse(df, "y", "p", na_rm=True).first()[0] == 0


def test_arg_min_and_arg_max_take_the_first(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 2.0, 0.9), (1, 3, 3.0, 0.9), (1, 4, 4.0, 1.0)],
                               "fold int, pos int, lam double, rmse double")
    assert agg.arg_min_per_group(df, ["fold"], "rmse", "pos", "lam").first()["best"] == 2.0
    acc = spark.createDataFrame([(2, 0.8), (3, 0.9), (4, 0.9)], "pos int, a double")
    assert agg.arg_max(acc, "a", "pos").first()["best_pos"] == 3


def test_raw_fields(spark, tmp_path):
    (tmp_path / "m.dat").write_text('1::"Great" Movie, The (1995)::Drama\n3::::\n')
    schema = StructType().add("id", LongType()).add("title", StringType()).add("genres", StringType())
    got = rows(delimited.scan_delimited(spark, str(tmp_path / "m.dat"), schema))
    assert got == [(1, '"Great" Movie, The (1995)', "Drama"), (3, "", "")]


def test_year(spark):
    cases = {"Toy Story (1995)": 1995, "No year": None, "A (1999) B (2001)": 1999, "(500) Days (2009)": 2009,
             "2001: X (1968)": 1968, "Y (20091)": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.extract_year(F.col("t"))).collect()} == cases


def test_split_fixed(spark):
    df = spark.createDataFrame([("2::A::Drama",), ("3::B",), ("4::C::D::E",)], "v string")
    assert rows(df.select(*text.split_fixed(F.col("v"), "::", 3))) == [
        ("2", "A", "Drama"), ("3", "B", ""), ("4", "C", "D::E")]


def test_remove_first_and_casts(spark):
    df = spark.createDataFrame([("(a(b",)], "v string")
    row = df.select(text.remove_first(F.col("v"), r"\("), text.to_number(F.col("v"))).first()
    assert tuple(row) == ("a(b", None)


def test_distinct_counts_a_null(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "a int")
    assert agg.distinct_counts(df, ["a"]).first()[0] == 2


def test_more_than(spark):
    df = spark.createDataFrame([("a", 5), ("a", 4), ("b", 3)], "k string, v int")
    assert rows(agg.group_mean(df, "k", "v", 1).select("k", "avg")) == [("a", 4.5)]
    assert rows(agg.group_mean(df, "k", "v").select("k", "avg")) == [("a", 4.5), ("b", 3.0)]


def test_unseen_rules(spark):
    table = spark.createDataFrame([(1, 0.5)], "movieId int, me double")
    df = spark.createDataFrame([(2, 3.0)], "movieId int, rating double")
    fitted = [(effects.EFFECTS[0], table)]
    got = lambda rule: [r["predicted"] for r in effects.predict_ratings(df, fitted, 3.0, {"me": rule}).collect()]
    assert got("zero") == [3.0] and got("propagate") == [None] and got("drop") == []


def test_known_keys(spark):
    train = spark.createDataFrame([("u1", "m1"), ("u2", "m2")], "u string, m string")
    test = spark.createDataFrame([("u1", "m2"), ("u3", "m1"), ("u1", "m9")], "u string, m string")
    kept, back = split.holdout_known_keys(test, train, ["m", "u"], return_removed=True)
    assert rows(kept) == [("u1", "m2")]
    assert rows(back) == sorted([("u1", "m1"), ("u2", "m2"), ("u3", "m1"), ("u1", "m9")], key=repr)
    assert split.holdout_known_keys(test, train, ["m", "u"])[1] is train


def test_correlation_bands(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", -0.75), ("b", "c", 0.55)], "i string, j string, r double")
    shares = lambda how: [r["share"] for r in statistics.correlation_bands(pairs, 3, denominator=how).orderBy(F.desc("cutoff")).collect()]
    assert shares("full") == pytest.approx([1 / 9, 2 / 9, 3 / 9])
    assert shares("pairs") == pytest.approx([1 / 3, 2 / 3, 1])


def test_standardize_uses_training_moments(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    assert standardize(train, spark.createDataFrame([(4.0,)], "a double"), ["a"]).first()[0] == 2.0


def test_vote(spark):
    cases = {"AAA": "A", "AAB": "A", "ABA": "A", "ABB": "B", "ABC": "B"}
    df = spark.createDataFrame([tuple(c) for c in cases], "a string, b string, c string")
    got = {r["a"] + r["b"] + r["c"]: r["ensemble"] for r in cls.vote_ensemble(df, "a", "b", "c").collect()}
    assert got == cases


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    row = exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert row["n"] == 4 and row["quantiles"] == [1.0, 1.75, 2.5, 10.0]


def test_group_median_fill(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("a", 8.0), ("b", None), (None, 4.0), (None, None)],
                               "g string, v double")
    got = rows(agg.impute_group_median(df, "g", ["v"]))
    assert got == sorted([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 8.0), ("b", None), (None, 4.0), (None, 4.0)], key=repr)


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([("k", 1.0, None)], "k string, p double, q double")
    assert rows(columns.unpivot_levels(df, ["k"], ["p", "q"])) == [("k", "p", 1.0), ("k", "q", None)]


def test_proportions_leave_null_out(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert {r["c"]: r["share"] for r in agg.proportions(df, "c").collect()} == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    assert agg.count_by(df, "c").count() == 3


def test_shrunken_effect(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("a", 3.0), ("b", 1.0)], "k string, y double")
    assert rows(agg.shrunken_effect(df, "k", F.col("y") - 3, 1.0)) == [("a", 0.75), ("b", -1.0)]
    with_null = df.union(spark.createDataFrame([("b", None)], "k string, y double"))
    assert dict(rows(agg.shrunken_effect(with_null, "k", F.col("y") - 3, 1.0)))["b"] is None


def test_box_statistics(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    assert tuple(agg.boxplot_stats(df, ["g"], "v").first()) == ("g", 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_near_zero_variance(spark):
    df = spark.createDataFrame([(0.0 if i < 97 else 1.0, float(i % 2), 7.0) for i in range(100)], "a double, b double, c double")
    got = {r["name"]: (r["near_zero"], r["zero_variance"]) for r in statistics.near_zero_variance(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (True, True)}


def test_anova(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {"a": (1, 2, 3), "b": (2, 3, 4), "c": (5, 6, 7)}.items() for v in vs],
                               "g string, y double")
    r = statistics.anova_oneway(df, "y", "g").first()
    assert (r["ss_between"], r["ss_within"], r["df_between"], r["df_within"], r["f"]) == pytest.approx((26, 6, 2, 6, 13))
    assert r["p"] == pytest.approx(0.0066, abs=1e-4)


def test_class_split_sizes(spark):
    df = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(8)], "id int, c string")
    got = split.split_stratified_class(df, "c", 0.4, ["id"], 1).filter("held_out").groupBy("c").count()
    assert rows(got) == [("x", 2), ("y", 2)]


def test_grid_lookup(spark):
    cells = spark.createDataFrame([(k, f, True, 2, 1.0 * k, 3.0) for k in (1, 2) for f in (1, 2)],
                                  "k int, fold int, known boolean, rows bigint, total double, square double")
    means = spark.createDataFrame([(1, 0.1), (2, 0.2)], "fold int, mu double")
    year, user = grid_values(0, 20, 1), grid_values(3.5, 6.5, 0.1)
    got = penalties.tune_penalty(cells, "k", means, year, lookup_grid=user).filter("pos = 5").first()["lam"]
    assert year[4] == 4 and got == pytest.approx(3.9)


def test_derived_attribute_must_be_unique(spark):
    df = spark.createDataFrame([(1, "A (1990)"), (1, "A (1991)")], "m int, t string")
    with pytest.raises(Exception, match="not unique"):
        joins.join_derived_attr(df, "m", "year", text.extract_year(F.col("t"))).collect()


def _cells(spark, per_cell, keys=200, folds=10, seed=4):
    """Sums of simulated ratings: per (key, fold) ``per_cell`` rows with a small effect per key."""
    import numpy as np

    rng = np.random.default_rng(seed)
    effect = rng.normal(0, 0.4, keys)
    mean = 3.5 + effect[:, None] + rng.normal(0, 1 / np.sqrt(per_cell), (keys, folds))
    total = np.round(mean * per_cell)
    square = np.round(per_cell * (mean ** 2 + 1))
    rows = [(k, f + 1, True, per_cell, float(total[k, f]), float(square[k, f])) for k in range(keys) for f in range(folds)]
    df = spark.createDataFrame(rows, "k long, fold int, known boolean, rows long, total double, square double")
    n, s = float(per_cell * keys * (folds - 1)), total.sum()
    return df, total, spark.createDataFrame([(f + 1, float((s - total[:, f].sum()) / n)) for f in range(folds)], "fold int, mu double")


@pytest.mark.parametrize("per_cell", [50, 10_000, 1_000_000])
def test_penalty_choice_is_exact_at_any_size(spark, per_cell):
    from fractions import Fraction

    cells, total, means = _cells(spark, per_cell)
    grid = penalties.GRIDS["ue"]
    got = {r["fold"]: r["best_pos"] for r in penalties.best_penalties(penalties.tune_penalty(cells, "k", means, grid)).collect()}
    for row in means.collect():
        f, mu = row["fold"] - 1, Fraction(row["mu"])
        n_out, best = per_cell * (total.shape[1] - 1), None
        for pos, lam in enumerate(grid, start=1):
            part = Fraction(0)
            for k in range(len(total)):
                b = (Fraction(int(total[k].sum() - total[k, f])) - n_out * mu) / (n_out + Fraction(lam))
                part += per_cell * b * b - 2 * b * (Fraction(int(total[k, f])) - per_cell * mu)
            best = (part, pos) if best is None or part < best[0] else best
        assert got[row["fold"]] == best[1]


def test_a_fold_without_error_stops_the_tuning(spark):
    cells = spark.createDataFrame([("a", 1, True, 1, 3.0, 9.0), ("a", 2, True, 1, 4.0, 16.0), ("single", 2, True, 1, 5.0, 25.0)],
                                  "k string, fold int, known boolean, rows long, total double, square double")
    means = spark.createDataFrame([(1, 4.5), (2, 3.0)], "fold int, mu double")
    errors = penalties.tune_penalty(cells, "k", means, [1.0, 2.0])
    with pytest.raises(ValueError, match="fold 2 has no error: key single"):
        penalties.tuned_penalty(errors)
    assert penalties.tuned_penalty(penalties.tune_penalty(cells, "k", means, [1.0, 2.0], on_unseen="drop")) in (1.0, 1.5, 2.0)


def test_null_keys_match(spark):
    rows_ = [(1, None, 1, False), (2, None, 1, True), (3, 7, None, True), (4, 8, 1, True)]
    df = spark.createDataFrame(rows_, "id int, movieId int, userId int, held_out boolean")
    got = {r["id"]: r["known"] for r in split.known_key_flag(df, "held_out", ["movieId", "userId"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    other = df.filter("not held_out")
    assert [r["id"] for r in joins.semi_join_keys(df, other, ["movieId", "userId"]).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in joins.complement_rows(df, other, "movieId").orderBy("id").collect()] == [3, 4]
    named = joins.join_fact_dim(df, spark.createDataFrame([(None, "none"), (7, "seven")], "movieId int, title string"), "movieId")
    assert {r["id"]: r["title"] for r in named.collect()} == {1: "none", 2: "none", 3: "seven", 4: None}


def test_levels_of_dates_and_hash_split_at_the_ends(spark):
    import datetime as dt

    days = [dt.date(2024, 1, d) for d in (3, 1, 2, 1)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date")
    assert [r["level"].day for r in levels.category_levels(df, "d").orderBy("code").collect()] == [1, 2, 3]
    many = spark.range(1000)
    assert split.hash_split(many, 1.0, ["id"], 1).filter("held_out").count() == 1000
    assert split.hash_split(many, 0.0, ["id"], 1).filter("held_out").count() == 0


def test_a_repeated_key_stops_the_split(spark):
    df = spark.createDataFrame([(1, "a")] * 10, "k int, c string")
    with pytest.raises(Exception, match="not unique"):
        split.split_stratified_class(df, "c", 0.5, ["k"], 1).collect()


def test_smallest_keeps_the_order_of_equal_values():
    import numpy as np

    from brindle.operators.neighbours import smallest

    rng = np.random.default_rng(1)
    for take in (1, 3, 7, 12):
        values = rng.integers(0, 4, (50, 12)).astype(float)
        assert (smallest(values, take) == np.argsort(values, axis=1, kind="stable")[:, :take]).all()


def test_release_removes_what_was_written(spark):
    from brindle import storage

    held, storage._WRITTEN = storage._WRITTEN, {}  # tables of other tests stay
    try:
        df = storage.write_out(spark.range(3), "released")
        assert df.count() == 3 and storage.release(spark) == 1 and storage.release(spark) == 0
        with pytest.raises(Exception):
            df.count()
    finally:
        storage._WRITTEN = held


def test_limit_of_missing_cells_grows_with_the_rows(spark):
    df = spark.range(4320).selectExpr("id", "id % 2 AS c", "if(id % 50 = 0, null, double(id)) AS few", "if(id % 3 = 0, null, double(id)) AS many",
                                      "if(id < 200, null, double(id)) AS most", "if(id < 201, null, double(id)) AS over")
    clean, kept = drop_sparse_and_impute(df, ["few", "many", "most", "over"], "c")
    assert kept == ["few", "most"] and clean.columns == ["id", "c", "few", "most"]
    assert clean.filter("few IS NULL OR most IS NULL").count() == 0
    small = df.limit(1000).selectExpr("id", "c", "if(id < 50, null, double(id)) AS even", "if(id < 51, null, double(id)) AS over")
    assert drop_sparse_and_impute(small, ["even", "over"], "c")[1] == ["even"]


def test_integers_in_text(spark):
    cases = {"12": 12, " -7\t": -7, "+3": 3, "1.5": None, "12z": None, "": None, "z9": None, "(500)": None, "1-2": None, "9223372036854775808": None, "007": 7}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.to_integer(F.col("t"))).collect()} == cases | {None: None}
    assert "RLIKE" in df.select(text.to_integer(F.col("t")))._jdf.queryExecution().executedPlan().toString()  # no exception per failing row


def test_profile_reads_each_column_alone(spark):
    df = spark.createDataFrame([(1, "b", None), (1, None, 2.5), (3, "a", 0.5)], "i int, s string, d double")
    found = schema_profile(df)
    assert [tuple(r) for r in found.orderBy("position").collect()] == [(1, "i", "int", 2, "1"), (2, "s", "string", 2, "a"), (3, "d", "double", 2, "0.5")]
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_not_joined_for_known_keys(spark):
    """Only held-out rows move: the keys of the others are known by themselves."""
    df = spark.range(400).selectExpr("string(id) AS row_id", "id % 7 AS userId", "if(id < 3, 100 + id, id % 5) AS movieId", "double(id % 10) / 2 AS rating")
    train, test = study.train_and_test(df)
    text_of = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text_of(train) and "Exchange" not in text_of(train)
    model, validation = study.model_and_validation(df, p=0.2, seed=2)
    assert train.count() == 320 and model.count() + validation.count() == 400 and rows(validation) == rows(test)
    seen = {r[0] for r in train.select("movieId").collect()}
    assert {r["movieId"] for r in test.collect()} <= seen and model.exceptAll(train).filter(F.col("movieId").isin(*seen)).count() == 0


def test_folds_and_cells_carry_no_more_than_the_tuning_reads(spark):
    df = spark.range(200).selectExpr("string(id) AS row_id", "id % 9 AS movieId", "id % 11 AS userId", "double(id % 10) / 2 AS rating")
    folded = study.with_folds(df, k=3)
    assert folded.columns == ["movieId", "userId", "rating", "fold"]
    assert penalties.tuning_rows(folded, list(effects.EFFECTS[:2]), "fold", "rating").columns == ["movieId", "userId", "fold", "known", "total"]
