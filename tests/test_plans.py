"""Physical plans: pruned scans, no Python on the row path, no unbounded single-task window."""

from pyspark.sql import functions as F

from brindle.operators import aggregates as agg, columns, joins, neighbours, quantiles, split
from brindle.plans import effects, penalties
from brindle.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subset_unpivot_reads_only_its_columns(spark, small):
    df = views.table(spark, small, "lineitem")
    text = plan(columns.unpivot_subset(df, ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], ["l_tax"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text


def test_filter_is_pushed_to_the_scan(spark, small):
    text = plan(columns.filter_in(views.table(spark, small, "part"), "p_brand", ["Brand#11", "Brand#12"]).select("p_partkey"))
    assert "In(p_brand" in text and "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in text


def test_split_of_rows_needs_no_shuffle(spark, small):
    lines = views.table(spark, small, "orders")
    flagged = split.split_stratified_numeric(lines, "o_totalprice", 0.2, ["o_orderkey"], 1)
    text = plan(flagged)
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_scalar_is_a_subquery_not_a_join(spark, small):
    df = views.table(spark, small, "orders")
    text = plan(joins.attach_scalar(df, agg.global_mean(df, "o_totalprice"), "mu"))
    assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_tuning_aggregates_rows_once(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), (F.col("id") % 4 + 1).alias("fold"), F.lit(True).alias("known"),
                                    F.lit(1).cast("bigint").alias("rows"), F.rand(1).alias("total"), F.rand(2).alias("square"))
    means = spark.createDataFrame([(i, 0.5) for i in range(1, 5)], "fold bigint, mu double")
    text = plan(penalties.tune_penalty(rows, "k", means, penalties.GRIDS["ge"]))
    assert text.count("Range (") == 1 and "Python" not in text and "Cartesian" not in text


def test_predictions_stay_in_the_jvm(spark, small):
    rated = views.rated(spark, small)
    fitted = effects.fit_effects(rated, list(effects.EFFECTS), 3.0)
    text = plan(effects.predict_ratings(rated, fitted, 3.0))
    assert "Python" not in text and "BroadcastHashJoin" in text


def test_quantiles_move_only_values_near_them(spark):
    """Of 200,000 distinct values per group, those inside the brackets and one row per gap leave the tasks."""
    rows = spark.range(400_000).select((F.col("id") % 2).alias("g"), F.hash("id").cast("double").alias("v"))
    kept = quantiles.bracketed(rows, ["g"], "v", [0.25, 0.5, 0.75])
    assert kept.count() < 400_000 * 3 * 8 / quantiles.ACCURACY + 8
    text = plan(quantiles.exact_quantiles(rows, ["g"], "v", [0.25, 0.5, 0.75]))
    assert "rangepartitioning" not in text and "Python" not in text and "Cartesian" not in text
    # rows meet the brackets where they are, and are counted before they move
    assert text.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" in text
    steps = [line.strip(" :+-*") for line in text.splitlines()]
    exchanges = [i for i, s in enumerate(steps) if "Exchange hashpartitioning" in s]
    assert all(any("HashAggregate" in s for s in steps[i + 1:i + 4]) for i in exchanges)


def test_votes_of_many_sizes_order_neighbours_once(spark):
    """Neighbours move once for all numbers of neighbours, before they are repeated; the votes are those of each number alone."""
    rows = [(t, p, f"c{(t * p) % 3}", float(1 + (t + p) % 2)) for t in range(6) for p in range(1, 8)]
    near = spark.createDataFrame(rows, "id long, place long, label string, weight double")
    found = neighbours.vote_each(near, ["id"], [5, 1, 3, 30])
    text = plan(found)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")
    got = {(r["k"], r["id"]): r["predicted"] for r in found.collect()}
    assert got == {(k, r["id"]): r["predicted"] for k in (1, 3, 5, 30) for r in neighbours.vote(near, ["id"], k).collect()}


def test_errors_of_dropped_keys_are_hashed_not_sorted(spark):
    """No text is aggregated where no unseen key can be left; the groups at every grid value are then never sorted."""
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), (F.col("id") % 4 + 1).alias("fold"), F.lit(True).alias("known"), F.rand(1).alias("total"))
    means = spark.createDataFrame([(i, 0.5) for i in range(1, 5)], "fold bigint, mu double")
    errors = penalties.tune_penalty(rows, "k", means, penalties.GRIDS["ge"], on_unseen="drop")
    assert "SortAggregate" not in plan(errors) and dict(errors.dtypes)["unseen_key"] == "string"
