"""Registered queries against their SQL on the smallest tables, and the contract of the entry points."""

import pytest

import __spark_entry__ as entry
from registry import ALL
from registry.check import compare, connect

# One query per shape; ``python -m registry.check`` runs all of them.
CHECKED = ["scan_delimited", "split_fixed", "schema_profile", "math_ops", "category_levels", "join_effects_chain", "anti_join_natural",
           "two_level_stats", "column_summary", "anova_oneway", "histogram", "boxplot_stats", "split_stratified_numeric",
           "kfold_stratified", "holdout_known_keys", "rmse_ladder", "tune_penalty_user", "near_zero_variance",
           "impute_group_median", "standardize", "classify_knn", "random_guess", "vote_ensemble", "correlation_bands"]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, small, con, name):
    fn, oracle = ALL[name]
    assert compare(fn(spark, small).toPandas(), con.sql(oracle).df()).startswith("ok")


def test_contract(spark):
    assert set(entry.oracle_sql()) < set(entry.queries())
    assert entry.entry(spark).count() == 5
