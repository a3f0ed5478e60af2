"""The ratings study: prepare, split, tune, fit, compare, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.functions.text import extract_year
from brindle.operators.split import holdout_known_keys, kfold_stratified, split_stratified_numeric
from brindle.plans.effects import EFFECTS, Effect, fit_effects, nested_rmses, predict_ratings
from brindle.plans.penalties import tune_effects
from brindle.operators.aggregates import rmse
from brindle.storage import write_out

KEYS = ["movieId", "userId"]
COLUMNS = ["row_id", "userId", "movieId", "rating", "genres", "year"]
# Fixed names of the nested models and of the effects, in model order.
MODELS = ["Overall Mean Model", "Reg. Movie Effect Model", "Reg. Movie + User Effect Model",
          "Reg. Movie + User + Genre Effect Model", "Reg. Movie + User + Genre + Year Effect Model"]
EFFECT_LABELS = {"me": "Movie Effect", "ue": "User Effect", "ge": "Genre Effect", "ye": "Year Effect"}


def with_year(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("year", extract_year(F.col("title")))


def prepare(ratings: DataFrame) -> DataFrame:
    """Only the columns the models need, written once. The study's only other copy is that of the folds.

    The year is read from the title unless the input has it. On a large table derive it on the items
    before they are joined to the ratings.
    """
    dated = ratings if "year" in ratings.columns else with_year(ratings)
    return write_out(dated.select(*COLUMNS), "ratings", compact=True)


def split_apart(df: DataFrame, p: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows not held out, which no key moves, and the held-out ones."""
    flagged = split_stratified_numeric(df, "rating", p, ["row_id"], seed)
    return flagged.filter(~F.col("held_out")).drop("held_out"), flagged.filter("held_out").drop("held_out")


def train_and_test(df: DataFrame, p: float = 0.2, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Hold out a share of every rating bin; held-out rows with an unseen movie or user are dropped."""
    train, held_out = split_apart(df, p, seed)
    return train, holdout_known_keys(held_out, train, KEYS)[0]


def model_and_validation(df: DataFrame, p: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """As above, but rows with an unseen movie or user return to the modelling set."""
    train, held_out = split_apart(df, p, seed)
    validation, model = holdout_known_keys(held_out, train, KEYS, return_removed=True)
    return model, validation


def mean_rating(df: DataFrame) -> float:
    return df.agg(F.avg("rating")).first()[0]


def fixed_model(ratings: DataFrame, effects: int, seed: int = 2):
    """(test rows, fitted effects, mean) of the model with the first ``effects`` effects."""
    train, test = train_and_test(prepare(ratings), seed=seed)
    mu = mean_rating(train)
    return test, fit_effects(train, list(EFFECTS[:effects]), mu), mu


def rmse_ladder(ratings: DataFrame, seed: int = 2) -> DataFrame:
    test, fitted, mu = fixed_model(ratings, len(EFFECTS), seed)
    return nested_rmses(test, fitted, mu, MODELS)


def folded_training(ratings: DataFrame, seed: int = 2, fold_seed: int = 3, k: int = 10) -> DataFrame:
    train, _ = train_and_test(prepare(ratings), seed=seed)
    return with_folds(train, fold_seed, k)


def with_folds(train: DataFrame, seed: int = 3, k: int = 10) -> DataFrame:
    """Training rows with their fold, without the id that dealt them; written since every tuned effect reads them."""
    return write_out(kfold_stratified(train, "rating", k, ["row_id"], seed).drop("row_id"), "folds", compact=True)


def tuned_effects(ratings: DataFrame, **options) -> list[tuple[Effect, DataFrame]]:
    train = folded_training(ratings)
    return tune_effects(train, list(EFFECTS), mean_rating(train), **options)


def penalty_table(fitted: list[tuple[Effect, DataFrame]]) -> DataFrame:
    """(pos, effect, penalty) of tuned effects."""
    spark = fitted[0][1].sparkSession
    rows = [(i, EFFECT_LABELS[e.name], float(e.penalty)) for i, (e, _) in enumerate(fitted, start=1)]
    return spark.createDataFrame(rows, "pos bigint, effect string, penalty double")


def fit_final_and_validate(ratings: DataFrame, on_unseen: dict[str, str] | None = None) -> dict:
    """Tune on the training rows, refit on the whole modelling set, score the untouched validation rows.

    The item effect is centred on the training mean, the later ones on the modelling-set mean.
    """
    model, validation = model_and_validation(prepare(ratings))
    train, _ = train_and_test(model)
    folded = with_folds(train)
    mu_train, mu_model = mean_rating(train), mean_rating(model)
    tuned = tune_effects(folded, list(EFFECTS), mu_train)
    final = fit_effects(model, [e for e, _ in tuned], mu_model, first_mu=mu_train)
    scored = predict_ratings(validation, final, mu_model, on_unseen or {"me": "zero"})
    return {"penalties": penalty_table(tuned), "predictions": scored, "rmse": rmse(scored, "rating", "predicted")}
