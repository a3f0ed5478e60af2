"""Registered queries over the expression table, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.operators import aggregates as agg, columns, joins, levels, neighbours, normality, split, statistics
from brindle.plans import classifiers as cls, expression_study as study
from brindle.sources import delimited, reports, views
from brindle.sources.views import FACTORS, PROTEINS
from brindle.storage import scratch_path, write_out
from registry import sql
from registry.ratings_queries import _boxes
from registry.sql import KEPT, complete, r6, rounded, with_

QUERIES: dict[str, tuple] = {}

# Hand-picked columns of the small models.
CHOSEN = ["p00", "p03", "p08", "p14", "p20", "p27", "p33", "p40", "p52", "p63"]
P = with_(sql.proteins())
SPLIT = sql.hold_out("complete", "parts", 0.4, "MouseID", 4021, "class")
C = with_(sql.proteins(), complete())
CS = with_(sql.proteins(), complete(), SPLIT)


def query(name: str, oracle: str | None):
    def register(fn):
        QUERIES[name] = (lambda spark, folder: rounded(fn(spark, folder)), oracle)
        return fn
    return register


def clean(spark, folder) -> DataFrame:
    return study.prepared_expression(views.proteins(spark, folder), PROTEINS, "class")[0]


def parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    flagged = split.split_stratified_class(clean(spark, folder), "class", 0.4, ["MouseID"], 4021)
    flagged = write_out(flagged, "parts")
    return flagged.filter("not held_out").drop("held_out"), flagged.filter("held_out").drop("held_out")


def long_sql(source: str, cols: list[str], ids: str = "MouseID, class") -> str:
    return "\nUNION ALL ".join(f"SELECT {ids}, '{c}' AS protein, {c} AS level FROM {source}" for c in cols)


@query("scan_wide", P + "SELECT MouseID, " + ", ".join(f"{r6(c)} AS {c}" for c in PROTEINS) + ", Genotype, Treatment, Behavior, class FROM proteins")
def _(spark, folder):
    path = scratch_path(spark, "wide")
    df = views.proteins(spark, folder)
    df.write.csv(path, header=True)
    return delimited.scan_wide(spark, path, df.schema)


@query("drop_listed", P + f"SELECT MouseID, {', '.join(f'{r6(c)} AS {c}' for c in KEPT[:10])}, class FROM proteins")
def _(spark, folder):
    drop = [c for c in PROTEINS if c not in KEPT[:10]] + ["Genotype", "Treatment", "Behavior"]
    return columns.drop_listed(views.proteins(spark, folder), drop)


@query("column_range", P + f"SELECT MouseID, {', '.join(f'{r6(c)} AS {c}' for c in PROTEINS[10:21])} FROM proteins")
def _(spark, folder):
    df = views.proteins(spark, folder)
    return df.select("MouseID", *columns.column_range(df, "p10", "p20"))


@query("column_slice", P + f"SELECT MouseID, {', '.join(f'{r6(c)} AS {c}' for c in PROTEINS[:24])} FROM proteins")
def _(spark, folder):
    df = views.proteins(spark, folder)
    return df.select("MouseID", *columns.column_slice(df, 2, 25))


@query("select_columns_where", P + "SELECT name FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS n FROM proteins" for c in PROTEINS) + ") WHERE n > 50")
def _(spark, folder):
    df = views.proteins(spark, folder)
    names = columns.select_columns_where(agg.null_counts(df, PROTEINS), lambda n: n > 50)
    return reports.literal_table(spark, [(c,) for c in names], "name string")


@query("choose_features", P + f"SELECT MouseID, {', '.join(f'{r6(c)} AS {c}' for c in CHOSEN)} FROM proteins")
def _(spark, folder):
    return views.proteins(spark, folder).select("MouseID", *columns.choose_features(PROTEINS, CHOSEN[::-1]))


@query("across", P + f"SELECT MouseID, {', '.join(f'{r6(f'coalesce({c}, 0) * 2')} AS {c}' for c in CHOSEN)} FROM proteins")
def _(spark, folder):
    df = views.proteins(spark, folder).select("MouseID", *CHOSEN)
    return columns.across(df, CHOSEN, lambda c: F.coalesce(c, F.lit(0.0)) * 2)


@query("features_to_vector", C + "\nUNION ALL ".join(
    f"SELECT MouseID, {i}::bigint AS position, {r6(c)} AS value FROM complete" for i, c in enumerate(KEPT)))
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array
    vectors = columns.features_to_vector(clean(spark, folder), KEPT)
    return vectors.select("MouseID", F.posexplode(vector_to_array("features")).alias("position", "value"))


@query("unpivot_levels", P + f"SELECT MouseID, class, protein, {r6('level')} AS level FROM ({long_sql('proteins', PROTEINS)})")
def _(spark, folder):
    return columns.unpivot_levels(views.proteins(spark, folder), ["MouseID", "class"], PROTEINS)


@query("unpivot_subset", P + f"SELECT MouseID, class, protein, {r6('level')} AS level FROM ({long_sql('proteins', [PROTEINS[i] for i in views.SPARSE])})")
def _(spark, folder):
    return columns.unpivot_subset(views.proteins(spark, folder), ["MouseID", "class"], PROTEINS,
                                  [PROTEINS[i] for i in views.SPARSE])


@query("scatter_projection", P + "\nUNION ALL ".join(
    f"SELECT class, '{x}/{y}' AS pair, {r6(x)} AS x, {r6(y)} AS y FROM proteins" for x, y in zip(PROTEINS[:3], PROTEINS[1:4])))
def _(spark, folder):
    return columns.scatter_projection(views.proteins(spark, folder), list(zip(PROTEINS[:3], PROTEINS[1:4])), "class")


@query("scatter_components", None)
def _(spark, folder):
    found, train, _ = _components(spark, folder)
    scores = cls.scores_array(found.project(train))
    named = scores.select("class", *[F.col("features")[i].alias(f"PC{i + 1}") for i in range(4)])
    return columns.scatter_projection(named, [("PC1", "PC2"), ("PC2", "PC3"), ("PC3", "PC4")], "class")


@query("count_by", P + "SELECT class, count(*) AS n FROM proteins GROUP BY class")
def _(spark, folder):
    return agg.count_by(views.proteins(spark, folder), "class")


@query("proportions", P + f"SELECT class, count(*) AS n, {r6('count(*) / (SELECT count(class) FROM proteins)')} AS share FROM proteins WHERE class IS NOT NULL GROUP BY class")
def _(spark, folder):
    return agg.proportions(views.proteins(spark, folder), "class")


@query("proportions_lang", f"SELECT lang, count(*) AS n, {r6('count(*) / (SELECT count(lang) FROM documents)')} AS share FROM documents GROUP BY lang")
def _(spark, folder):
    return agg.proportions(views.table(spark, folder, "documents"), "lang")


@query("null_counts", P + f"SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in PROTEINS)} FROM proteins")
def _(spark, folder):
    return agg.null_counts(views.proteins(spark, folder), PROTEINS)


@query("column_moments", P + "\nUNION ALL ".join(
    f"SELECT '{c}' AS name, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS sd, {r6(f'var_samp({c})')} AS variance FROM proteins" for c in PROTEINS))
def _(spark, folder):
    return agg.column_moments(views.proteins(spark, folder), PROTEINS)


@query("moment_range", P + f"""SELECT {r6('min(sd)')} AS min_sd, {r6('max(sd)')} AS max_sd, {r6('min(v)')} AS min_variance, {r6('max(v)')} AS max_variance
FROM (""" + "\nUNION ALL ".join(f"SELECT stddev_samp({c}) AS sd, var_samp({c}) AS v FROM proteins" for c in PROTEINS) + ")")
def _(spark, folder):
    return agg.moment_range(views.proteins(spark, folder), PROTEINS)


_NZV = PROTEINS + ["Genotype", "Treatment", "Behavior", "class", "rare"]


@query("near_zero_variance", with_(sql.proteins(), "w AS (SELECT *, CASE WHEN MouseID % 100 = 0 THEN 1 ELSE 0 END AS rare FROM proteins)",
       "long AS (" + "\nUNION ALL ".join(f"SELECT '{c}' AS name, {c}::double AS value FROM w" for c in _NZV) + ")",
       "counted AS (SELECT name, value, count(*) AS n FROM long GROUP BY name, value)",
       "placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM counted WHERE value IS NOT NULL)")
       + f"""SELECT name, {r6('freq_ratio')} AS freq_ratio, {r6('percent_unique')} AS percent_unique, zero_variance,
zero_variance OR (freq_ratio > 19 AND percent_unique <= 10) AS near_zero FROM (
SELECT name, coalesce(max(n) FILTER (place = 1) / max(n) FILTER (place = 2), 0) AS freq_ratio,
100.0::double * count(*) / (SELECT count(*) FROM w) AS percent_unique, count(*) <= 1 AS zero_variance FROM placed GROUP BY name)""")
def _(spark, folder):
    df = views.proteins(spark, folder).withColumn("rare", F.when(F.col("MouseID") % 100 == 0, 1).otherwise(0))
    return statistics.near_zero_variance(df.select(*[F.col(c).cast("double").alias(c) for c in _NZV]), _NZV)


_PAIRS = [(KEPT[i], KEPT[j]) for i in range(len(KEPT)) for j in range(i + 1, len(KEPT))]
_CORR = "one AS MATERIALIZED (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in _PAIRS) + " FROM complete)"
_CORR_LONG = ("pairs AS MATERIALIZED (SELECT split_part(name, '_', 1) AS col_i, split_part(name, '_', 2) AS col_j, r "
              "FROM (UNPIVOT one ON COLUMNS(*) INTO NAME name VALUE r))")


@query("correlation_pairs", with_(sql.proteins(), complete(), _CORR, _CORR_LONG) + f"SELECT col_i, col_j, {r6('r')} AS r FROM pairs")
def _(spark, folder):
    return statistics.correlation_pairs(clean(spark, folder), KEPT)


@query("correlation_bands", with_(sql.proteins(), complete(), _CORR, _CORR_LONG) + "\nUNION ALL ".join(
    f"SELECT {c}::double AS cutoff, {r6(f'count(*) FILTER (abs(r) > {c}) / {len(KEPT) ** 2}')} AS share FROM pairs" for c in (0.3, 0.1, 0.05)))
def _(spark, folder):
    pairs = statistics.correlation_pairs(clean(spark, folder), KEPT)
    return statistics.correlation_bands(pairs, len(KEPT), (0.3, 0.1, 0.05))


@query("mvn_doornik_hansen", None)
def _(spark, folder):
    return normality.mvn_doornik_hansen(parts(spark, folder)[0], KEPT)


_PAIR = ["p00", "p14"]
# Two standardised columns, rotated by the inverse root of their correlation, which has a closed form.
_ROTATED = """zs AS (SELECT MouseID, (p00 - avg(p00) OVER ()) / stddev_pop(p00) OVER () AS z1, (p14 - avg(p14) OVER ()) / stddev_pop(p14) OVER () AS z2,
       corr(p00, p14) OVER () AS r, count(*) OVER ()::double AS n FROM parts WHERE NOT held_out),
ys AS MATERIALIZED (SELECT MouseID, n, (1 / sqrt(1 + r) + 1 / sqrt(1 - r)) / 2 * z1 + (1 / sqrt(1 + r) - 1 / sqrt(1 - r)) / 2 * z2 AS y1,
       (1 / sqrt(1 + r) - 1 / sqrt(1 - r)) / 2 * z1 + (1 / sqrt(1 + r) + 1 / sqrt(1 - r)) / 2 * z2 AS y2 FROM zs)"""
# Skewness after D'Agostino, kurtosis after Wilson and Hilferty (Doornik and Hansen 2008); the tail of chi-squared with four degrees is closed.
_DOORNIK = """long AS (SELECT 1 AS j, n, y1 AS y FROM ys UNION ALL SELECT 2, n, y2 FROM ys),
ms AS (SELECT j, n, avg(y ** 3) / avg(y ** 2) ** 1.5 AS s, avg(y ** 4) / avg(y ** 2) ** 2 AS k FROM long GROUP BY j, n),
cs AS (SELECT *, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
       (n - 3) * (n + 1) * (n * n + 15 * n - 4) AS d FROM ms),
ws AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, (n - 2) * (n + 5) * (n + 7) * (n * n + 27 * n - 70) / (6 * d)
       + s * s * (n - 7) * (n + 5) * (n + 7) * (n * n + 2 * n - 5) / (6 * d) AS alpha,
       2 * (n + 5) * (n + 7) * (n ** 3 + 37 * n * n + 11 * n - 313) / (12 * d) * (k - 1 - s * s) AS chi FROM cs),
zz AS (SELECT *, asinh(s * sqrt((w2 - 1) * (n + 1) * (n + 3) / (12 * (n - 2)))) / sqrt(ln(sqrt(w2))) AS z1,
       (cbrt(chi / (2 * alpha)) - 1 + 1 / (9 * alpha)) * sqrt(9 * alpha) AS z2 FROM ws),
es AS (SELECT max(n)::bigint AS n, sum(z1 * z1 + z2 * z2) AS e FROM zz)"""


@query("mvn_doornik_hansen_pair", with_(sql.proteins(), complete(), SPLIT, _ROTATED, _DOORNIK)
       + f"SELECT n, 2::bigint AS p, {r6('e')} AS statistic, 4::bigint AS df, {r6('exp(-e / 2) * (1 + e / 2)')} AS p_value FROM es")
def _(spark, folder):
    return normality.mvn_doornik_hansen(parts(spark, folder)[0], _PAIR)


_KERNEL = """bs AS (SELECT *, pow(pow(n * 5 / 4.0, 1.0 / 6), 2) / 2 AS b2 FROM ys),
pairs AS (SELECT sum(exp(-a.b2 / 2 * ((a.y1 - b.y1) ** 2 + (a.y2 - b.y2) ** 2))) AS s FROM bs a, bs b),
ones AS (SELECT max(n) AS n, max(b2) AS b2, sum(exp(-b2 / (2 * (1 + b2)) * (y1 ** 2 + y2 ** 2))) AS t FROM bs)"""


@query("mvn_henze_zirkler_pair", with_(sql.proteins(), complete(), SPLIT, _ROTATED, _KERNEL)
       + f"SELECT n::bigint AS n, 2::bigint AS p, {r6('s / n - 2 / (1 + b2) * t + n / (1 + 2 * b2)')} AS statistic FROM pairs, ones")
def _(spark, folder):
    return normality.mvn_henze_zirkler(parts(spark, folder)[0], _PAIR, "MouseID").drop("p_value")


@query("mvn_henze_zirkler", None)
def _(spark, folder):
    return normality.mvn_henze_zirkler(parts(spark, folder)[0], KEPT, "MouseID")


@query("impute_group_median", C + "SELECT MouseID, class, " + ", ".join(f"{r6(c)} AS {c}" for c in KEPT) + " FROM complete")
def _(spark, folder):
    df = views.proteins(spark, folder).select("MouseID", "class", *KEPT)
    return agg.impute_group_median(df, "class", KEPT)


@query("drop_sparse_and_impute", C + "SELECT MouseID, " + ", ".join(f"{r6(c)} AS {c}" for c in KEPT) + ", Genotype, Treatment, Behavior, class FROM complete")
def _(spark, folder):
    return study.drop_sparse_and_impute(views.proteins(spark, folder), PROTEINS, "class")[0]


@query("category_levels_class", P + "SELECT row_number() OVER (ORDER BY class) AS code, class AS level FROM (SELECT DISTINCT class FROM proteins)")
def _(spark, folder):
    return levels.category_levels(views.proteins(spark, folder), "class")


@query("split_stratified_class", with_(sql.proteins(), sql.hold_out("proteins", "s", 0.4, "MouseID", 4021, "class"))
       + "SELECT MouseID, class, held_out FROM s")
def _(spark, folder):
    return split.split_stratified_class(views.proteins(spark, folder), "class", 0.4, ["MouseID"], 4021).select(
        "MouseID", "class", "held_out")


_GUESS = """guesses AS (SELECT MouseID, class, level AS guess FROM proteins JOIN (
SELECT row_number() OVER (ORDER BY class) - 1 AS code, class AS level FROM (SELECT DISTINCT class FROM proteins)) l
ON l.code = ('0x' || substr(md5(concat_ws('#', MouseID, '7')), 1, 8))::bigint % (SELECT count(DISTINCT class) FROM proteins))"""


def guesses(spark, folder) -> DataFrame:
    df = views.proteins(spark, folder)
    return split.random_guess(df, levels.category_levels(df, "class"), ["MouseID"], 7)


@query("random_guess", with_(sql.proteins(), _GUESS) + "SELECT MouseID, class, guess FROM guesses")
def _(spark, folder):
    return guesses(spark, folder).select("MouseID", "class", "guess")


@query("baseline_guess_accuracy", with_(sql.proteins(), _GUESS) + f"SELECT {r6('avg((guess = class)::int)')} AS accuracy FROM guesses")
def _(spark, folder):
    return agg.accuracy(guesses(spark, folder), "class", "guess")


@query("accuracy", P + f"SELECT {r6('avg((Genotype = Treatment)::int)')} AS accuracy FROM proteins")
def _(spark, folder):
    return agg.accuracy(views.proteins(spark, folder), "Genotype", "Treatment")


_WEIGHT = " + ".join(f"(u >= {c!r})::int" for c in split.poisson_cuts())


def _drawn_sql(source: str, key: str, resamples: int, seed: int) -> str:
    """CTE ``drawn``: every row once per resample with its weight."""
    digest = f"md5(concat_ws('#', {sql.hashed(key, seed)}, b))"
    return f"""drawn AS MATERIALIZED (SELECT *, ({_WEIGHT})::double AS weight FROM (
SELECT s.*, b::bigint AS resample, ('0x' || substr({digest}, 1, 8))::bigint / 4294967296.0::double AS u
FROM {source} s, (SELECT unnest(range(1, {resamples + 1})) AS b)))"""


@query("bootstrap_weights", with_(sql.proteins(), _drawn_sql("proteins", "MouseID", 25, 4021))
       + "SELECT MouseID, class, resample, weight FROM drawn")
def _(spark, folder):
    return split.bootstrap_weights(views.proteins(spark, folder).select("MouseID", "class"), 25, ["MouseID"], 4021)


@query("class_separation_profile", with_(sql.proteins(), complete(),
       "long AS (" + "\nUNION ALL ".join(f"SELECT Genotype, Treatment, Behavior, class, '{c}' AS protein, {c} AS value FROM complete" for c in KEPT) + ")",
       "each_factor AS (" + "\nUNION ALL ".join(f"SELECT '{f}' AS factor, {f}::varchar AS level, protein, value FROM long" for f in FACTORS) + ")")
       + _boxes("each_factor", ["factor", "level", "protein"], "value"))
def _(spark, folder):
    return study.class_separation_profile(clean(spark, folder), KEPT, FACTORS)


@query("standardize", CS + "SELECT MouseID, " + ", ".join(
    r6(f"({c} - (SELECT avg({c}) FROM parts WHERE NOT held_out)) / (SELECT stddev_samp({c}) FROM parts WHERE NOT held_out)") + f" AS {c}"
    for c in KEPT) + " FROM parts WHERE held_out")
def _(spark, folder):
    train, test = parts(spark, folder)
    return study.standardize(train, test, KEPT).select("MouseID", *KEPT)


# ---------------------------------------------------------------- classifiers

def _knn_sql(cols: list[str], k: int) -> str:
    """CTE ``voted`` (MouseID, class, predicted)."""
    gap = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in cols)
    return f"""near AS MATERIALIZED (SELECT a.MouseID, a.class AS truth, b.class AS label, row_number() OVER (
PARTITION BY a.MouseID ORDER BY {gap}, b.MouseID) AS place FROM parts a JOIN parts b ON a.held_out AND NOT b.held_out),
votes AS (SELECT MouseID, truth, label, count(*) AS n FROM near WHERE place <= {k} GROUP BY ALL),
voted AS (SELECT MouseID, truth AS class, label AS predicted FROM (SELECT *, row_number() OVER (
PARTITION BY MouseID ORDER BY n DESC, label) AS rn FROM votes) WHERE rn = 1)"""


def _knn(spark, folder, cols: list[str], k: int) -> DataFrame:
    train, test = (columns.features_to_array(d, cols) for d in parts(spark, folder))
    predicted = neighbours.classify_knn(train, test, "MouseID", "class", k)
    return test.select("MouseID", "class").join(predicted, "MouseID")


@query("classify_knn", with_(sql.proteins(), complete(), SPLIT, _knn_sql(KEPT, 5)) + "SELECT MouseID, class, predicted FROM voted")
def _(spark, folder):
    return _knn(spark, folder, KEPT, 5)


@query("classify_knn_chosen", with_(sql.proteins(), complete(), SPLIT, _knn_sql(CHOSEN, 2)) + "SELECT MouseID, class, predicted FROM voted")
def _(spark, folder):
    return _knn(spark, folder, CHOSEN, 2)


@query("classify_knn_accuracy", with_(sql.proteins(), complete(), SPLIT, _knn_sql(KEPT, 3)) + f"SELECT {r6('avg((class = predicted)::int)')} AS accuracy FROM voted")
def _(spark, folder):
    return agg.accuracy(_knn(spark, folder, KEPT, 3), "class", "predicted")


# The grids of the study.
EFFORT = study.Effort()
KS, MTRY = EFFORT.neighbours, EFFORT.tried
SIZES = list(range(2, len(KEPT) + 1))


def _arrays(spark, folder, cols: list[str]) -> list[DataFrame]:
    return [columns.features_to_array(d, cols) for d in parts(spark, folder)]


def _tuned_knn(train: DataFrame, test: DataFrame, cols: list[str]) -> cls.Tuned:
    a, b = (columns.features_to_array(d, cols) if cols else cls.scores_array(d) for d in (train, test))
    return cls.tune_refit_score_knn(a, b, "MouseID", "class", KS)


@query("classify_tree", None)
def _(spark, folder):
    return cls.tune_refit_score_tree(*_arrays(spark, folder, KEPT), "MouseID", "class", EFFORT.complexities).predictions


@query("classify_tree_chosen", None)
def _(spark, folder):
    return cls.tune_refit_score_tree(*_arrays(spark, folder, CHOSEN), "MouseID", "class", EFFORT.complexities).predictions


@query("classify_forest", None)
def _(spark, folder):
    return cls.tune_refit_score_forest(*_arrays(spark, folder, KEPT), "MouseID", "class", MTRY, EFFORT.trees).predictions


def _importance(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Of the forest on all columns at the number of tried columns that its tuning finds best."""
    train, _ = parts(spark, folder)
    best = cls.best_value(cls.tune_forest(columns.features_to_array(train, KEPT), "MouseID", "class", MTRY, EFFORT.trees))
    return cls.forest_importance(train, "MouseID", "class", KEPT, int(best), EFFORT.trees)


@query("feature_importance", None)
def _(spark, folder):
    return _importance(spark, folder)[1]


@query("permutation_importance", None)
def _(spark, folder):
    return _importance(spark, folder)[0]


@query("top_k_features", None)
def _(spark, folder):
    return agg.top_k_features(_importance(spark, folder)[1], "importance", "feature", 20)


@query("feature_overlap", None)
def _(spark, folder):
    top = agg.top_k_features(_importance(spark, folder)[1], "importance", "feature", 20).select("feature")
    return joins.feature_overlap(top, reports.literal_table(spark, [(c,) for c in CHOSEN], "feature string"))


@query("tune_classifier_tree", None)
def _(spark, folder):
    train, _ = _arrays(spark, folder, KEPT)
    return cls.tune_tree(train, "MouseID", "class", EFFORT.complexities).drop("size")


def _tune_knn_sql(cols: list[str], ks: list[int], resamples: int) -> str:
    gap = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in cols)
    grid_k = ", ".join(f"({k})" for k in ks)
    return with_(sql.proteins(), complete(), SPLIT, "train AS (SELECT * FROM parts WHERE NOT held_out)",
                 _drawn_sql("train", "MouseID", resamples, 4021), f"grid_k(k) AS (VALUES {grid_k})", f"""ends AS MATERIALIZED (
SELECT *, sum(weight) OVER (PARTITION BY resample, MouseID ORDER BY gap, near) AS fin FROM (
SELECT a.resample, a.MouseID, a.class AS truth, b.class AS label, b.MouseID AS near, b.weight, {gap} AS gap
FROM drawn a JOIN drawn b ON a.resample = b.resample AND a.weight = 0 AND b.weight > 0)),
ballots AS (SELECT resample, k, MouseID, truth, label, sum(least(weight, k - (fin - weight))) AS n
FROM ends, grid_k WHERE fin - weight < k GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY resample, k, MouseID ORDER BY n DESC, label) AS rn FROM ballots),
per AS (SELECT resample, k, avg((truth = label)::int) AS a FROM chosen WHERE rn = 1 GROUP BY resample, k)""") + (
        f"SELECT {len(cols)}::bigint AS size, k::bigint AS k, {r6('avg(a)')} AS accuracy FROM per GROUP BY k")


@query("tune_classifier_knn", _tune_knn_sql(KEPT, list(range(2, 21)), 25))
def _(spark, folder):
    train, _ = parts(spark, folder)
    return cls.tune_knn(columns.features_to_array(train, KEPT), "MouseID", "class", list(range(2, 21)), resamples=25)


@query("tune_classifier_forest", None)
def _(spark, folder):
    train, _ = _arrays(spark, folder, KEPT)
    return cls.tune_forest(train, "MouseID", "class", MTRY, EFFORT.trees).drop("size")


def _components(spark, folder):
    train, test = parts(spark, folder)
    scaled = [write_out(study.standardize(train, d, KEPT), "scaled") for d in (train, test)]
    return cls.Components(scaled[0], KEPT), *scaled


@query("pca_fit", None)
def _(spark, folder):
    found, train, _ = _components(spark, folder)
    return found.loadings(train)


@query("pca_project", None)
def _(spark, folder):
    found, _, test = _components(spark, folder)
    scores = cls.scores_array(found.project(test))
    return scores.select("MouseID", F.posexplode("features").alias("component", "score"))


@query("pca_explained", None)
def _(spark, folder):
    found, train, _ = _components(spark, folder)
    return found.explained(train)


_CORR_TRAIN = "one AS MATERIALIZED (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in _PAIRS) + " FROM parts WHERE NOT held_out)"


@query("pca_rebuilt", with_(sql.proteins(), complete(), SPLIT, _CORR_TRAIN, _CORR_LONG) + f"SELECT col_i, col_j, {r6('r')} AS r FROM pairs")
def _(spark, folder):
    """The correlations, put together again from loadings and variances."""
    found, train, _ = _components(spark, folder)
    loadings, shares = found.loadings(train), found.explained(train).select("component", "variance_share")
    weighted = loadings.join(shares, "component").withColumn("w", F.col("loading") * F.col("variance_share") * len(KEPT))
    a, b = weighted.alias("a"), loadings.alias("b")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.feature") < F.col("b.feature")))
    return pairs.groupBy(F.col("a.feature").alias("col_i"), F.col("b.feature").alias("col_j")).agg(
        F.sum(F.col("a.w") * F.col("b.loading")).alias("r"))


_Z2 = " + ".join(f"power(({c} - (SELECT avg({c}) FROM parts WHERE NOT held_out)) / (SELECT stddev_samp({c}) FROM parts WHERE NOT held_out), 2)" for c in KEPT)


@query("pca_lengths", with_(sql.proteins(), complete(), SPLIT) + f"SELECT MouseID, {r6(_Z2)} AS squared FROM parts WHERE held_out")
def _(spark, folder):
    """Squared length of each projected row over all components: that of its z-scores."""
    found, _, test = _components(spark, folder)
    scores = cls.scores_array(found.project(test))
    squares = F.aggregate(F.transform("features", lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    return scores.select("MouseID", squares.alias("squared"))


_VARIANCES = "v AS (" + "\nUNION ALL ".join(f"SELECT '{c}' AS name, var_samp({c}) AS variance FROM proteins" for c in PROTEINS) + ")"


@query("top_k_variances", with_(sql.proteins(), _VARIANCES) + f"SELECT name, {r6('variance')} AS variance FROM v ORDER BY variance DESC, name LIMIT 20")
def _(spark, folder):
    moments = agg.column_moments(views.proteins(spark, folder), PROTEINS).select("name", "variance")
    return agg.top_k_features(moments, "variance", "name", 20)


@query("overlap_variances", with_(sql.proteins(), _VARIANCES)
       + f"SELECT count(*) AS shared FROM (SELECT name FROM v ORDER BY variance DESC, name LIMIT 20) WHERE name IN {tuple(CHOSEN)}")
def _(spark, folder):
    moments = agg.column_moments(views.proteins(spark, folder), PROTEINS).select("name", "variance")
    top = agg.top_k_features(moments, "variance", "name", 20).select(F.col("name").alias("feature"))
    return joins.feature_overlap(top, reports.literal_table(spark, [(c,) for c in CHOSEN], "feature string"))


@query("training_moments", CS + "\nUNION ALL ".join(
    f"SELECT '{c}' AS name, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS sd, {r6(f'var_samp({c})')} AS variance FROM parts WHERE NOT held_out" for c in KEPT))
def _(spark, folder):
    return agg.column_moments(parts(spark, folder)[0], KEPT)


@query("training_correlations", with_(sql.proteins(), complete(), SPLIT, _CORR_TRAIN, _CORR_LONG) + f"SELECT col_i, col_j, {r6('r')} AS r FROM pairs")
def _(spark, folder):
    return statistics.correlation_pairs(parts(spark, folder)[0], KEPT)


@query("cumulative_share", with_(sql.proteins(), "v AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS name, var_samp({c}) AS variance FROM proteins" for c in PROTEINS) + ")")
    + f"SELECT name, {r6('variance')} AS variance, {r6('variance / sum(variance) OVER ()')} AS share, "
      f"{r6('sum(variance) OVER (ORDER BY name) / sum(variance) OVER ()')} AS cumulative FROM v")
def _(spark, folder):
    moments = agg.column_moments(views.proteins(spark, folder), PROTEINS).select("name", "variance")
    return agg.cumulative_share(moments, "name", "variance")


@query("tune_components_knn", None)
def _(spark, folder):
    found, train, _ = _components(spark, folder)
    scores = cls.scores_array(found.project(train))
    return cls.tune_knn(scores, "MouseID", "class", KS, resamples=25, sizes=SIZES)


def _scores(spark, folder) -> DataFrame:
    found, train, _ = _components(spark, folder)
    return write_out(cls.scores_array(found.project(train)).select("MouseID", "class", "features"), "scores")


@query("tune_components_tree", None)
def _(spark, folder):
    return cls.tune_components(cls.tune_tree(_scores(spark, folder), "MouseID", "class", EFFORT.complexities, sizes=SIZES))


@query("tune_components_forest", None)
def _(spark, folder):
    return cls.tune_components(cls.tune_forest(_scores(spark, folder), "MouseID", "class", MTRY, EFFORT.size_trees, sizes=SIZES))


_KS = (2, 3, 5)


@query("arg_max", with_(sql.proteins(), complete(), SPLIT, _knn_sql(KEPT, 1).split("votes AS")[0].rstrip().rstrip(","),
       "grid_k(pos, k) AS (VALUES (1, 2), (2, 3), (3, 5))",
       "ballots AS (SELECT pos, MouseID, truth, label, count(*) AS n FROM near, grid_k WHERE place <= k GROUP BY ALL)",
       "chosen AS (SELECT *, row_number() OVER (PARTITION BY pos, MouseID ORDER BY n DESC, label) AS rn FROM ballots)",
       "acc AS (SELECT pos, avg((truth = label)::int) AS a FROM chosen WHERE rn = 1 GROUP BY pos)")
       + f"SELECT cast(pos AS bigint) AS best_pos, {r6('a')} AS best_metric FROM acc ORDER BY a DESC, pos LIMIT 1")
def _(spark, folder):
    train, test = (columns.features_to_array(d, KEPT) for d in parts(spark, folder))
    near = write_out(neighbours.nearest_neighbours(train, test, "MouseID", "class", max(_KS)), "near")
    truth = test.select("MouseID", "class")
    metrics = [(str(k), agg.accuracy(neighbours.vote(near, ["MouseID"], k).join(truth, "MouseID"), "class", "predicted"))
               for k in _KS]
    return agg.arg_max(reports.stack_metrics(metrics, "accuracy"), "accuracy", "pos")


# Three fixed predictions per row, so that the vote itself can be checked against SQL.
_FIXED_VOTES = "SELECT MouseID, class, class AS a, (class + MouseID % 3) % 10 AS b, (class + MouseID % 2) % 10 AS c FROM proteins"


@query("vote_ensemble", P + f"SELECT MouseID, class, CASE WHEN a = b OR a = c THEN a ELSE b END AS ensemble FROM ({_FIXED_VOTES})")
def _(spark, folder):
    fixed = views.proteins(spark, folder).select(
        "MouseID", "class", F.col("class").alias("a"), ((F.col("class") + F.col("MouseID") % 3) % 10).alias("b"),
        ((F.col("class") + F.col("MouseID") % 2) % 10).alias("c"))
    return cls.vote_ensemble(fixed, "a", "b", "c").select("MouseID", "class", "ensemble")


def _models(spark, folder, names: list[str]) -> dict[str, DataFrame]:
    inputs = study.model_inputs(clean(spark, folder), KEPT, "MouseID", "class", 0.4, 4021)
    return {name: study.model_predictions(inputs, name, KEPT, CHOSEN, "MouseID", "class", EFFORT) for name in names}


@query("accuracy_ladder", None)
def _(spark, folder):
    return study.accuracy_ladder(_models(spark, folder, study.LADDER), "class")


@query("ensemble_accuracy", None)
def _(spark, folder):
    return agg.accuracy(study.ensemble(_models(spark, folder, study.VOTERS), "MouseID", "class"), "class", "ensemble")


# Tuning included: the accuracies at the best number of neighbours, against SQL for the whole chain.
_BEST_K = "(SELECT k FROM tuned ORDER BY accuracy DESC, k LIMIT 1)"


def _tuned_knn_sql() -> str:
    return (_tune_knn_sql(CHOSEN, KS, 25).replace(" SELECT resample, k, avg((truth", " SELECT resample, k, avg((truth")
            .rsplit("SELECT", 1)[0].rstrip() + ",\ntuned AS (SELECT k, avg(a) AS accuracy FROM per GROUP BY k),\n"
            + _knn_sql(CHOSEN, 0).replace("near AS", "test_near AS").replace("FROM near", "FROM test_near").replace("place <= 0", f"place <= {_BEST_K}")
            + f"\nSELECT {_BEST_K}::bigint AS best, {r6('avg((class = predicted)::int)')} AS accuracy FROM voted")


@query("tune_refit_score_knn", _tuned_knn_sql())
def _(spark, folder):
    train, test = parts(spark, folder)
    done = _tuned_knn(train, test, CHOSEN)
    right = done.predictions.withColumn("class", F.col("class").cast("string"))
    return agg.accuracy(right, "class", "predicted").select(F.lit(int(done.best)).cast("bigint").alias("best"), "accuracy")


@query("sort_desc", P + f"""SELECT class, {r6('avg(p00)')} AS avg_level, row_number() OVER (ORDER BY avg(p00) DESC, class) AS place
FROM proteins GROUP BY class""")
def _(spark, folder):
    from pyspark.sql import Window as W
    means = views.proteins(spark, folder).groupBy("class").agg(F.avg("p00").alias("avg_level"))
    ordered = agg.sort_desc(means, "avg_level", "class")
    return ordered.withColumn("place", F.row_number().over(W.orderBy(F.col("avg_level").desc(), "class")))
