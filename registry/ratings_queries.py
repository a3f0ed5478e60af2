"""Registered queries over the ratings table, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from brindle.functions import missing, numbers, text
from brindle.operators import aggregates as agg, columns, joins, levels, split, statistics
from brindle.operators.quantiles import exact_quantiles
from brindle.plans import effects, penalties, ratings_study as study
from brindle.sources import delimited, reports, views
from brindle.storage import scratch_path, write_out
from registry import sql
from registry.sql import ORDER, RATED, RATINGS, r6, rounded, with_

QUERIES: dict[str, tuple] = {}

MAJOR = ["ECONOMY|Brand#12", "ECONOMY|Brand#25", "LARGE|Brand#13", "MEDIUM|Brand#11", "MEDIUM|Brand#19"]
FIXED = {"me": "2.0", "ue": "5.0", "ge": "4.0", "ye": "4.0"}


def query(name: str, oracle: str | None):
    def register(fn):
        QUERIES[name] = (lambda spark, folder: rounded(fn(spark, folder)), oracle)
        return fn
    return register


rated = views.rated


# ---------------------------------------------------------------- sources and sinks

@query("scan_delimited", with_(RATINGS) + "SELECT row_id, userId, movieId, rating FROM ratings")
def _(spark, folder):
    df, path = views.ratings(spark, folder), scratch_path(spark, "delimited")
    cols = ["row_id", "userId", "movieId", "rating"]
    df.select(F.concat_ws("::", *[F.col(c).cast("string") for c in cols])).write.text(path)
    schema = (StructType().add("row_id", StringType()).add("userId", LongType())
              .add("movieId", LongType()).add("rating", DoubleType()))
    return delimited.scan_delimited(spark, path, schema)


@query("split_fixed", r"""SELECT coalesce(s[1], '') AS a, coalesce(s[2], '') AS b,
array_to_string(s[3:], '::') AS c FROM (SELECT string_split(CASE WHEN p_partkey % 10 = 0
THEN concat(p_partkey, '::', p_name) ELSE concat_ws('::', p_partkey, p_name, p_type, p_brand) END, '::') AS s FROM part)""")
def _(spark, folder):
    part, path = views.table(spark, folder, "part"), scratch_path(spark, "lines")
    key = F.col("p_partkey").cast("string")
    part.select(F.when(F.col("p_partkey") % 10 == 0, F.concat_ws("::", key, "p_name"))
                .otherwise(F.concat_ws("::", key, "p_name", "p_type", "p_brand"))).write.text(path)
    return delimited.scan_lines(spark, path, ["a", "b", "c"])


@query("literal_table", with_(RATINGS) + f"""SELECT 1::bigint AS pos, 'mean' AS metric, {r6('avg(rating)')} AS value FROM ratings
UNION ALL SELECT 2, 'sd', {r6('stddev_samp(rating)')} FROM ratings
UNION ALL SELECT 3, 'rows', {r6('count(*)::double')} FROM ratings""")
def _(spark, folder):
    df = views.ratings(spark, folder)
    return reports.stack_metrics([("mean", df.agg(F.avg("rating"))), ("sd", df.agg(F.stddev_samp("rating"))),
                                  ("rows", df.agg(F.count(F.lit(1))))], "value", "metric")


@query("report_table", with_(RATINGS) + f"""SELECT genres, {r6('avg(rating)')} AS avg, count(*) AS n
FROM ratings GROUP BY genres""")
def _(spark, folder):
    path = scratch_path(spark, "report")
    reports.report_table(agg.group_mean(views.ratings(spark, folder), "genres", "rating"), path, "csv")
    schema = StructType().add("genres", StringType()).add("avg", DoubleType()).add("n", LongType())
    return delimited.scan_wide(spark, path, schema)


@query("peek", with_(RATINGS) + """SELECT row_id, userId, movieId, rating, title, genres
FROM ratings ORDER BY row_id LIMIT 6""")
def _(spark, folder):
    return reports.peek(views.ratings(spark, folder), "row_id", 6)


@query("schema_profile", with_(RATINGS) + "\nUNION ALL ".join(
    f"SELECT {i}::bigint AS position, '{c}' AS name, '{t}' AS type, count(DISTINCT {c}) AS \"distinct\", "
    f"cast(min({c}) AS varchar) AS example FROM ratings"
    for i, (c, t) in enumerate([("row_id", "string"), ("userId", "bigint"), ("movieId", "bigint"),
                                ("rating", "double"), ("title", "string"), ("genres", "string")], start=1)))
def _(spark, folder):
    return reports.schema_profile(views.ratings(spark, folder))


# ---------------------------------------------------------------- projections and scalars

@query("project", with_(RATINGS) + "SELECT row_id, movieId, rating FROM ratings")
def _(spark, folder):
    return columns.project(views.ratings(spark, folder), ["row_id", "movieId", "rating"])


@query("derive", with_(RATINGS) + f"""SELECT row_id, {r6('rating - 3')} AS residual,
{r6('power(rating - 3, 2)')} AS squared FROM ratings""")
def _(spark, folder):
    return columns.derive(views.ratings(spark, folder), residual=F.col("rating") - 3,
                          squared=F.col("residual") * F.col("residual")).select("row_id", "residual", "squared")


@query("rename", with_(RATINGS) + "SELECT row_id, userId AS viewer, movieId AS item, rating FROM ratings")
def _(spark, folder):
    return columns.rename(views.ratings(spark, folder), {"userId": "viewer", "movieId": "item"}).select(
        "row_id", "viewer", "item", "rating")


@query("filter_in", with_(RATINGS) + f"SELECT row_id, genres, rating FROM ratings WHERE genres IN {tuple(MAJOR)}")
def _(spark, folder):
    return columns.filter_in(views.ratings(spark, folder), "genres", MAJOR).select("row_id", "genres", "rating")


@query("conditional", with_(RATED) + """SELECT row_id, CASE WHEN rating >= 4 THEN 'high' WHEN rating >= 2 THEN 'middle'
ELSE 'low' END AS band, cast(coalesce(year, 0) AS bigint) AS year_or_0 FROM rated""")
def _(spark, folder):
    band = F.when(F.col("rating") >= 4, "high").when(F.col("rating") >= 2, "middle").otherwise("low")
    return rated(spark, folder).select("row_id", band.alias("band"), F.coalesce("year", F.lit(0)).alias("year_or_0"))


@query("split_rows", with_(RATINGS) + """SELECT 'chosen' AS part, count(*) AS n, sum(rating) AS total FROM ratings
WHERE movieId % 5 = 0 UNION ALL SELECT 'others', count(*), sum(rating) FROM ratings WHERE movieId % 5 <> 0""")
def _(spark, folder):
    parts = columns.split_rows(views.ratings(spark, folder), F.col("movieId") % 5 == 0)
    one = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))
           for n, p in zip(("chosen", "others"), parts)]
    return joins.append_rows(*one).select("part", "n", "total")


@query("str_replace_all", with_(RATINGS) + """SELECT row_id, replace(concat_ws('::', userId, movieId, rating), '::', chr(9)) AS line
FROM ratings""")
def _(spark, folder):
    line = F.concat_ws("::", *[F.col(c).cast("string") for c in ("userId", "movieId", "rating")])
    return views.ratings(spark, folder).select("row_id", text.replace_all(line, "::", "\t").alias("line"))


@query("extract_year", with_(RATED) + "SELECT row_id, title, cast(year AS bigint) AS year FROM rated")
def _(spark, folder):
    return study.with_year(views.ratings(spark, folder)).select("row_id", "title", "year")


@query("str_remove_first", with_(RATINGS) + r"""SELECT row_id, regexp_replace(title, '\(', '') AS no_open,
regexp_replace(title, '[aeiou]', '') AS no_vowel FROM ratings""")
def _(spark, folder):
    return views.ratings(spark, folder).select("row_id", text.remove_first(F.col("title"), r"\(").alias("no_open"),
                                               text.remove_first(F.col("title"), "[aeiou]").alias("no_vowel"))


@query("to_number", with_(RATINGS) + """SELECT row_id, try_cast(split_part(title, ' ', 1) AS bigint) AS bad,
try_cast(translate(substr(row_id, 1, 4), 'abcdef', 'zzzzzz') AS bigint) AS digits, try_cast(cast(rating AS varchar) AS double) AS back,
cast(movieId AS varchar) AS item FROM ratings""")
def _(spark, folder):
    return views.ratings(spark, folder).select(
        "row_id", text.to_integer(F.split_part("title", F.lit(" "), F.lit(1))).alias("bad"),
        text.to_integer(F.translate(F.substring("row_id", 1, 4), "abcdef", "zzzzzz")).alias("digits"),
        text.to_number(text.to_text(F.col("rating"))).alias("back"), text.to_text(F.col("movieId")).alias("item"))


@query("fill_missing", with_(RATED) + """SELECT row_id, year IS NULL AS missing, cast(coalesce(year, -1) AS bigint) AS filled FROM rated""")
def _(spark, folder):
    y = F.col("year")
    return rated(spark, folder).select("row_id", missing.is_missing(y, False).alias("missing"),
                                       missing.fill_missing(y, -1, False).alias("filled"))


@query("math_ops", with_(RATINGS) + f"""SELECT row_id, {r6('rating + 1')} AS plus, {r6('rating * rating')} AS squared,
{r6('sqrt(rating)')} AS root, {r6('CASE WHEN rating = 3 THEN NULL ELSE 1 / (rating - 3) END')} AS reciprocal,
(rating > 4 OR rating < 1) AND movieId > 10 AS extreme FROM ratings""")
def _(spark, folder):
    r = F.col("rating")
    return views.ratings(spark, folder).select(
        "row_id", (r + 1).alias("plus"), F.pow(r, F.lit(2.0)).alias("squared"), F.sqrt(r).alias("root"),
        numbers.ratio(F.lit(1.0), r - 3).alias("reciprocal"),
        (((r > 4) | (r < 1)) & (F.col("movieId") > 10)).alias("extreme"))


@query("numeric_grid", with_(RATINGS) + f"""SELECT genres, {r6('lo + i * 0.5')} AS point FROM (
SELECT genres, min(rating) AS lo, max(rating) AS hi FROM ratings GROUP BY genres),
LATERAL (SELECT unnest(range(0, cast((hi - lo) / 0.5 AS int) + 1)) AS i)""")
def _(spark, folder):
    ends = views.ratings(spark, folder).groupBy("genres").agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    return ends.select("genres", F.explode(numbers.numeric_grid(F.col("lo"), F.col("hi"), 0.5)).alias("point"))


@query("category_levels", with_(RATINGS) + """SELECT row_number() OVER (ORDER BY genres) AS code, genres AS level
FROM (SELECT DISTINCT genres FROM ratings)""")
def _(spark, folder):
    return levels.category_levels(views.ratings(spark, folder), "genres")


@query("category_code", with_(RATED) + "SELECT row_id, cast(CASE WHEN year IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY year NULLS LAST) END AS bigint) AS code FROM rated")
def _(spark, folder):
    return levels.category_code(rated(spark, folder), "year").select("row_id", "code")


# ---------------------------------------------------------------- joins and sets

FACTS = "facts AS (SELECT row_id, userId, movieId, rating FROM ratings)"
MOVIES = "movies AS (SELECT DISTINCT movieId, title, genres FROM ratings)"


@query("join_fact_dim", with_(RATINGS, MOVIES) + """SELECT r.row_id, r.userId, r.movieId, r.rating, m.title, m.genres
FROM ratings r LEFT JOIN movies m ON r.movieId = m.movieId""")
def _(spark, folder):
    facts = views.ratings(spark, folder).select("row_id", "userId", "movieId", "rating")
    return joins.join_fact_dim(facts, views.items(spark, folder), "movieId")


GROUP_MEANS = """m AS (SELECT movieId, avg(rating) AS m FROM ratings GROUP BY movieId),
u AS (SELECT userId, avg(rating) AS u FROM ratings GROUP BY userId),
y AS (SELECT year, avg(rating) AS y FROM rated GROUP BY year)"""


@query("join_effects_chain", with_(RATED, GROUP_MEANS) + f"""SELECT row_id, {r6('m')} AS m, {r6('u')} AS u, {r6('y')} AS y
FROM rated r LEFT JOIN m ON r.movieId = m.movieId LEFT JOIN u ON r.userId = u.userId
LEFT JOIN y ON r.year IS NOT DISTINCT FROM y.year""")
def _(spark, folder):
    df = rated(spark, folder)
    mean = lambda key, name: df.groupBy(key).agg(F.avg("rating").alias(name))
    return joins.join_effects_chain(df, [(mean("movieId", "m"), "movieId", False), (mean("userId", "u"), "userId", False),
                                         (mean("year", "y"), "year", True)]).select("row_id", "m", "u", "y")


@query("semi_join_keys", with_(RATINGS) + """SELECT row_id FROM ratings WHERE rating >= 4
AND movieId IN (SELECT movieId FROM ratings WHERE rating < 1) AND userId IN (SELECT userId FROM ratings WHERE rating < 1)""")
def _(spark, folder):
    df = views.ratings(spark, folder)
    return joins.semi_join_keys(df.filter("rating >= 4"), df.filter("rating < 1"), ["movieId", "userId"]).select("row_id")


@query("anti_join_natural", with_(RATED) + """SELECT userId, cast(year AS bigint) AS year FROM rated r WHERE rating >= 3 AND NOT EXISTS (
SELECT 1 FROM rated o WHERE o.rating < 2 AND o.userId = r.userId AND o.year IS NOT DISTINCT FROM r.year)""")
def _(spark, folder):
    df = rated(spark, folder)
    a, b = df.filter("rating >= 3").select("userId", "year"), df.filter("rating < 2").select("userId", "year")
    return joins.anti_join_natural(a, b)


@query("join_null_safe", with_(RATED) + f"""SELECT row_id, cast(r.year AS bigint) AS year, {r6('avg')} AS avg FROM rated r LEFT JOIN
(SELECT year, avg(rating) AS avg FROM rated GROUP BY year) y ON r.year IS NOT DISTINCT FROM y.year""")
def _(spark, folder):
    df = rated(spark, folder)
    means = df.groupBy("year").agg(F.avg("rating").alias("avg"))
    return joins.join_null_safe(df.select("row_id", "year"), means, "year").select("row_id", "year", "avg")


@query("join_derived_attr", with_(RATED) + "SELECT row_id, movieId, cast(year AS bigint) AS year FROM rated")
def _(spark, folder):
    df = views.ratings(spark, folder)
    return joins.join_derived_attr(df, "movieId", "year", text.extract_year(F.col("title"))).select(
        "row_id", "movieId", "year")


@query("attach_scalar", with_(RATINGS) + f"SELECT row_id, {r6('rating - (SELECT avg(rating) FROM ratings)')} AS residual FROM ratings")
def _(spark, folder):
    df = views.ratings(spark, folder)
    return joins.attach_scalar(df, agg.global_mean(df, "rating"), "mu").select(
        "row_id", (F.col("rating") - F.col("mu")).alias("residual"))


@query("grid_cross", with_(RATINGS, sql.grid("g", penalties.GRIDS["me"])) + f"""SELECT movieId, cast(pos AS bigint) AS pos, {r6('lam')} AS lam,
{r6('s / (n + lam)')} AS effect FROM (SELECT movieId, sum(rating - 3) AS s, count(*) AS n FROM ratings GROUP BY movieId), g""")
def _(spark, folder):
    sums = views.ratings(spark, folder).groupBy("movieId").agg(F.sum(F.col("rating") - 3).alias("s"), F.count(F.lit(1)).alias("n"))
    return joins.grid_cross(sums, penalties.GRIDS["me"]).select(
        "movieId", "pos", "lam", (F.col("s") / (F.col("n") + F.col("lam"))).alias("effect"))


@query("append_rows", with_(RATINGS) + """SELECT row_id, rating FROM ratings WHERE rating > 4
UNION ALL SELECT row_id, rating FROM ratings WHERE rating > 4.5""")
def _(spark, folder):
    df = views.ratings(spark, folder).select("row_id", "rating")
    return joins.append_rows(df.filter("rating > 4"), df.filter("rating > 4.5"))


@query("complement_rows", with_(RATINGS) + "SELECT row_id, rating FROM ratings WHERE rating <= 4.5")
def _(spark, folder):
    df = views.ratings(spark, folder).select("row_id", "rating")
    return joins.complement_rows(df, df.filter("rating > 4.5"), "row_id")


# ---------------------------------------------------------------- aggregates

@query("global_mean", with_(RATINGS) + f"SELECT {r6('avg(rating)')} AS mean FROM ratings")
def _(spark, folder):
    return agg.global_mean(views.ratings(spark, folder), "rating")


for _name, _key, _limit in (("group_mean", "movieId", 30), ("group_mean_user", "userId", 40)):
    def _group(spark, folder, key=_key, limit=_limit):
        return agg.group_mean(views.ratings(spark, folder), key, "rating", limit)
    query(_name, with_(RATINGS) + f"""SELECT {_key}, {r6('avg(rating)')} AS avg, count(*) AS n FROM ratings
GROUP BY {_key} HAVING count(*) > {_limit}""")(_group)


@query("group_mean_filtered", with_(RATINGS) + f"""SELECT genres, {r6('avg(rating)')} AS avg FROM ratings
WHERE genres IN {tuple(MAJOR)} GROUP BY genres""")
def _(spark, folder):
    return agg.group_mean_filtered(views.ratings(spark, folder), "genres", "rating", MAJOR)


@query("distinct_counts", with_(RATED) + """SELECT count(DISTINCT movieId) AS "movieId", count(DISTINCT userId) AS "userId",
count(DISTINCT genres) AS genres, count(DISTINCT year) + cast(bool_or(year IS NULL) AS bigint) AS year FROM rated""")
def _(spark, folder):
    return agg.distinct_counts(rated(spark, folder), ["movieId", "userId", "genres", "year"])


@query("two_level_stats", with_(RATED) + f"""SELECT {r6('avg(a)')} AS mean_avg, {r6('stddev_samp(a)')} AS sd_avg, {r6('min(a)')} AS min_avg,
{r6('median(a)')} AS median_avg, {r6('max(a)')} AS max_avg FROM (SELECT year, avg(rating) AS a FROM rated GROUP BY year)""")
def _(spark, folder):
    return agg.two_level_stats(rated(spark, folder), "year", "rating")


@query("shrunken_effect", with_(RATINGS) + f"""SELECT movieId, {r6('sum(rating - (SELECT avg(rating) FROM ratings)) / (count(*) + 2)')} AS effect
FROM ratings GROUP BY movieId""")
def _(spark, folder):
    df = views.ratings(spark, folder)
    with_mu = joins.attach_scalar(df, agg.global_mean(df, "rating"), "mu")
    return agg.shrunken_effect(with_mu, "movieId", F.col("rating") - F.col("mu"), 2.0)


@query("rmse", with_(RATINGS) + f"""SELECT {r6('sqrt(avg(power(rating - m, 2)))')} AS rmse FROM ratings JOIN
(SELECT movieId, avg(rating) AS m FROM ratings GROUP BY movieId) USING (movieId)""")
def _(spark, folder):
    df = views.ratings(spark, folder)
    means = df.groupBy("movieId").agg(F.avg("rating").alias("m"))
    return agg.rmse(df.join(means, "movieId"), "rating", "m")


_NUM = ["userId", "movieId", "rating", "year"]


@query("column_summary", with_(RATED) + "\nUNION ALL ".join(
    [f"SELECT '{c}' AS name, count(*) AS length, count(*) - count({c}) AS nulls, {r6(f'min({c})')} AS min, {r6(f'avg({c})')} AS mean, "
     f"{r6(f'max({c})')} AS max, {r6(f'quantile_cont({c}, 0.25)')} AS q1, {r6(f'median({c})')} AS median, "
     f"{r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM rated" for c in _NUM]
    + [f"SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL FROM rated" for c in ("title", "genres")]))
def _(spark, folder):
    return agg.column_summary(rated(spark, folder), _NUM, ["title", "genres"])


@query("distinct_rows", with_(RATED) + "SELECT DISTINCT movieId, cast(year AS bigint) AS year FROM rated")
def _(spark, folder):
    return agg.distinct_rows(rated(spark, folder), ["movieId", "year"])


def _anova(source: str, y: str, group: str) -> str:
    return f"""SELECT {r6('sum(n * power(m - g, 2))')} AS ss_between, {r6('sum(w)')} AS ss_within,
count(*) - 1 AS df_between, cast(sum(n) - count(*) AS bigint) AS df_within,
{r6('(sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*)))')} AS f FROM (
SELECT {group}, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS w,
(SELECT avg({y}) FROM {source} WHERE {group} IS NOT NULL) AS g FROM {source} WHERE {group} IS NOT NULL GROUP BY {group})"""


@query("anova_oneway", with_(RATED) + _anova("rated", "rating", "year"))
def _(spark, folder):
    return statistics.anova_oneway(rated(spark, folder), "rating", "year", p_value=False)


@query("anova_oneway_events", _anova("events", "value", "event_type"))
def _(spark, folder):
    return statistics.anova_oneway(views.table(spark, folder, "events"), "value", "event_type", p_value=False)


# Upper tail of F as an integral of the beta density over u = -ln t, by Simpson's rule.
_F_TAIL = f"""stats AS MATERIALIZED ({_anova("rated", "rating", "year")}),
shape AS (SELECT df_within / 2.0::double AS a, df_between / 2.0::double AS b, -ln(df_within / (df_within + df_between * f)::double) AS lo FROM stats),
span AS (SELECT *, (b + 40 * sqrt(b) + 200) / a / 20000 AS h, lgamma(a + b) - lgamma(a) - lgamma(b) AS scale FROM shape),
points AS (SELECT CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, h, a, b, scale, lo + i * h AS u
  FROM span, (SELECT unnest(range(0, 20001)) AS i)),
tail AS (SELECT sum(w * h / 3 * exp(scale - a * u + (b - 1) * ln(1 - exp(-u)))) AS p FROM points)"""


@query("anova_p_value", with_(RATED, _F_TAIL) + f"SELECT stats.*, {r6('p')} AS p FROM stats, tail")
def _(spark, folder):
    return statistics.anova_oneway(rated(spark, folder), "rating", "year")


def _histogram(source: str, col: str, bins: int = 30) -> str:
    return f"""SELECT cast(b AS bigint) AS bin, {r6(f'lo + (b - 1) * ((hi - lo) / {bins})')} AS left_edge,
{r6(f'lo + b * ((hi - lo) / {bins})')} AS right_edge, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, {bins + 1})) AS b),
(SELECT min({col}) AS lo, max({col}) AS hi FROM {source}) LEFT JOIN (
SELECT least({bins}, 1 + floor(({col} - lo) / ((hi - lo) / {bins}::double))) AS bb, count(*) AS n FROM {source},
(SELECT min({col}) AS lo, max({col}) AS hi FROM {source}) GROUP BY 1) ON b = bb"""


@query("histogram", with_(RATINGS, "m AS (SELECT movieId, avg(rating) AS avg FROM ratings GROUP BY movieId)") + _histogram("m", "avg"))
def _(spark, folder):
    return agg.histogram(agg.group_mean(views.ratings(spark, folder), "movieId", "rating"), "avg", 30)


@query("histogram_events", _histogram("events", "value"))
def _(spark, folder):
    return agg.histogram(views.table(spark, folder, "events"), "value", 30)


def _boxes(source: str, by: list[str], v: str) -> str:
    g = ", ".join(by)
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM b.{c}" for c in by)
    bg = ", ".join(f"b.{c}" for c in by)
    inside = f"s.{v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""SELECT {bg}, n, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3,
{r6(f'min(s.{v}) FILTER ({inside})')} AS low_whisker, {r6(f'max(s.{v}) FILTER ({inside})')} AS high_whisker,
count(*) FILTER (NOT ({inside})) AS outliers FROM (SELECT {g}, count({v}) AS n, quantile_cont({v}, 0.25) AS q1, median({v}) AS med,
quantile_cont({v}, 0.75) AS q3 FROM {source} WHERE {v} IS NOT NULL GROUP BY {g}) b
JOIN {source} s ON {on} WHERE s.{v} IS NOT NULL GROUP BY {bg}, n, q1, med, q3"""


@query("boxplot_stats", with_(RATINGS) + _boxes("ratings", ["genres"], "rating"))
def _(spark, folder):
    return agg.boxplot_stats(views.ratings(spark, folder), ["genres"], "rating")


@query("boxplot_stats_events", _boxes("events", ["event_type"], "value"))
def _(spark, folder):
    return agg.boxplot_stats(views.table(spark, folder, "events"), ["event_type"], "value")


# ---------------------------------------------------------------- splits

@query("quantile_breaks", with_(RATINGS) + f"SELECT {r6('unnest(quantile_cont(userId, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]))')} AS value FROM ratings")
def _(spark, folder):
    return exact_quantiles(views.ratings(spark, folder), [], "userId", [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]).select(
        F.explode("quantiles").alias("value"))


@query("split_stratified_numeric", with_(RATINGS, sql.hold_out("ratings", "s", 0.1, "row_id", 1, sql.strata("ratings", "rating")))
       + "SELECT row_id, held_out FROM s")
def _(spark, folder):
    return split.split_stratified_numeric(study.prepare(rated(spark, folder)), "rating", 0.1, ["row_id"], 1).select("row_id", "held_out")


@query("kfold_stratified", with_(RATINGS, sql.folds("ratings", "f", 10, "row_id", 3, "rating")) + "SELECT row_id, fold FROM f")
def _(spark, folder):
    return split.kfold_stratified(study.prepare(rated(spark, folder)), "rating", 10, ["row_id"], 3).select("row_id", "fold")


@query("holdout_known_keys", with_(RATINGS, sql.hold_out("ratings", "s", 0.1, "row_id", 1, sql.strata("ratings", "rating")),
       """kept AS (SELECT row_id FROM s WHERE held_out AND movieId IN (SELECT movieId FROM s WHERE NOT held_out)
AND userId IN (SELECT userId FROM s WHERE NOT held_out))""")
       + "SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM kept) THEN 'validation' ELSE 'model' END AS part FROM s")
def _(spark, folder):
    flagged = write_out(split.split_stratified_numeric(study.prepare(rated(spark, folder)), "rating", 0.1, ["row_id"], 1), "parts")
    train, test = flagged.filter("not held_out"), flagged.filter("held_out")
    kept, model = split.holdout_known_keys(test, train, ["movieId", "userId"], return_removed=True)
    return joins.append_rows(kept.select("row_id", F.lit("validation").alias("part")),
                             model.select("row_id", F.lit("model").alias("part")))


@query("hash_split", with_(RATINGS) + f"SELECT row_id, substr({sql.hashed('row_id', 1)}, 1, 8) < '{round(0.1 * 16**8):08x}' AS held_out FROM ratings")
def _(spark, folder):
    return split.hash_split(views.ratings(spark, folder), 0.1, ["row_id"], 1).select("row_id", "held_out")


# ---------------------------------------------------------------- effect models

def _model_sql(count: int) -> str:
    used = ORDER[:count]
    fits = [sql.effects("train", "(SELECT avg(rating) FROM train)", {e: FIXED[e] for e in used})] if used else []
    error = f"t.rating - ((SELECT avg(rating) FROM train){sql.total(used)})"
    return with_(RATED, sql.train_test("rated"), *fits) + (
        f"SELECT {r6(f'sqrt(avg(power({error}, 2)))')} AS rmse FROM test t {sql.chain(used)}")


for _i, _name in enumerate(["model_global_mean", "model_item_effect", "model_item_user_effect",
                            "model_item_user_category_effect", "model_full_effects"]):
    def _model(spark, folder, count=_i):
        test, fitted, mu = study.fixed_model(rated(spark, folder), count)
        return effects.model_rmse(test, fitted, mu)
    query(_name, _model_sql(_i))(_model)


@query("rmse_ladder", with_(RATED, sql.train_test("rated"), sql.effects("train", "(SELECT avg(rating) FROM train)", FIXED)) + "\nUNION ALL ".join(
    f"SELECT {i + 1}::bigint AS pos, '{label}' AS model, "
    + r6(f"sqrt(avg(power(t.rating - ((SELECT avg(rating) FROM train){sql.total(ORDER[:i])}), 2)))")
    + f" AS rmse FROM test t {sql.chain(ORDER[:i])}" for i, label in enumerate(study.MODELS)))
def _(spark, folder):
    return study.rmse_ladder(rated(spark, folder))


@query("predict_ratings", with_(RATED, sql.train_test("rated"), sql.effects("train", "(SELECT avg(rating) FROM train)", FIXED))
       + f"SELECT row_id, {r6(f'(SELECT avg(rating) FROM train){sql.total(ORDER)}')} AS predicted FROM test t {sql.chain(ORDER)}")
def _(spark, folder):
    test, fitted, mu = study.fixed_model(rated(spark, folder), 4)
    return effects.predict_ratings(test, fitted, mu).select("row_id", "predicted")


# ---------------------------------------------------------------- penalties

def _tuning_sql(names: list[str]) -> str:
    """Tune and fit each effect in turn."""
    mu = "(SELECT avg(rating) FROM train)"
    parts = []
    for e in names:
        parts += [sql.tuning(e, "folded", penalties.GRIDS[e]), sql.effect(e, "train", mu, f"(SELECT lam FROM pen_{e})")]
    return ",\n".join(parts)


FOLDED = sql.folds("train", "folded", 10, "row_id", 3, "rating")


def _tuned(spark, folder, upto: int, errors_of: str):
    """Errors of one effect on every fold and grid value, the earlier effects tuned and fitted."""
    train = study.folded_training(rated(spark, folder))
    chosen = list(effects.EFFECTS[:upto])
    mu = study.mean_rating(train)
    means = penalties.fold_means(train, "fold", "rating")
    cells = penalties.tuning_rows(train, chosen, "fold", "rating")
    for i, effect in enumerate(chosen):
        sums = write_out(penalties.key_sums(cells, effect.key), "key-sums", compact=True)
        errors = penalties.penalty_errors(sums, effect.key, means, penalties.GRIDS[effect.name], on_unseen="drop")
        if effect.name == errors_of:
            return errors
        effect = effect.with_penalty(penalties.tuned_penalty(errors))
        table = penalties.effect_from_sums(sums, effect, mu)
        cells = effects.next_cells(cells, effect, table, chosen[i + 1:], ["fold", "known"])


for _i, _e in enumerate(ORDER, start=1):
    def _tune(spark, folder, upto=_i, name=_e):
        return _tuned(spark, folder, upto, name).drop("part", "unseen_key")
    query(f"tune_penalty_{ {'me': 'item', 'ue': 'user', 'ge': 'category', 'ye': 'year'}[_e] }",
          with_(RATED, sql.train_test("rated"), FOLDED, _tuning_sql(ORDER[:_i]))
          + f"SELECT fold, cast(pos AS bigint) AS pos, {r6('lam')} AS lam, {r6('rmse')} AS rmse FROM tune_{_e}")(_tune)


@query("arg_min_per_group", with_(RATED, sql.train_test("rated"), FOLDED, _tuning_sql(["me"])) + f"""SELECT t.fold, cast(min(pos) AS bigint) AS best_pos,
{r6('any_value(b.lam)')} AS best, {r6('any_value(rmse)')} AS best_metric
FROM tune_me t JOIN best_me b ON t.fold = b.fold AND t.lam = b.lam GROUP BY t.fold""")
def _(spark, folder):
    return penalties.best_penalties(_tuned(spark, folder, 1, "me"))


@query("mean_of_tuned", with_(RATED, sql.train_test("rated"), FOLDED, _tuning_sql(["me"])) + f"SELECT {r6('lam')} AS tuned FROM pen_me")
def _(spark, folder):
    return agg.mean_of_tuned(penalties.best_penalties(_tuned(spark, folder, 1, "me")), "best")


@query("penalty_table", with_(RATED, sql.train_test("rated"), FOLDED, _tuning_sql(ORDER)) + "\nUNION ALL ".join(
    f"SELECT {i}::bigint AS pos, '{study.EFFECT_LABELS[e]}' AS effect, {r6('lam')} AS penalty FROM pen_{e}"
    for i, e in enumerate(ORDER, start=1)))
def _(spark, folder):
    return study.penalty_table(study.tuned_effects(rated(spark, folder)))


MODEL_SET = ",\n".join([
    sql.hold_out("rated", "outer_split", 0.1, "row_id", 1, sql.strata("rated", "rating")),
    """valid AS MATERIALIZED (SELECT * EXCLUDE (held_out) FROM outer_split WHERE held_out
AND movieId IN (SELECT movieId FROM outer_split WHERE NOT held_out) AND userId IN (SELECT userId FROM outer_split WHERE NOT held_out))""",
    """modelling AS MATERIALIZED (SELECT * EXCLUDE (held_out) FROM outer_split WHERE row_id NOT IN (SELECT row_id FROM valid))"""])
FINAL = with_(RATED, MODEL_SET, sql.train_test("modelling"), FOLDED, _tuning_sql(ORDER),
              sql.effects("modelling", "(SELECT avg(rating) FROM modelling)", {e: f"(SELECT lam FROM pen_{e})" for e in ORDER},
                          prefix="final_", first_mu="(SELECT avg(rating) FROM train)"))
_FINAL_SUM = "(SELECT avg(rating) FROM modelling) + coalesce(final_me.me, 0) + final_ue.ue + final_ge.ge + final_ye.ye"


@query("fit_final_and_validate", FINAL + f"SELECT {r6(f'sqrt(avg(power(t.rating - ({_FINAL_SUM}), 2)))')} AS rmse FROM valid t {sql.chain(ORDER, 'final_')}")
def _(spark, folder):
    return study.fit_final_and_validate(rated(spark, folder))["rmse"]
