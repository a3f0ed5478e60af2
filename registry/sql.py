"""SQL fragments for the independent check: the study tables, splits, folds and effect fits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.sources.views import PROTEINS, SPARSE

RATINGS = """ratings AS MATERIALIZED (
SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           cast(l_quantity AS int), cast(round(l_extendedprice*100) AS bigint))) AS row_id,
       o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity/5)/2 AS rating,
       CASE WHEN l_partkey % 97 = 0 THEN p_name
            ELSE concat(p_name, ' (', cast(1950 + l_partkey % 60 AS int), ')') END AS title,
       concat(p_type, '|', p_brand) AS genres
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

YEAR = r"cast(nullif(regexp_extract(title, '\(([0-9]{4})\)', 1), '') AS integer)"
RATED = RATINGS + f",\nrated AS MATERIALIZED (SELECT *, {YEAR} AS year FROM ratings)"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::double)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, with no negative zero; integers widened."""
    def column(name: str, kind: str) -> str:
        if kind in ("double", "float"):
            return f"round(cast(`{name}` AS double), {digits}) + 0.0D AS `{name}`"
        return f"cast(`{name}` AS bigint) AS `{name}`" if kind in ("int", "smallint", "tinyint") else f"`{name}`"

    return df.selectExpr(*[column(name, kind) for name, kind in df.dtypes])


def proteins(name: str = "proteins") -> str:
    cells = []
    for i, c in enumerate(PROTEINS):
        gap = "vec_id % 3 = 0" if i in SPARSE else f"(vec_id*31 + {i * 7}) % 53 = 0"
        cells.append(f"CASE WHEN NOT ({gap}) THEN cast(embedding[{i + 1}] AS double) END AS {c}")
    return (f"{name} AS MATERIALIZED (SELECT vec_id AS MouseID, {', '.join(cells)}, "
            "cast(label % 2 AS bigint) AS Genotype, cast((label // 2) % 2 AS bigint) AS Treatment, "
            "cast((label // 4) % 2 AS bigint) AS Behavior, cast(label AS bigint) AS class FROM embeddings)")


KEPT = [c for i, c in enumerate(PROTEINS) if i not in SPARSE]


def complete(source: str = "proteins", name: str = "complete") -> str:
    """The table without the sparse columns, gaps filled by the class median."""
    cells = [f"coalesce({c}, median({c}) OVER (PARTITION BY class)) AS {c}" for c in KEPT]
    return (f"{name} AS MATERIALIZED (SELECT MouseID, {', '.join(cells)}, Genotype, Treatment, Behavior, class "
            f"FROM {source})")


def hashed(keys: str, seed: int) -> str:
    return f"md5(concat_ws('#', {keys}, '{seed}'))"


def strata(source: str, y: str) -> str:
    breaks = f"(SELECT list_distinct(quantile_cont({y}, [0, 0.25, 0.5, 0.75, 1])) FROM {source})"
    return f"greatest(1, len(list_filter({breaks}, lambda b: b < {y})))"


def hold_out(source: str, name: str, p: float, key: str, seed: int, by: str) -> str:
    """``source`` with a flag ``held_out`` by the rank of the hash within each stratum."""
    return f"""{name} AS MATERIALIZED (SELECT * EXCLUDE (stratum, rn, n), rn <= ceil(round({p} * n, 9)) AS held_out FROM (
SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {hashed(key, seed)}) AS rn,
       count(*) OVER (PARTITION BY stratum) AS n
FROM (SELECT *, {by} AS stratum FROM {source})))"""


def folds(source: str, name: str, k: int, key: str, seed: int, y: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT * EXCLUDE (stratum, rn, n), cast(1 + (rn - 1) * {k} // n AS bigint) AS fold FROM (
SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {hashed(key, seed)}) AS rn,
       count(*) OVER (PARTITION BY stratum) AS n
FROM (SELECT *, {strata(source, y)} AS stratum FROM {source})))"""


def train_test(source: str, prefix: str = "", seed: int = 2, p: float = 0.2) -> str:
    """CTEs ``{prefix}train`` and ``{prefix}test`` (held-out rows with unseen keys dropped)."""
    return ",\n".join([
        hold_out(source, f"{prefix}split", p, "row_id", seed, strata(source, "rating")),
        f"{prefix}train AS MATERIALIZED (SELECT * EXCLUDE (held_out) FROM {prefix}split WHERE NOT held_out)",
        f"""{prefix}test AS MATERIALIZED (SELECT * EXCLUDE (held_out) FROM {prefix}split WHERE held_out
AND movieId IN (SELECT movieId FROM {prefix}train) AND userId IN (SELECT userId FROM {prefix}train))"""])


KEY = {"me": "movieId", "ue": "userId", "ge": "genres", "ye": "year"}
ORDER = ["me", "ue", "ge", "ye"]


def chain(names: list[str], prefix: str = "") -> str:
    """LEFT JOINs of the effect tables on a row source aliased t."""
    return " ".join(f"LEFT JOIN {prefix}{e} ON t.{KEY[e]} IS NOT DISTINCT FROM {prefix}{e}.{KEY[e]}" for e in names)


def total(names: list[str], prefix: str = "") -> str:
    return "".join(f" + {prefix}{e}.{e}" for e in names)


def effect(name: str, source: str, mu: str, penalty: str, prefix: str = "") -> str:
    """CTE with one effect fitted on the residual of those before it."""
    before = ORDER[:ORDER.index(name)]
    return (f"{prefix}{name} AS MATERIALIZED (SELECT t.{KEY[name]} AS {KEY[name]}, "
            f"sum(rating - ({mu}{total(before, prefix)})) / (count(*) + {penalty}) AS {name} "
            f"FROM {source} t {chain(before, prefix)} GROUP BY t.{KEY[name]})")


def effects(source: str, mu: str, penalties: dict[str, str], prefix: str = "", first_mu: str | None = None) -> str:
    return ",\n".join(effect(e, source, first_mu if e == "me" and first_mu else mu, penalties[e], prefix)
                      for e in ORDER if e in penalties)


def grid(name: str, values: list[float]) -> str:
    rows = ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(values, start=1))
    return f"{name}(pos, lam) AS (VALUES {rows})"


def tuning(name: str, folded: str, values: list[float]) -> str:
    """CTE ``tune_{name}`` (fold, pos, lam, rmse), row by row: every held-out row at every penalty."""
    key, before = KEY[name], ORDER[:ORDER.index(name)]
    res = f"t.rating{''.join(f' - {e}.{e}' for e in before)}"
    return f"""{grid('grid_' + name, values)},
base_{name} AS MATERIALIZED (SELECT t.fold, t.movieId, t.{key} AS k, t.rating, {res} AS y FROM {folded} t {chain(before)}),
mu_{name} AS MATERIALIZED (SELECT f.fold, avg(b.rating) AS mu FROM (SELECT DISTINCT fold FROM {folded}) f
  JOIN base_{name} b ON b.fold <> f.fold GROUP BY f.fold),
out_{name} AS MATERIALIZED (SELECT m.fold, b.k, sum(b.y - m.mu) AS s, count(*) AS n
  FROM mu_{name} m JOIN base_{name} b ON b.fold <> m.fold GROUP BY m.fold, b.k),
seen_{name} AS MATERIALIZED (SELECT DISTINCT f.fold, b.movieId FROM mu_{name} f JOIN base_{name} b ON b.fold <> f.fold),
tune_{name} AS MATERIALIZED (SELECT b.fold, g.pos, g.lam,
  sqrt(avg(power(b.y - m.mu - o.s / (o.n + g.lam), 2))) AS rmse,
  sum(power(o.s / (o.n + g.lam), 2) - 2 * o.s / (o.n + g.lam) * (b.y - m.mu)) AS part
  FROM base_{name} b JOIN mu_{name} m ON b.fold = m.fold
  SEMI JOIN seen_{name} w ON w.fold = b.fold AND w.movieId = b.movieId
  LEFT JOIN out_{name} o ON o.fold = b.fold AND o.k IS NOT DISTINCT FROM b.k
  CROSS JOIN grid_{name} g GROUP BY b.fold, g.pos, g.lam),
best_{name} AS MATERIALIZED (SELECT fold, lam FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY part, pos) AS rn
  FROM tune_{name} WHERE rmse IS NOT NULL) WHERE rn = 1),
pen_{name} AS MATERIALIZED (SELECT avg(lam) AS lam FROM best_{name})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
