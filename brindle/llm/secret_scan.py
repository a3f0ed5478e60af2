"""Secrets in texts, found through a trigram index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams of lower-case text is derived: an OR
of ANDs that every match must satisfy. The index holds the postings (trigram, document) of all trigrams
that some rule asks for. Per rule the postings are intersected by counting, per document, how many
trigrams of an AND it has. The candidates are then verified with the expression itself. A rule without
mandatory trigrams has no query and scans every text.

Defined results: a null text is empty and has no spans; rows that repeat an id are each verified, on
the union of their candidates; a null id is an id of its own; empty input gives no rows; other columns
are not read; a very long text is matched whole, and its n spans are placed in n log n steps; spans of different kinds that
begin alike are listed in the order of the rules. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.tables import stage

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules; below them those that this method adds.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


# --- from an expression to a query ---------------------------------------------------------------
# A query is a set of ANDs, each a frozenset of trigrams; None is the query that everything meets.

def _meets(strings: set[str]) -> frozenset | None:
    """What a text must have that contains one of ``strings``."""
    ands = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in ands else frozenset(a for a in ands if not any(b < a for b in ands))


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return b if a is None else a
    ands = {x | y for x, y in product(a, b)}
    return frozenset(x for x in ands if not any(y < x for y in ands)) if len(ands) <= MOST_STRINGS else a


def _one(item) -> tuple[set[str] | None, frozenset | None]:
    """Exact lower-case strings of one parsed item if there are few, else the query of its matches."""
    op, value = item
    if op is C.LITERAL:
        return {chr(value).lower()}, None
    if op is C.IN and all(o is C.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}, None
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*[strings for strings, _ in parts]), None
        queries = [_meets(s) if s is not None else q for s, q in parts]
        return None, None if None in queries else frozenset().union(*queries)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), None
        return None, (query if strings is None else _meets(strings)) if low else None
    return None, None


def _sequence(items) -> tuple[set[str] | None, frozenset | None]:
    run, query, exact = {""}, None, True
    for item in items:
        strings, inner = _one(item)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact, query = False, _both(_both(query, _meets(run)), inner)
        run = strings if strings is not None else {""}
    return (run, None) if exact else (None, _both(query, _meets(run)))


def trigram_query(pattern: str) -> frozenset | None:
    strings, query = _sequence(parser.parse(pattern))
    return _meets(strings) if strings is not None else query


# --- index, intersection, verification -----------------------------------------------------------

def build_index(docs: DataFrame, grams: list[str], key: str, text: str) -> DataFrame:
    """Postings (gram, id) of ``grams`` in the lower-case texts, written in order of the trigram."""
    low = docs.select(F.col(key).alias("id"), F.lower(text).alias("low"))
    vocabulary = F.array(*[F.lit(g) for g in grams]) if grams else F.array().cast("array<string>")
    postings = low.select("id", F.explode(F.filter(vocabulary, lambda g: F.contains(F.col("low"), g))).alias("gram"))
    return stage(postings.sortWithinPartitions("gram"), "secrets-index")


def intersect(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(id, kinds): the rules whose query a document meets."""
    terms = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("part"), F.lit(gram).alias("gram"), F.lit(len(part)).alias("need"))
             for kind, query in queries.items() for n, part in enumerate(sorted(query, key=sorted)) for gram in sorted(part)]
    # one row per rule, AND and trigram: bounded by the rules
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*terms)))
    met = (index.distinct().join(F.broadcast(wanted), "gram").groupBy("id", "kind", "part", "need").agg(F.count("*").alias("has"))
           .where("has = need"))
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule in order: running sums of the gaps between them and their own lengths are positions."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.length(s))
    valued = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.length(s))
    ends = _running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, own: gap + own))
    matches = F.arrays_zip(found.alias("found"), ends.alias("end"), valued.alias("valued"))
    long_enough = F.filter(matches, lambda m: m["valued"] >= rule.least)
    return F.transform(long_enough, lambda m: F.struct((m["end"] - m["found"]).alias("begin"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))


def _running(steps: Column) -> Column:
    """Running sums of an array: each turn adds the value 1, 2, 4, ... places before, so n values take log n passes."""
    def add(sums: Column, turn: Column) -> Column:
        shift = F.pow(F.lit(2), turn).cast("int")
        before = F.slice(F.concat(F.array_repeat(F.lit(0), shift), sums), 1, F.size(sums))
        return F.zip_with(sums, before, lambda own, earlier: own + earlier)

    turns = F.ceil(F.log2(F.greatest(F.size(steps), F.lit(1)))).cast("int")
    return F.when(F.size(steps) < 2, steps).otherwise(F.aggregate(F.sequence(F.lit(0), turns - 1), steps, add))


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<begin:int,order:int,kind:string,end:int>>)")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
                 base: tuple[str, ...] = tuple(r.kind for r in BASE_RULES)) -> DataFrame:
    """One row per document: key, spans per kind, n_<kind> of the base kinds, base_sha256, spans."""
    derived = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {kind: q for kind, q in derived.items() if q is not None}
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if queries:
        grams = sorted({g for q in queries.values() for part in q for g in part})
        candidates = stage(intersect(build_index(rows, grams, "id", "body"), queries).withColumnRenamed("id", "cid"), "secrets-candidates")
        rows = rows.join(candidates, rows["id"].eqNullSafe(candidates["cid"]), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    spans = {}
    for order, rule in enumerate(rules):
        verify = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.col("body").rlike(rule.pattern)
        spans[rule.kind] = F.when(verify, _spans(F.col("body"), rule, order)).otherwise(_no_spans())
    found = rows.select("id", *[s.alias(f"spans_{kind}") for kind, s in spans.items()])

    def joined(kinds) -> Column:
        return reduce(F.concat, [F.col(f"spans_{k}") for k in kinds])

    return found.select(F.col("id").alias(key), *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(_written(joined(base)), 256).alias("base_sha256"), _written(joined(spans)).alias("spans"))
