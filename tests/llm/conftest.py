"""Small documents that hold the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", None), (5, "", None, "b"),
            (6, "  \n\t ", "de", "b"), (7, "Hi", "de", "c"), (8, "hi", "fr", "c"), (9, prose(2, 30) + "\n\n" + prose(3, 10), None, None),
            (10, base.replace(" ", "  "), "en", "a"), (11, base.replace(" ", "  "), "en", "a"), (11, base.replace(" ", "  "), "en", "a"),
            (None, prose(4, 25), "en", "a"), (None, base, "en", "a"), (12, "12 34 !! 56", "en", "b"), (13, prose(5, 9000), "en", "c"),
            (14, "é ü ñ 漢字 𝒳 end", "fr", "c"), (15, "Er " * 300, "de", "c"), (16, "one two three", "en", "a"), (17, "one two three four", "en", "a")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """With extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(awkward_rows(), SCHEMA).selectExpr("*", "length(text) as n_chars", "1 as id", "'x' as body", "2 as size", "'y' as digest",
                                                                  "3 as kept", "0.5 as score", "'k' as row", "4 as block", "5 as curve", "6 as n")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
