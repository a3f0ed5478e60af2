"""Text expressions: fixed splits, first-match extraction and removal, safe casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

YEAR_IN_TITLE = r"\([0-9]{4}\)"


def replace_all(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def remove_first(col: Column, pattern: str) -> Column:
    """Drop the first match of ``pattern``, which must hold no capturing group."""
    return F.regexp_replace(col, f"(?s)^(.*?)(?:{pattern})", "$1")


def split_fixed(col: Column, sep: str, n: int) -> list[Column]:
    """Exactly ``n`` pieces; the last keeps the rest and missing ones are empty strings."""
    pieces = F.split(col, "\\Q" + sep + "\\E", n)
    return [F.coalesce(F.get(pieces, F.lit(i)), F.lit("")) for i in range(n)]


# All that a cast to an integer may take, and little else: digits, with a sign before and blanks around.
_LIKE_INTEGER = r"^[^!-~]*[+-]?[0-9.]+[^!-~]*$"


def to_integer(col: Column) -> Column:
    """Null where the text is no integer. Each failing cast costs an exception, so most of them are told by a pattern."""
    return F.when(col.rlike(_LIKE_INTEGER), col.try_cast("bigint"))


def to_number(col: Column) -> Column:
    return col.try_cast("double")


def to_text(col: Column) -> Column:
    return col.cast("string")


def extract_year(title: Column) -> Column:
    """First ``(dddd)`` of the text as an integer, null when there is none."""
    return F.translate(F.regexp_substr(title, F.lit(YEAR_IN_TITLE)), "()", "").try_cast("int")
