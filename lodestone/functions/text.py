"""Small text expressions shared by operators. All of them are Columns; none runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column | str) -> Column:
    """Without leading and trailing blanks of any kind (Unicode white space)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(col: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def letters_digits(col: Column | str) -> Column:
    """Lower-case letters and digits only; null becomes the empty string. Decomposed й and ё are composed first."""
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    c = F.replace(F.replace(c, F.lit("\u0438\u0306"), F.lit("\u0439")), F.lit("\u0435\u0308"), F.lit("\u0451"))
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def canonicalize(col: Column | str) -> Column:
    """Lower case, punctuation other than hyphens and underscores deleted, blanks collapsed; null becomes ''."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s-]", ""))


def mean(col: str, digits: int) -> Column:
    """Rounded mean of a column, the same in whatever order the rows are added: each value counts in whole units of 1e-9."""
    whole = F.round(F.col(col) * 1e9).cast("bigint")
    return F.round(F.sum(whole) / F.count(whole) / 1e9, digits)
