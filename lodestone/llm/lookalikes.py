"""Visually identical text in one consistent form.

Compatibility forms that look the same are normalised and ignorable characters deleted. A word whose letters come from
several scripts is then read as a lattice: every letter may also be any of its look-alikes, every path must stay within
one script, and Viterbi picks the path with the best character bigram score of that script. The bigram counts come
from all consistent words of the column (Spark counts them; the table is bounded by the square of the alphabets).

Defined results: null stays null; the empty text is consistent; a mixed word that no single script can spell keeps its
letters but counts as inconsistent only if some script could spell it with look-alikes (otherwise it has no consistent
spelling); words of one script stay as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of letters that look alike, as Latin, Cyrillic, Greek ('-' where a script has none).
ALIKE = """
a а α; c с -; e е -; o о ο; p р ρ; x х χ; y у γ; i і ι; j ј -; s ѕ -; k к κ; v - ν; u - υ; t т τ; m м -; n п η; h һ -; b - β; r г -;
A А Α; B В Β; C С -; E Е Ε; H Н Η; I І Ι; J Ј -; K К Κ; M М Μ; N - Ν; O О Ο; P Р Ρ; S Ѕ -; T Т Τ; X Х Χ; Y У Υ; Z - Ζ; - П Π; - Г Γ; - Ф Φ
"""
# Compatibility characters that do not look like their decomposition.
KEPT = "№™℠℡…"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _alike_map() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for group in ALIKE.replace("\n", " ").split(";"):
        letters = dict(zip(SCRIPTS, group.split(), strict=False))
        for own in letters.values():
            if own != "-":
                out[own] = {s: x for s, x in letters.items() if x != "-"}
    return out


_ALIKE = _alike_map()


@lru_cache(4096)
def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, or '' for anything else."""
    first = unicodedata.name(ch, "").split(" ")[0]
    return first if first in SCRIPTS else ""


@lru_cache(65536)
def _plain_char(ch: str) -> str:
    if ch in KEPT:
        return ch
    if unicodedata.category(ch) == "Cf" or ch in "\u034f\u115f\u1160\u3164\ufe0e\ufe0f":
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in "\u2010\u2011\ufe63\uff0d":
        return "-"
    tag = unicodedata.decomposition(ch).split(" ")[0]
    return unicodedata.normalize("NFKC", ch) if tag in _SAME_LOOK and not tag.startswith("<sup") else ch


def plain(text: str) -> str:
    """Composed characters, plain spaces and hyphens, no ignorable characters, no look-alike compatibility variants."""
    return unicodedata.normalize("NFC", "".join(map(_plain_char, text)))


_WORD = re.compile(r"[^\W\d_]+")


def spell(word: str, scores: dict[tuple[str, str], float]) -> str:
    """The best spelling of a mixed word in one script; the word itself if no script can spell it."""
    best, found = -math.inf, word
    for target in SCRIPTS:
        column: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for ch in word:
            own = script(ch)
            options = {ch} if own in (target, "") else set()
            other = _ALIKE.get(ch, {}).get(target)
            options |= {other} if other else set()
            nxt: dict[str, tuple[float, str]] = {}
            for option in options:
                for last, (score, path) in column.items():
                    total = score + scores.get((last, option.lower()), -12.0)
                    if option.lower() not in nxt or total > nxt[option.lower()][0]:
                        nxt[option.lower()] = (total, path + option)
            column = nxt
        for last, (score, path) in column.items():
            total = score + scores.get((last, "$"), -12.0)
            if total > best:
                best, found = total, path
    return found


def is_mixed(word: str) -> bool:
    return len({script(c) for c in word} - {""}) > 1


def consistent(text: str, scores: dict[tuple[str, str], float]) -> str:
    """The consistent form of one value."""
    return _WORD.sub(lambda m: spell(m[0], scores) if is_mixed(m[0]) else m[0], plain(text))


#: Java pattern: values that hold anything but plain characters, or neighbours of different scripts.
SUSPICIOUS = (
    r"[^\x09-\x0D\x20-\x7EЁА-яё«»№–—Α-Ωα-ω]"
    r"|\p{IsCyrillic}\p{L}*[\p{IsLatin}\p{IsGreek}]|\p{IsLatin}\p{L}*[\p{IsCyrillic}\p{IsGreek}]|\p{IsGreek}\p{L}*[\p{IsCyrillic}\p{IsLatin}]"
)


def slots(df: DataFrame, row_id: str, name: str, others: str) -> DataFrame:
    """(row_id, slot, value): slot 0 is the name, 1.. are the entries of the array."""
    values = F.concat(F.array(name), F.coalesce(F.col(others), F.array().cast("array<string>")))
    out = df.select(F.col(row_id).alias("row_id"), F.posexplode(values).alias("slot", "value"))
    return out.where("value is not null")


def bigram_counts(values: DataFrame, weight: Column | None = None) -> DataFrame:
    """(a, b, n) over the words of values of plain letters only, with ^ and $ as borders.

    Values that hold any letter outside the three alphabets are suspicious, so there are at most the alphabets' square of rows.
    """
    word = F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    clean = values.where(~F.col("value").rlike(SUSPICIOUS)).select(word.alias("w"), (F.lit(1) if weight is None else weight).alias("n")).groupBy("w").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(marked, i, F.lit(2))))
    pairs = clean.select(pair.alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    return pairs.select(F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b"), "n")


def bigram_scores(values: DataFrame, weight: Column | None = None) -> dict[tuple[str, str], float]:
    """Log-probabilities of b after a; a table bounded by the alphabets."""
    rows = bigram_counts(values, weight).collect()
    total: dict[str, int] = {}
    for r in rows:
        total[r.a] = total.get(r.a, 0) + r.n
    return {(r.a, r.b): math.log(r.n / total[r.a]) for r in rows}


def consistent_udf(scores: dict[tuple[str, str], float]):
    """Arrow UDF for the consistent form; repeated values are computed once in each batch."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        known = {v: consistent(v, scores) for v in values.dropna().unique()}
        return values.map(known)

    return form


def with_consistent(values: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``consistent``; only suspicious values pass through Python."""
    form = consistent_udf(bigram_scores(values.withColumnRenamed(column, "value")))
    odd = F.col(column).rlike(SUSPICIOUS)
    plain_rows = values.where(~odd).withColumn("consistent", F.col(column))
    return plain_rows.unionByName(values.where(odd).withColumn("consistent", form(F.col(column))))


def inconsistent_slots(df: DataFrame, row_id: str, name: str, others: str) -> DataFrame:
    """(row_id, slot, value, consistent) of each value that isn't in the consistent form."""
    values = slots(df, row_id, name, others)
    form = consistent_udf(bigram_scores(values))
    odd = values.where(F.col("value").rlike(SUSPICIOUS)).withColumn("consistent", form(F.col("value")))
    return odd.where("value <> consistent")

