"""Plans of search questions: language, glossary terms, and the texts that go to dense and lexical ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import glossary

#: Characters that count as others when texts are matched (fixed values): small digits, ё, dashes.
SMALL, PLAIN = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹ё‐‑‒–—−", "01234567890123456789е------"


def match_text(text: Column | str) -> Column:
    """Text for matching: lower case, small digits as digits, ё as е, one kind of dash, blanks collapsed."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.trim(F.regexp_replace(F.translate(c, SMALL, PLAIN), r"\s+", " "))


def cleaned(text: Column | str) -> Column:
    """Question without needless blanks and without punctuation at its ends."""
    c = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r" +([,.;:?!])", "$1"), r"^[.,;: ]+|[.,;: ]+$", ""))


def language(text: Column | str) -> dict[str, Column]:
    """Script flags of a text; English is what has Latin letters and no Cyrillic ones."""
    c = F.col(text) if isinstance(text, str) else text
    cyrillic, latin = c.rlike("[А-Яа-яЁё]"), c.rlike("[A-Za-z]")
    return {"has_cyrillic": cyrillic, "has_latin": latin, "is_english": latin & ~cyrillic}


def planned(questions: DataFrame, query_id: str, text: str, groups: DataFrame) -> DataFrame:
    """(query_id, cleaned, language flags, matched_terms, dense_query, bm25_query).

    The terms are the longest glossary spans that don't overlap. The dense text gets the groups' names, the lexical one
    all of their spellings. Questions without terms keep their own text.
    """
    found = glossary.without_overlaps(glossary.matches(questions, query_id, text, glossary.terms(groups)))
    names = groups.select("canonical_id", "canonical_name", F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.trim(x) != "")).alias("aliases"))
    per = found.join(names, "canonical_id").groupBy("key").agg(
        F.array_sort(F.collect_set("alias")).alias("matched_terms"), F.array_sort(F.collect_set("canonical_name")).alias("names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("spellings"),
    )
    q = questions.select(F.col(query_id).alias("key"), cleaned(text).alias("cleaned")).join(per, "key", "left")
    some = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    return q.select(
        F.col("key").alias("query_id"), "cleaned", *[v.alias(k) for k, v in language("cleaned").items()],
        F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"),
        F.trim(F.concat_ws(" ", "cleaned", some("names"))).alias("dense_query"), F.trim(F.concat_ws(" ", "cleaned", some("spellings"))).alias("bm25_query"),
    )
