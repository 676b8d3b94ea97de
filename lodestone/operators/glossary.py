"""Glossary terms in texts: matching, choice of spans, and mining of new pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import canonicalize

# Forms of definitions, 'full name (ABC)', 'left / right' in two alphabets, and 'ABC - full name'; words that make a pair noise.
FORMS = {
    "abbreviation": r"([А-Яа-яA-Za-zЁё][А-Яа-яA-Za-zЁё0-9 ,-]{6,80}) *[(]([A-ZА-ЯЁ]{2,12}|[A-ZА-ЯЁ][A-ZА-ЯЁ0-9-]{1,15})[)]",
    "slash": r"([А-Яа-яЁё][А-Яа-яЁё0-9 ,-]{3,60}) */ *([A-Za-z][A-Za-z0-9 ,-]{3,60})",
    "dash": r"([A-ZА-ЯЁ]{2,12}) *[—–-] *([А-Яа-яA-Za-zЁё][А-Яа-яA-Za-zЁё0-9 ,-]{6,80})",
}
NOISE = "таблица|рисунок|figure|table|образец|sample|приложение|источник"
EXAMPLES, CONTEXT, SALTS = 3, 300, 64


def terms(groups: DataFrame) -> DataFrame:
    """(canonical_id, alias): canonical spellings of the names and aliases of each group."""
    every = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    out = groups.select("canonical_id", every.alias("a")).select("canonical_id", canonicalize("a").alias("alias"))
    return out.where("alias <> ''").distinct()


def matches(texts: DataFrame, key: str, text: str, alias: DataFrame) -> DataFrame:
    """(key, canonical_id, alias, start, n_words) of every alias in every text, by words.

    The texts are cut into word groups of the lengths that aliases have, which meet the aliases by equality.
    """
    w = F.split(canonicalize(text), " ")
    lengths = alias.agg(F.coalesce(F.collect_set(F.size(F.split("alias", " "))), F.array().cast("array<int>")).alias("lengths"))  # one row of small numbers
    rows = texts.select(F.col(key).alias("key"), w.alias("w")).crossJoin(F.broadcast(lengths))
    size = F.size("w")
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(
            F.filter("lengths", lambda n: n <= size - i + 1),
            lambda n: F.struct(i.alias("start"), n.alias("n_words"), F.array_join(F.slice("w", i, n), " ").alias("alias")),
        ),
    ))
    return rows.select("key", F.inline(grams)).join(alias, "alias").select("key", "canonical_id", "alias", "start", "n_words")


def without_overlaps(found: DataFrame) -> DataFrame:
    """For each key the longest spans that don't overlap, in order of length, then place; a text has few spans."""
    span = F.struct((-F.col("n_words")).alias("size"), "start", "alias", "canonical_id")
    spans = found.groupBy("key", "start", "n_words", "alias").agg(F.min("canonical_id").alias("canonical_id")).groupBy("key").agg(
        F.array_sort(F.collect_list(span)).alias("spans")
    )
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["start"] - y["size"]) & (y["start"] < x["start"] - x["size"]))
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return spans.select("key", F.inline(kept)).select("key", "start", (-F.col("size")).alias("n_words"), "alias", "canonical_id")


def candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, form, n, n_texts, examples, rank): pairs of spellings that texts define by each other; rank 1 is the most frequent.

    Noisy pairs are left out: table and figure words, single letters, mostly digits. ``examples`` holds the beginnings of the
    first three texts by key; they are picked within ``SALTS`` parts of a pair first, so a pair that a third of all texts hold
    is no single task.
    """
    own, clean = texts.select(F.col(key).alias("key"), F.col(text).alias("t")), lambda c: F.trim(F.regexp_replace(c, " +", " "), F.lit(" ,.;:()[]{}"))
    every = None
    for form, pattern in FORMS.items():
        d = own.select("key", "t", F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("d"))
        x, y = (clean(F.lower(F.regexp_extract("d", pattern, k))) for k in (1, 2))
        d = d.select("key", F.left("t", F.lit(CONTEXT)).alias("context"), F.lit(form).alias("form"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        every = d if every is None else every.unionByName(d)
    for c in ("a", "b"):
        digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
        every = every.where(~F.col(c).rlike(NOISE) & (F.length(c) > 1) & (digits <= F.greatest(F.lit(3), F.floor(F.length(c) / 3))))
    counts = every.groupBy("a", "b").agg(F.min("form").alias("form"), F.count("*").alias("n"), F.count_distinct("key").alias("n_texts"))
    shown = every.groupBy("a", "b", "key").agg(F.min("context").alias("context")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    for part in (["a", "b", "salt"], ["a", "b"]):
        w = Window.partitionBy(*part).orderBy("key")
        shown = shown.withColumn("place", F.row_number().over(w)).where(F.col("place") <= EXAMPLES)
    shown = shown.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("key", "context"))).alias("x"))
    ranked = counts.join(shown, ["a", "b"]).select("a", "b", "form", "n", "n_texts", F.transform("x", lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["context"])).alias("examples"))
    above = counts.groupBy("n").agg(F.count("*").alias("pairs"))  # few distinct counts
    above = above.select("n", (F.coalesce(F.sum("pairs").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("rank"))
    return ranked.join(F.broadcast(above), "n")


def alias_pairs(rows: DataFrame, key: str, names: str) -> DataFrame:
    """(a, b, n, n_keys): spellings that stand in the same array of names; an array holds a few names."""
    own = F.array_distinct(F.transform(names, lambda x: F.lower(F.trim(x))))
    each = rows.select(F.col(key).alias("key"), F.filter(own, lambda x: x != "").alias("w"))
    pairs = F.flatten(F.transform("w", lambda x: F.transform(F.filter("w", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return each.select("key", F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))
