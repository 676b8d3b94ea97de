"""Agreement of predictions with a gold standard: matching by key, by overlap and by name; precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; zero where a denominator is zero."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def matched(gold: DataFrame, predicted: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """tp, fp and fn of each class; both sides count each key once."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full")
    return both.groupBy(cls).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    )


def per_class(counts: DataFrame, cls: str) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(cls, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def averages(counts: DataFrame) -> DataFrame:
    """One row for each of micro, macro and weighted averaging; macro and weighted use the classes' unrounded values."""
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = counts.select("tp", "fp", "fn", p.alias("p"), r.alias("r"), f.alias("f"), (F.col("tp") + F.col("fn")).alias("w"))
    total = rows.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro = total.select(F.lit("micro").alias("kind"), *[F.round(x, 6).alias(n) for x, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])
    macro = rows.agg(F.lit("macro").alias("kind"), *[F.round(F.avg(c), 6).alias(n) for c, n in zip("prf", ("precision", "recall", "f1"), strict=True)])
    weight = F.nullif(F.sum("w"), F.lit(0))
    weighted = rows.agg(
        F.lit("weighted").alias("kind"),
        *[F.round(F.coalesce(F.sum(F.col(c) * F.col("w")) / weight, F.lit(0.0)), 6).alias(n) for c, n in zip("prf", ("precision", "recall", "f1"), strict=True)],
    )
    return micro.unionByName(macro).unionByName(weighted)


def overlaps(gold: DataFrame, spans: DataFrame, bin_chars: int = 2000, least: float = 0.3) -> DataFrame:
    """(file, gold_id, span_id, shared) of gold spans and spans of the same file that share at least ``least`` of the gold span.

    Both sides are cut into bins of characters, so that the join is by file and bin; a pair that meets in several bins
    is kept once, in the bin where the overlap begins.
    """
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence((F.col("s") / bin_chars).cast("int"), (F.greatest(F.col("e") - 1, F.col("s")) / bin_chars).cast("int"))))
    g = bins(gold.where("e > s").select("file", "gold_id", "s", "e")).withColumnsRenamed({"s": "gs", "e": "ge"})
    p = bins(spans.where("e > s").select("file", "span_id", "s", "e"))
    start, end = F.greatest("gs", "s"), F.least("ge", "e")
    pairs = g.join(p, ["file", "bin"]).where((end > start) & ((start / bin_chars).cast("int") == F.col("bin")))
    pairs = pairs.withColumn("shared", end - start).where(F.col("shared") >= least * (F.col("ge") - F.col("gs")))
    return pairs.select("file", "gold_id", "span_id", "shared")


def best_overlap(pairs: DataFrame) -> DataFrame:
    """The span that shares most with each gold span; ties go to the smaller id."""
    return pairs.groupBy("file", "gold_id").agg(F.min_by(F.struct("span_id", "shared"), F.struct(-F.col("shared"), "span_id")).alias("b")).select(
        "file", "gold_id", "b.span_id", "b.shared"
    )


def clean_name(name: Column | str) -> Column:
    """A file name without folder and extension, letters and digits only, lower case."""
    c = F.col(name) if isinstance(name, str) else name
    base = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}]", "")


def golden_issues(samples: DataFrame, min_chars: int = 1) -> DataFrame:
    """(sample_id, issue) of annotated samples: struct arrays ``entities`` (id, type, name, mentions) and ``relations``
    (subject, predicate, object, quote) are checked against the text and the vocabularies."""
    from lodestone.ontology import GOLDEN_RELATIONS, GOLDEN_TYPES

    e, r, text = F.col("entities"), F.col("relations"), F.coalesce(F.col("text"), F.lit(""))
    ids = F.transform(e, lambda x: x["id"])
    flag = lambda test, name: F.when(test, F.lit(name))
    checks = F.array(
        flag(F.length(F.trim(text)) < min_chars, "empty_text"),
        flag(F.exists(e, lambda x: F.coalesce(F.trim(x["id"]), F.lit("")) == ""), "entity_without_id"),
        flag(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_entity_id"),
        flag(F.exists(e, lambda x: ~F.coalesce(x["type"].isin(GOLDEN_TYPES), F.lit(False))), "unknown_entity_type"),
        flag(F.exists(e, lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) == ""), "entity_without_name"),
        flag(F.exists(e, lambda x: F.exists(F.coalesce(x["mentions"], F.array()), lambda m: ~F.contains(text, m))), "mention_not_in_text"),
        flag(F.exists(r, lambda x: ~F.coalesce(x["predicate"].isin(GOLDEN_RELATIONS), F.lit(False))), "unknown_predicate"),
        flag(F.exists(r, lambda x: ~F.coalesce(F.array_contains(ids, x["subject"]), F.lit(False))), "unknown_subject"),
        flag(F.exists(r, lambda x: ~F.coalesce(F.array_contains(ids, x["object"]), F.lit(False))), "unknown_object"),
        flag(F.exists(r, lambda x: F.coalesce(x["quote"], F.lit("")) == ""), "relation_without_evidence"),
        flag(F.exists(r, lambda x: ~F.contains(text, F.coalesce(x["quote"], F.lit("")))), "evidence_not_in_text"),
    )
    return samples.select("sample_id", F.explode(F.array_compact(checks)).alias("issue"))
