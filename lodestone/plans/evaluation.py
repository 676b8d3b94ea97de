"""Evaluation queries: model extractors against the statistical one, chunks against spans of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import ontology
from lodestone.functions.text import canonicalize
from lodestone.operators import evaluation as V
from lodestone.plans import facts
from lodestone.plans.sql import ENT, canon
from lodestone.session import table


def _counts(spark, d):
    e = facts.entities(spark, d).withColumn("canon", canonicalize("name"))
    return V.matched(e.where("extractor = 'chat_model_a'"), e.where("extractor <> 'chat_model_a'"), ["chunk_id", "type", "canon"], "type")


def prf_per_class(spark, d):
    return V.per_class(_counts(spark, d), "type")


def prf_micro_macro_weighted(spark, d):
    return V.averages(_counts(spark, d))


def _spans(spark, d):
    c = table(spark, d, "chunks").select(
        "chunk_id", F.col("provenance.source_document").alias("file"), F.col("provenance.char_start").alias("s"), F.col("provenance.char_end").alias("e")
    ).distinct()
    return c.withColumnRenamed("chunk_id", "gold_id"), c.withColumnRenamed("chunk_id", "span_id")


def overlap_all(spark, d):
    return V.overlaps(*_spans(spark, d))


def overlap_match(spark, d):
    return V.best_overlap(V.overlaps(*_spans(spark, d), least=0.05).where("gold_id <> span_id").distinct())


def fuzzy_doc_match(spark, d):
    """Chunk titles' files against entity files by cleaned name: the first file in order whose name is equal."""
    a = table(spark, d, "chunks").select(F.col("provenance.source_document").alias("file")).distinct()
    b = table(spark, d, "llm_relations").select(F.col("source_document").alias("other")).distinct()
    key = lambda df, c: df.withColumn("name", V.clean_name(c))
    return key(a, "file").join(key(b, "other"), "name").groupBy("file", "name").agg(F.min("other").alias("first_match"), F.count("*").alias("n_matches"))


def golden_validate(spark, d):
    """Every chunk's extraction as an annotated sample."""
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.max_by("text", "ingested_at").alias("text"))
    e = facts.entities(spark, d).groupBy("chunk_id").agg(
        F.collect_list(F.struct(F.col("local_id").alias("id"), "type", "name", F.col("mentions").alias("mentions"))).alias("entities")
    )
    r = table(spark, d, "llm_relations").groupBy("chunk_id").agg(
        F.collect_list(F.struct(F.trim("subject").alias("subject"), "predicate", F.trim("object").alias("object"), "quote")).alias("relations")
    )
    s = c.join(e, "chunk_id").join(r, "chunk_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast(r.schema["relations"].dataType)))
    return V.golden_issues(s.withColumnRenamed("chunk_id", "sample_id"))


QUERIES = {f.__name__: f for f in (prf_per_class, prf_micro_macro_weighted, overlap_all, overlap_match, fuzzy_doc_match, golden_validate)}

_C = f"""{ENT}, k AS (SELECT DISTINCT chunk_id, type, {canon('name')} AS canon, extractor = 'chat_model_a' AS g FROM ent),
u AS (SELECT chunk_id, type, canon, bool_or(g) AS g, bool_or(NOT g) AS p FROM k GROUP BY 1, 2, 3),
n AS (SELECT type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM u GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, tp + fn AS w FROM n)"""
_S = """c AS (SELECT DISTINCT chunk_id, provenance.source_document AS file, provenance.char_start AS s, provenance.char_end AS e FROM chunks),
o AS (SELECT g.file, g.chunk_id AS gold_id, p.chunk_id AS span_id, least(g.e, p.e) - greatest(g.s, p.s) AS shared, g.e - g.s AS size FROM c g JOIN c p ON g.file = p.file
  WHERE g.e > g.s AND p.e > p.s AND least(g.e, p.e) > greatest(g.s, p.s))"""
_NAME = r"regexp_replace(lower(regexp_replace(regexp_replace({}, '^.*/', ''), '\.[A-Za-z0-9]{{1,5}}$', '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_T = "'" + "','".join(ontology.GOLDEN_TYPES) + "'"
_R = "'" + "','".join(ontology.GOLDEN_RELATIONS) + "'"

SQL = {
    "prf_per_class": f"WITH {_C} SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m",
    "prf_micro_macro_weighted": f"""WITH {_C} SELECT 'micro' AS kind, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall,
  round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM m UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m
UNION ALL SELECT 'weighted', round(sum(p * w) / sum(w), 6), round(sum(r * w) / sum(w), 6), round(sum(f * w) / sum(w), 6) FROM m""",
    "overlap_all": f"WITH {_S} SELECT file, gold_id, span_id, shared FROM o WHERE shared >= 0.3 * size",
    "overlap_match": f"""WITH {_S} SELECT file, gold_id, span_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY file, gold_id ORDER BY shared DESC, span_id) AS n
  FROM (SELECT DISTINCT * FROM o WHERE gold_id <> span_id AND shared >= 0.05 * size)) WHERE n = 1""",
    "fuzzy_doc_match": f"""WITH a AS (SELECT DISTINCT provenance.source_document AS file FROM chunks), b AS (SELECT DISTINCT source_document AS other FROM llm_relations)
SELECT file, {_NAME.format('file')} AS name, min(other) AS first_match, count(*) AS n_matches FROM a JOIN b ON {_NAME.format('file')} = {_NAME.format('other')} GROUP BY 1, 2""",
    "golden_validate": f"""WITH {ENT}, c AS (SELECT chunk_id, arg_max_null(text, ingested_at) AS text FROM chunks GROUP BY 1),
e AS (SELECT ent.*, coalesce(c.text, '') AS text FROM ent JOIN c USING (chunk_id)), k AS (SELECT DISTINCT chunk_id, text FROM e),
r AS (SELECT r.*, k.text FROM llm_relations r JOIN k USING (chunk_id)),
i AS (SELECT chunk_id, 'empty_text' AS issue FROM k WHERE length(trim(text)) < 1
  UNION SELECT chunk_id, 'entity_without_id' FROM e WHERE coalesce(local_id, '') = ''
  UNION SELECT chunk_id, 'duplicate_entity_id' FROM e GROUP BY chunk_id HAVING count(*) > count(DISTINCT local_id) + CASE WHEN count(*) > count(local_id) THEN 1 ELSE 0 END
  UNION SELECT chunk_id, 'unknown_entity_type' FROM e WHERE type NOT IN ({_T})
  UNION SELECT chunk_id, 'mention_not_in_text' FROM (SELECT chunk_id, text, unnest(mentions) AS m FROM e) WHERE NOT contains(text, m)
  UNION SELECT chunk_id, 'unknown_predicate' FROM r WHERE predicate IS NULL OR predicate NOT IN ({_R})
  UNION SELECT chunk_id, 'unknown_subject' FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.chunk_id = r.chunk_id AND e.local_id = trim(r.subject))
  UNION SELECT chunk_id, 'unknown_object' FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.chunk_id = r.chunk_id AND e.local_id = trim(r.object))
  UNION SELECT chunk_id, 'relation_without_evidence' FROM r WHERE coalesce(quote, '') = ''
  UNION SELECT chunk_id, 'evidence_not_in_text' FROM r WHERE NOT contains(text, coalesce(quote, '')))
SELECT chunk_id AS sample_id, issue FROM i""",
}
