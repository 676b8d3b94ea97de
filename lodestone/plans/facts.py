"""Queries on extracted facts: cleaning, merging, upserts, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import ontology
from lodestone.functions.text import canonicalize
from lodestone.operators import entities as E
from lodestone.operators import extraction, quality
from lodestone.plans.sql import EDGES, ENT, SOURCE, canon, node
from lodestone.session import table

# Unit aliases.
UNIT_ALIASES = {
    "г/дм3": "г/л", "г/дм³": "г/л", "мг/дм3": "мг/л", "мг/дм³": "мг/л", "℃": "°C", "C": "°C", "А/м²": "А/м2", "м³": "м3", "м³/ч": "м3/ч", "об/м": "об/мин",
}


def entities(spark: SparkSession, d: str) -> DataFrame:
    return E.clean_entities(table(spark, d, "llm_entities"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return E.resolved_edges(entities(spark, d), table(spark, d, "llm_relations"))


def canonicalize_names(spark, d):
    return entities(spark, d).groupBy(canonicalize("name").alias("canon")).agg(F.count("*").alias("n"))


def dedup_entities(spark, d):
    return E.deduplicated(entities(spark, d))


def ensemble_entities(spark, d):
    return E.merge_entities(entities(spark, d))


def ensemble_decisions(spark, d):
    m = E.merge_entities(entities(spark, d))
    return m.groupBy("extractor", "reason", "needs_review").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def ensemble_relations(spark, d):
    return E.merge_relations(edges(spark, d))


def ensemble_entity_payloads(spark, d):
    return E.entity_payloads(entities(spark, d))


def ensemble_relation_payloads(spark, d):
    return E.relation_payloads(edges(spark, d), E.merge_entities(entities(spark, d)))


def edges_or_ids(spark, d):
    return E.edges_or_ids(entities(spark, d), table(spark, d, "llm_relations"))


def dialect_records(spark, d):
    """Entities written in three dialects of field names, by their row number, and read back as one."""
    e = table(spark, d, "llm_entities")
    k = F.col("entity_row_id") % 3
    a = e.where(k == 0).select("entity_row_id", F.col("source_document").alias("source_file"), "canonical_name", "type")
    b = e.where(k == 1).select("entity_row_id", "source_document", F.col("canonical_name").alias("entity"), F.col("type").alias("entity_type"))
    c = e.where(k == 2).select("entity_row_id", F.col("source_document").alias("file"), F.col("canonical_name").alias("label"), F.col("type").alias("kind"))
    return extraction.one_dialect(a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True))


def record_rejections(spark, d):
    return extraction.rejections(table(spark, d, "llm_entities"), ontology.ENTITY_TYPES)


def source_names(spark, d):
    return table(spark, d, "llm_relations").groupBy(E.source_name("extractor").alias("source")).agg(F.count("*").alias("n"))


def confidence_calibration(spark, d):
    e = entities(spark, d).where("confidence is not null")
    s = e.groupBy("type", canonicalize("name").alias("canon")).agg(F.count_distinct("source_document").alias("support"))
    e = e.withColumn("canon", canonicalize("name")).join(s, ["type", "canon"])
    return e.select("entity_row_id", E.calibrated(F.col("confidence"), F.col("extractor"), F.col("support"), F.col("needs_review")).alias("calibrated"))


def attribute_merge(spark, d):
    return E.attribute_latest(entities(spark, d))


def graph_upsert_nodes(spark, d):
    return E.upsert_nodes(entities(spark, d)).drop("extractor")


def graph_upsert_edges(spark, d):
    return E.upsert_edges(edges(spark, d))


def graph_satellites(spark, d):
    return E.satellites(entities(spark, d))


def graph_stats(spark, d):
    n = E.upsert_nodes(entities(spark, d)).groupBy("label").agg(F.count("*").alias("n_nodes"))
    v = ontology.vocabulary(spark, ontology.ENTITY_TYPES, "label")
    return v.join(n, "label", "left").na.fill(0, ["n_nodes"])


def unknown_types(spark, d):
    return ontology.unknown_values(entities(spark, d), "type", ontology.ENTITY_TYPES).groupBy("type").agg(F.count("*").alias("n"))


def alias_resolve(spark, d):
    g = table(spark, d, "synonym_groups").select("canonical_name", F.explode("aliases").alias("alias")).where("trim(alias) <> ''")
    keys = g.groupBy(canonicalize("alias").alias("canon")).agg(F.max("canonical_name").alias("resolved"))
    e = entities(spark, d).select("entity_row_id", "name", canonicalize("name").alias("canon"))
    return e.join(keys, "canon", "left").select("entity_row_id", F.coalesce("resolved", "name").alias("resolved"))


def quality_issues(spark, d):
    return quality.issues(entities(spark, d), table(spark, d, "llm_relations"), edges(spark, d))


def knowledge_gaps(spark, d):
    return quality.gaps(E.upsert_nodes(entities(spark, d)), edges(spark, d))


def contradictions(spark, d):
    return quality.contradictions(edges(spark, d))


def normalized_entities(spark, d):
    """Names resolved through the glossary within their record, and units of properties in one spelling."""
    r = alias_resolve(spark, d)
    unit = F.trim(F.try_element_at("attributes", F.lit("unit")))
    alias = F.create_map(*[F.lit(x) for p in UNIT_ALIASES.items() for x in p])
    e = entities(spark, d).select("entity_row_id", "type", F.when(F.col("type") == "Property", F.coalesce(F.try_element_at(alias, unit), unit)).otherwise(unit).alias("unit"))
    return e.join(r, "entity_row_id").groupBy("type", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"), F.count_distinct("resolved").alias("n_names"))


def safe_relation_types(spark, d):
    r = table(spark, d, "llm_relations").where("trim(predicate) <> ''")
    return r.groupBy(ontology.safe_relation_type("predicate").alias("relation_type")).agg(F.count("*").alias("n"))


def type_name_counts(spark, d):
    """The 200 most frequent names with their types."""
    e = entities(spark, d).groupBy("type", "name").agg(F.count("*").alias("n"))
    return e.orderBy(F.col("n").desc(), "type", "name").limit(200)


QUERIES = {
    f.__name__: f
    for f in (
        normalized_entities, safe_relation_types, type_name_counts, canonicalize_names, dedup_entities, ensemble_entities, ensemble_decisions, ensemble_relations, ensemble_entity_payloads, ensemble_relation_payloads, edges_or_ids, dialect_records, record_rejections, source_names, confidence_calibration,
        attribute_merge, graph_upsert_nodes, graph_upsert_edges, graph_satellites, graph_stats, unknown_types, alias_resolve, quality_issues,
        knowledge_gaps, contradictions,
    )
}

_W = f"CASE WHEN {SOURCE} IN ('natasha', 'statistical_ner') THEN 0.3 ELSE 0.7 END"
_MERGED = f"""WITH {ENT},
m0 AS (SELECT *, {canon('name')} AS canon, {SOURCE} AS source, {_W} AS w FROM ent WHERE confidence IS NOT NULL),
m1 AS (
  SELECT chunk_id, type, canon, arg_max(name, (confidence, length(name), -entity_row_id)) AS name,
         least(1.0, round(sum(confidence * w) / sum(w) + CASE WHEN count(*) > 1 THEN 0.08 ELSE 0.0 END, 4)) AS confidence,
         array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n_members
  FROM m0 GROUP BY 1, 2, 3),
m AS (
  SELECT chunk_id, 'ens_e' || row_number() OVER (PARTITION BY chunk_id ORDER BY type, canon) AS local_id, type, canon, name, confidence,
         'ensemble:' || sources AS extractor, n_members,
         CASE WHEN sources NOT LIKE '%,%' THEN 'single_source' ELSE 'exact_canonical_match' END AS reason,
         sources NOT LIKE '%,%' AND confidence < 0.58 AS needs_review
  FROM m1)
"""
_ALL = "'" + "','".join(ontology.ENTITY_TYPES) + "'"
_NODES = """nodes AS (
  SELECT type AS label, name, min(extracted_at) AS created_at, arg_max_null(confidence, (extracted_at, entity_row_id)) AS confidence,
         count(DISTINCT source_document) AS n_documents, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_rows FROM ent GROUP BY 1, 2)"""

_UNITS = ", ".join(f"('{k}', '{v}')" for k, v in UNIT_ALIASES.items())
_RESOLVED = f"""a AS (SELECT canonical_name, unnest(aliases) AS alias FROM synonym_groups),
k AS (SELECT {canon('alias')} AS canon, max(canonical_name) AS resolved FROM a WHERE trim(alias) <> '' GROUP BY 1),
res AS (SELECT entity_row_id, coalesce(resolved, name) AS resolved FROM ent LEFT JOIN k ON {canon('name')} = k.canon)"""

SQL = {
    "normalized_entities": f"""WITH {ENT}, {_RESOLVED}, u(x, y) AS (VALUES {_UNITS}), e AS (SELECT entity_row_id, type, trim(attributes['unit']) AS raw FROM ent)
SELECT type, coalesce(CASE WHEN type = 'Property' THEN coalesce(y, raw) ELSE raw END, '') AS unit, count(*) AS n, count(DISTINCT resolved) AS n_names
FROM e JOIN res USING (entity_row_id) LEFT JOIN u ON u.x = raw GROUP BY 1, 2""",
    "safe_relation_types": r"""WITH x AS (SELECT regexp_replace(regexp_replace(upper(trim(predicate)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM llm_relations WHERE trim(predicate) <> '')
SELECT CASE WHEN t = '' THEN 'RELATED_TO' WHEN regexp_matches(t, '^[0-9]') THEN 'R_' || t ELSE t END AS relation_type, count(*) AS n FROM x GROUP BY 1""",
    "type_name_counts": f"WITH {ENT} SELECT type, name, count(*) AS n FROM ent GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 200",
    "canonicalize_names": f"WITH {ENT} SELECT {canon('name')} AS canon, count(*) AS n FROM ent GROUP BY 1",
    "dedup_entities": f"""WITH {ENT}, r AS (SELECT *, {canon('name')} AS canon FROM ent),
mm AS (SELECT chunk_id, type, canon, count(DISTINCT m) AS n_mentions FROM (SELECT chunk_id, type, canon, unnest(mentions) AS m FROM r) WHERE trim(m) <> '' GROUP BY 1, 2, 3)
SELECT r.chunk_id, r.type, r.canon, min(entity_row_id) AS entity_row_id, arg_min(name, entity_row_id) AS name, count(*) AS n_rows,
       coalesce(min(page), 0) AS first_page, coalesce(max(page), 0) AS last_page, coalesce(any_value(n_mentions), 0) AS n_mentions
FROM r LEFT JOIN mm ON r.chunk_id IS NOT DISTINCT FROM mm.chunk_id AND r.type = mm.type AND r.canon = mm.canon GROUP BY 1, 2, 3""",
    "ensemble_entities": _MERGED + "SELECT * FROM m",
    "ensemble_decisions": _MERGED + "SELECT extractor, reason, needs_review, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM m GROUP BY 1, 2, 3",
    "ensemble_relations": f"""WITH {EDGES},
r AS (SELECT *, {canon('s_name')} AS s_canon, {canon('t_name')} AS t_canon, {SOURCE} AS source, {_W} AS w, trim(coalesce(quote, '')) AS q
      FROM edges WHERE confidence IS NOT NULL)
SELECT chunk_id, s_type, s_canon, predicate, t_type, t_canon,
       least(1.0, round(sum(confidence * w) / sum(w) + CASE WHEN count(*) > 1 THEN 0.08 ELSE 0.0 END, 4)) AS confidence,
       max(length(q)) AS quote_chars, nullif(array_to_string(list_sort(list(DISTINCT trim(note)) FILTER (trim(note) <> '')), '; '), '') AS note,
       count(*) AS n_members, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
FROM r GROUP BY 1, 2, 3, 4, 5, 6""",
    "ensemble_entity_payloads": f"""WITH {ENT}, r AS (SELECT *, {canon('name')} AS canon FROM ent WHERE confidence IS NOT NULL), k AS (SELECT DISTINCT chunk_id, type, canon FROM r),
mm AS (SELECT chunk_id, type, canon, list_sort(list(DISTINCT trim(m))) AS mentions FROM (SELECT chunk_id, type, canon, unnest(mentions) AS m FROM r) WHERE trim(m) <> '' GROUP BY 1, 2, 3),
x AS (SELECT chunk_id, type, canon, confidence, entity_row_id, unnest(map_entries(attributes)) AS kv FROM r),
b AS (SELECT chunk_id, type, canon, kv.key AS a, arg_max(kv.value, (confidence, entity_row_id)) AS v FROM x WHERE kv.value IS NOT NULL GROUP BY 1, 2, 3, 4),
aa AS (SELECT chunk_id, type, canon, list_sort(list(a || '=' || v)) AS attributes FROM b GROUP BY 1, 2, 3)
SELECT k.chunk_id, k.type, k.canon, coalesce(mentions, []) AS mentions, coalesce(attributes, []) AS attributes FROM k
LEFT JOIN mm ON mm.chunk_id = k.chunk_id AND mm.type = k.type AND mm.canon = k.canon LEFT JOIN aa ON aa.chunk_id = k.chunk_id AND aa.type = k.type AND aa.canon = k.canon""",
    "ensemble_relation_payloads": _MERGED.replace(f"WITH {ENT}", f"WITH {EDGES}") + f""", r AS (SELECT *, {canon('s_name')} AS s_canon, {canon('t_name')} AS t_canon, trim(coalesce(quote, '')) AS q FROM edges WHERE confidence IS NOT NULL),
j AS (SELECT r.*, coalesce(a.local_id, s_type || ':' || s_canon) AS source_id, coalesce(b.local_id, t_type || ':' || t_canon) AS target_id FROM r
  LEFT JOIN m a ON a.chunk_id = r.chunk_id AND a.type = s_type AND a.canon = s_canon LEFT JOIN m b ON b.chunk_id = r.chunk_id AND b.type = t_type AND b.canon = t_canon)
SELECT chunk_id, source_id, predicate, target_id, arg_max(q, (length(q), -relation_row_id)) AS quote, count(*) AS n_members FROM j GROUP BY 1, 2, 3, 4""",
    "edges_or_ids": f"""WITH {EDGES}, nm AS (SELECT chunk_id, lower(name) AS key, arg_min(name, entity_row_id) AS named FROM ent GROUP BY 1, 2),
x AS (SELECT relation_row_id, r.chunk_id, trim(predicate) AS predicate, trim(subject) AS s, trim(object) AS t FROM llm_relations r WHERE trim(predicate) <> ''),
y AS (SELECT x.*, coalesce(a.name, c.named) AS sf, coalesce(b.name, e.named) AS tf FROM x LEFT JOIN ids a ON a.chunk_id = x.chunk_id AND a.local_id = s LEFT JOIN ids b ON b.chunk_id = x.chunk_id AND b.local_id = t
  LEFT JOIN nm c ON c.chunk_id = x.chunk_id AND c.key = lower(s) LEFT JOIN nm e ON e.chunk_id = x.chunk_id AND e.key = lower(t))
SELECT relation_row_id, coalesce(sf, nullif(s, ''), '?') AS source, predicate, coalesce(tf, nullif(t, ''), '?') AS target, (sf IS NOT NULL)::INT + (tf IS NOT NULL)::INT AS n_resolved FROM y""",
    "dialect_records": "SELECT entity_row_id, source_document, canonical_name AS name, type FROM llm_entities",
    "record_rejections": f"""WITH i AS (SELECT chunk_id, trim(coalesce(local_id, '')) AS id, count(*) AS n, count(*) FILTER (NOT coalesce(trim(type) IN ({_ALL}), false)) AS bad FROM llm_entities WHERE chunk_id IS NOT NULL GROUP BY 1, 2)
SELECT chunk_id, sum(n)::BIGINT AS n_entities, sum(bad)::BIGINT AS n_bad_types, count(*) FILTER (id <> '' AND n > 1) AS n_repeated_ids, sum(bad) = 0 AND count(*) FILTER (id <> '' AND n > 1) = 0 AS accepted FROM i GROUP BY 1""",
    "source_names": f"SELECT {SOURCE} AS source, count(*) AS n FROM llm_relations GROUP BY 1",
    "confidence_calibration": f"""WITH {ENT}, e AS (SELECT *, {canon('name')} AS canon FROM ent WHERE confidence IS NOT NULL),
s AS (SELECT type, canon, count(DISTINCT source_document) AS support FROM e GROUP BY 1, 2)
SELECT entity_row_id, least(1.0, greatest(0.0, round(confidence + CASE WHEN lower(extractor) LIKE '%ensemble%' THEN 0.08 ELSE 0.0 END
  + least(0.12, greatest(0, support - 1) * 0.03) - CASE WHEN needs_review THEN 0.12 ELSE 0.0 END, 4))) AS calibrated
FROM e JOIN s USING (type, canon)""",
    "attribute_merge": f"""WITH {ENT}, x AS (SELECT {node('type', 'name')} AS node, extracted_at, entity_row_id, unnest(map_entries(attributes)) AS kv FROM ent)
SELECT node, kv.key AS k, arg_max(kv.value, (extracted_at, entity_row_id)) AS v FROM x WHERE trim(kv.value) <> '' GROUP BY 1, 2""",
    "graph_upsert_nodes": f"WITH {ENT}, {_NODES} SELECT * FROM nodes",
    "graph_upsert_edges": f"""WITH {EDGES} SELECT s_type, s_name, predicate, t_type, t_name, arg_min_null(note, (extracted_at, relation_row_id)) AS note,
  arg_max_null(confidence, (extracted_at, relation_row_id)) AS confidence, arg_max_null(source_document, (extracted_at, relation_row_id)) AS source_document,
  count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks FROM edges GROUP BY 1, 2, 3, 4, 5""",
    "graph_satellites": rf"""WITH {ENT}, x AS (
  SELECT 'Document' AS label, source_document AS id FROM ent UNION ALL SELECT 'Chunk', chunk_id FROM ent
  UNION ALL SELECT 'Alias', unnest(mentions) FROM ent UNION ALL SELECT 'Geography', name FROM ent WHERE type = 'Geography'
  UNION ALL SELECT 'Year', regexp_extract(name, '(1[89]|20)\d\d', 0) FROM ent WHERE type = 'Year'
  UNION ALL SELECT 'NumericValue', concat_ws('::', chunk_id, local_id, 'numeric') FROM ent
    WHERE try_cast(coalesce(attributes['value'], attributes['numeric_value']) AS DOUBLE) IS NOT NULL)
SELECT label, id, count(*) AS n_edges FROM x WHERE trim(id) <> '' GROUP BY 1, 2""",
    "graph_stats": f"""WITH {ENT}, {_NODES}, v AS (SELECT unnest([{_ALL}]) AS label)
SELECT v.label, count(nodes.name) AS n_nodes FROM v LEFT JOIN nodes ON v.label = nodes.label GROUP BY 1""",
    "unknown_types": f"WITH {ENT} SELECT type, count(*) AS n FROM ent WHERE type NOT IN ({_ALL}) GROUP BY 1",
    "alias_resolve": f"""WITH {ENT}, a AS (SELECT canonical_name, unnest(aliases) AS alias FROM synonym_groups),
k AS (SELECT {canon('alias')} AS canon, max(canonical_name) AS resolved FROM a WHERE trim(alias) <> '' GROUP BY 1)
SELECT entity_row_id, coalesce(resolved, name) AS resolved FROM ent LEFT JOIN k ON {canon('name')} = k.canon""",
    "quality_issues": f"""WITH {EDGES}, i AS (
  SELECT 'low_confidence_entity' AS code, 'warning' AS severity, chunk_id, CAST(entity_row_id AS VARCHAR) AS evidence FROM ent WHERE confidence < 0.45
  UNION ALL SELECT 'low_confidence_relation', 'warning', chunk_id, CAST(relation_row_id AS VARCHAR) FROM llm_relations WHERE confidence < 0.45
  UNION ALL SELECT 'missing_relation_endpoint', 'error', r.chunk_id, CAST(r.relation_row_id AS VARCHAR) FROM llm_relations r
    WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.chunk_id = r.chunk_id AND ids.local_id = trim(r.subject))
       OR NOT EXISTS (SELECT 1 FROM ids WHERE ids.chunk_id = r.chunk_id AND ids.local_id = trim(r.object))
  UNION ALL SELECT 'explicit_contradiction', 'warning', chunk_id, CAST(relation_row_id AS VARCHAR) FROM llm_relations WHERE trim(predicate) = 'contradicts'
  UNION ALL SELECT 'possible_semantic_contradiction', 'warning', chunk_id, least(s_id, t_id) || '|' || greatest(s_id, t_id) FROM edges
    GROUP BY chunk_id, least(s_id, t_id), greatest(s_id, t_id)
    HAVING bool_or(predicate = 'has_limitation') AND bool_or(predicate = 'has_expected_result')
  UNION ALL SELECT 'entities_without_relations', 'warning', chunk_id, '' FROM ent WHERE chunk_id NOT IN (SELECT chunk_id FROM llm_relations WHERE chunk_id IS NOT NULL) GROUP BY chunk_id)
SELECT code, severity, chunk_id, evidence FROM i""",
    "knowledge_gaps": f"""WITH {EDGES}, {_NODES},
deg AS (SELECT label, name, count(*) AS degree, count(DISTINCT source_document) AS docs FROM (
  SELECT s_type AS label, s_name AS name, source_document FROM edges UNION ALL SELECT t_type, t_name, source_document FROM edges) GROUP BY 1, 2),
g AS (
  SELECT 'isolated_entity' AS code, n.label, n.name FROM nodes n ANTI JOIN deg ON n.label = deg.label AND n.name = deg.name
  UNION ALL SELECT 'low_confidence_entity', label, name FROM nodes WHERE confidence > 0 AND confidence < 0.45
  UNION ALL SELECT 'single_source_support', label, name FROM deg WHERE docs < 2)
SELECT code, label, name FROM g""",
    "contradictions": f"""WITH {EDGES}, p AS (
  SELECT *, {node('s_type', 's_name')} AS s, {node('t_type', 't_name')} AS t FROM edges),
o AS (SELECT least(s, t) AS a, greatest(s, t) AS b FROM p GROUP BY 1, 2
  HAVING (bool_or(predicate = 'has_limitation') AND bool_or(predicate = 'has_expected_result')) OR (bool_or(predicate = 'replaced_by') AND bool_or(predicate = 'uses_technology')))
SELECT DISTINCT s, predicate, t, quote FROM p WHERE predicate = 'contradicts' OR EXISTS (SELECT 1 FROM o WHERE a = least(s, t) AND b = greatest(s, t))""",
}
