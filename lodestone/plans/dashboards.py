"""Overview queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import dashboards as D
from lodestone.plans import facts
from lodestone.plans.sql import EDGES, ENT, node
from lodestone.session import table


def dash_entity_rollup(spark, d):
    return D.rollup(facts.entities(spark, d), facts.edges(spark, d))


def dash_top_docs(spark, d):
    e = facts.entities(spark, d).groupBy("source_document").agg(F.count_distinct("type", "name").alias("n_entities"))
    return e.orderBy(F.col("n_entities").desc(), "source_document").limit(15)


def dash_types(spark, d):
    return facts.edges(spark, d).groupBy("predicate", "s_type", "t_type").agg(F.count("*").alias("n"))


def dash_domain_coverage(spark, d):
    return D.domain_coverage(table(spark, d, "documents"), "text")


def dash_risk_zones(spark, d):
    return D.risk_zones(facts.entities(spark, d), facts.edges(spark, d))


def dash_gaps(spark, d):
    """Entities without relations, and well-linked ones of low confidence."""
    r = D.rollup(facts.entities(spark, d), facts.edges(spark, d))
    code = F.when(F.col("degree") == 0, "isolated_entity").when((F.col("confidence") < 0.7) & (F.col("degree") >= 2), "low_confidence")
    return r.select(code.alias("code"), "type").where("code is not null").groupBy("code", "type").agg(F.count("*").alias("n"))


def coverage_matrix_gap(spark, d):
    e, g = facts.entities(spark, d), facts.edges(spark, d)
    return D.uncovered_pairs(D.rollup(e, g), g, "Process", "Material")


def tech_chains(spark, d):
    return D.chains(facts.edges(spark, d))


def expert_affiliations(spark, d):
    return D.affiliations(facts.edges(spark, d))


def consensus_sources(spark, d):
    return D.consensus(facts.edges(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        dash_entity_rollup, dash_top_docs, dash_types, dash_domain_coverage, dash_risk_zones, dash_gaps, coverage_matrix_gap, tech_chains,
        expert_affiliations, consensus_sources,
    )
}

_ROLL = f"""{EDGES}, e0 AS (SELECT *, {node('type', 'name')} AS id FROM ent),
b AS (SELECT id, type, min(name) AS name, count(*) AS n_rows, count(DISTINCT source_document) AS doc_count FROM e0 GROUP BY 1, 2),
mm AS (SELECT id, count(DISTINCT substr(m, 1, 80)) AS n_mentions FROM (SELECT id, unnest(mentions) AS m FROM e0) WHERE trim(m) <> '' GROUP BY 1),
ends AS (SELECT {node('s_type', 's_name')} AS id FROM edges UNION ALL SELECT {node('t_type', 't_name')} FROM edges), g AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1),
roll AS (SELECT b.*, coalesce(n_mentions, 0) AS n_mentions, coalesce(degree, 0) AS degree, round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.05::DOUBLE * ln(1 + n_rows)), 3) AS confidence
  FROM b LEFT JOIN mm USING (id) LEFT JOIN g USING (id))"""
_DOM = " UNION ALL ".join(
    f"SELECT '{d}' AS domain, count(*) AS n_documents FROM documents WHERE regexp_matches(lower(text), '{'|'.join(k.split())}')" for d, k in D.DOMAINS.items()
)
_ORD = "ORDER BY degree DESC, doc_count DESC, id LIMIT 20"

SQL = {
    "dash_entity_rollup": f"WITH {_ROLL} SELECT id, type, name, n_rows, doc_count, n_mentions, degree, confidence FROM roll",
    "dash_top_docs": f"WITH {ENT} SELECT source_document, count(DISTINCT (type, name)) AS n_entities FROM ent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "dash_types": f"WITH {EDGES} SELECT predicate, s_type, t_type, count(*) AS n FROM edges GROUP BY 1, 2, 3",
    "dash_domain_coverage": _DOM,
    "dash_risk_zones": f"""WITH {EDGES}, n AS (SELECT source_document, count(DISTINCT {node('type', 'name')}) AS n_entities FROM ent GROUP BY 1),
c AS (SELECT source_document, count(*) AS n_contradictions FROM edges WHERE predicate = 'contradicts' GROUP BY 1)
SELECT source_document, coalesce(n_entities, 0) AS n_entities, coalesce(n_contradictions, 0) AS n_contradictions FROM n FULL JOIN c USING (source_document)
WHERE coalesce(n_entities, 0) < 40 OR coalesce(n_contradictions, 0) > 0""",
    "dash_gaps": f"""WITH {_ROLL} SELECT CASE WHEN degree = 0 THEN 'isolated_entity' ELSE 'low_confidence' END AS code, type, count(*) AS n FROM roll
WHERE degree = 0 OR (confidence < 0.7 AND degree >= 2) GROUP BY 1, 2""",
    "coverage_matrix_gap": f"""WITH {_ROLL}, p AS (SELECT id AS a FROM roll WHERE type = 'Process' {_ORD}), m AS (SELECT id AS b FROM roll WHERE type = 'Material' {_ORD}),
u AS (SELECT {node('s_type', 's_name')} AS s, {node('t_type', 't_name')} AS t FROM edges WHERE predicate = 'uses_material')
SELECT a, b FROM p, m WHERE NOT EXISTS (SELECT 1 FROM u WHERE (s = a AND t = b) OR (s = b AND t = a))""",
    "tech_chains": f"""WITH {EDGES}, f AS (SELECT {node('s_type', 's_name')} AS process, predicate, t_name, min(relation_row_id) AS first_row FROM edges
  WHERE lower(s_type) = 'process' AND predicate IN ('uses_material', 'produces_output', 'uses_equipment') GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY process, predicate ORDER BY first_row) AS n FROM f),
c AS (SELECT process, coalesce(string_agg(t_name, '; ' ORDER BY first_row) FILTER (predicate = 'uses_material' AND n <= 3), '') AS materials,
  coalesce(string_agg(t_name, '; ' ORDER BY first_row) FILTER (predicate = 'uses_equipment' AND n <= 2), '') AS equipment,
  coalesce(string_agg(t_name, '; ' ORDER BY first_row) FILTER (predicate = 'produces_output' AND n <= 3), '') AS results FROM w GROUP BY 1)
SELECT * FROM c WHERE materials <> '' AND (equipment <> '' OR results <> '')""",
    "expert_affiliations": f"""WITH {EDGES}, a AS (SELECT s_name AS expert, count(DISTINCT t_name) AS n_affiliations, min(t_name) AS first_affiliation FROM edges
  WHERE predicate IN ('affiliated_with', 'used_in_facility', 'performed_by') AND s_type = 'Expert' GROUP BY 1),
p AS (SELECT t_name AS expert, count(*) AS n_publications FROM edges WHERE predicate = 'authored_by' AND t_type = 'Expert' GROUP BY 1)
SELECT expert, coalesce(n_affiliations, 0) AS n_affiliations, coalesce(first_affiliation, '') AS first_affiliation, coalesce(n_publications, 0) AS n_publications FROM a FULL JOIN p USING (expert)""",
    "consensus_sources": f"""WITH {EDGES} SELECT {node('s_type', 's_name')} AS s, predicate, {node('t_type', 't_name')} AS t, count(DISTINCT source_document) AS n_documents, count(*) AS n_rows
FROM edges GROUP BY 1, 2, 3 HAVING count(DISTINCT source_document) >= 2""",
}
