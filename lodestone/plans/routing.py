"""Routing queries. The questions are the titles of documents and phrases made from the extracted facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import answer
from lodestone.functions.text import mean
from lodestone.operators import queryplan as Q
from lodestone.operators import routing as R
from lodestone.operators.entities import node_key
from lodestone.plans import facts, graph
from lodestone.plans.sql import EDGES, mean_sql, node
from lodestone.session import scratch_dir, table, written


def questions(spark, d):
    """One question for each relation row with resolved endpoints: its form follows the predicate and the row id."""
    return _asked(facts.edges(spark, d))


def _asked(e):
    k = F.col("relation_row_id") % 8
    n = F.col("relation_row_id").cast("string")
    s, t = F.col("s_name"), F.col("t_name")
    text = (
        F.when(k == 0, F.concat(F.lit("Что такое "), s, F.lit("?"))).when(k == 1, F.concat(F.lit("Почему "), s, F.lit(" влияет на "), t))
        .when(k == 2, F.concat(F.lit("Сравнение "), s, F.lit(" и "), t, F.lit(" в 2015 году")))
        .when(k == 3, F.concat(s, F.lit(": отечественная практика и мировая практика")))
        .when(k == 4, F.concat(F.lit("Содержание в "), s, F.lit(" не выше ≤ "), n, F.lit(" мг/л")))
        .when(k == 5, F.concat(F.lit("Процесс "), s, F.lit(" от "), n, F.lit(" до 900 мг/л в Россия")))
        .when(k == 6, F.concat(F.lit("pH > 4,5 для "), t)).otherwise(F.concat(s, F.lit(" "), t))
    )
    return e.select("relation_row_id", "s_type", "s_name", "t_type", "t_name", text.alias("question"))


MARKS = ["is_question", "has_geo", "has_temporal", "is_definitional", "is_causal", "is_comparison", "is_geo_comparison", "has_numeric", "token_count"]


def query_markers(spark, d):
    return R.analyzed(questions(spark, d), "question").select("relation_row_id", *MARKS)


def query_numeric_constraint(spark, d):
    a = R.analyzed(questions(spark, d), "question").where("has_numeric")
    return a.select("relation_row_id", "numeric_operator", F.coalesce("numeric_min", F.lit(-1.0)).alias("low"), F.coalesce("numeric_max", F.lit(-1.0)).alias("high"), "numeric_unit")


def query_entities(spark, d):
    return R.seeds(questions(spark, d), "relation_row_id", "question").withColumnRenamed("query_id", "relation_row_id")


def route_decision(spark, d):
    """Scores and route of each question; its graph context is the subject's own relations."""
    return _decided(questions(spark, d), graph._edges(spark, d))


def _decided(questions, e, some=False):
    """Scores and route of the questions over graph edges; with ``some`` only what touches their own subjects is looked at."""
    q = R.analyzed(questions, "question").withColumn("node", node_key("s_type", "s_name"))
    seeds = R.seeds(questions, "relation_row_id", "question").groupBy(F.col("query_id").alias("relation_row_id")).agg(F.count("*").alias("n_seeds"))
    ends = e.select(F.col("s").alias("node"), F.col("t").alias("other"), "confidence", "source_document", "predicate").unionByName(
        e.select(F.col("t").alias("node"), F.col("s").alias("other"), "confidence", "source_document", "predicate")
    )
    if some:
        ends = ends.join(q.select("node").distinct(), "node", "left_semi")
    ctx = ends.groupBy("node").agg(
        F.count("*").alias("n_edges"), (F.count_distinct("other") + 1).alias("n_nodes"), F.count_distinct("source_document").alias("n_sources"),
        F.coalesce(mean("confidence", 6), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.col("predicate") == "contradicts").alias("n_contradictions"),
    )
    full = q.join(seeds, "relation_row_id", "left").join(ctx, "node", "left").na.fill(
        0, ["n_seeds", "n_edges", "n_nodes", "n_sources", "mean_confidence", "n_contradictions"]
    )
    full = full.withColumns({
        "seed_ratio": F.when(F.col("n_edges") > 0, 1.0).otherwise(0.0), "max_hop": F.when(F.col("n_edges") > 0, 1).otherwise(0),
        "n_gaps": F.when((F.col("n_edges") > 0) & (F.col("n_sources") < 2), 1).otherwise(0),
    })
    out = R.decided(R.scores(full))
    return out.select("relation_row_id", "coverage_score", "confidence_score", "ambiguity_score", "route", "route_confidence", "rule")


def structured_filters(spark, d):
    """Filters that a question implies: geography, years and numbers (the clock is the latest extraction)."""
    q = R.analyzed(questions(spark, d), "question")
    now = table(spark, d, "llm_relations").agg(F.year(F.max("extracted_at")).alias("now"))
    low = F.lower("question")
    place = F.when(low.contains("росси") | low.contains("отечествен"), "Russia").when(low.contains("миров") | low.contains("зарубеж"), "Worldwide").otherwise("")
    q = q.crossJoin(F.broadcast(now))
    return q.select(
        "relation_row_id", place.alias("geography"), F.when(F.col("has_temporal"), F.col("now") - 5).otherwise(0).alias("min_year"), F.col("has_numeric").alias("numeric_present")
    )


def rag_filters(spark, d):
    """Entity names and the numeric filter that go to document retrieval."""
    names = query_entities(spark, d).groupBy("relation_row_id").agg(F.array_join(F.array_sort(F.collect_set("canonical")), ";").alias("names"))
    q = query_numeric_constraint(spark, d).withColumnRenamed("numeric_unit", "property_name")
    return names.join(q, "relation_row_id", "left").select(
        "relation_row_id", "names", F.coalesce("property_name", F.lit("")).alias("property_name"), F.coalesce("numeric_operator", F.lit("")).alias("operator")
    )


def extraction_route(spark, d):
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.max_by("text", "ingested_at").alias("text"), F.max_by("natasha", "ingested_at").alias("n"))
    spans = F.aggregate(F.coalesce("n.primary_entities", F.array()), F.lit(0), lambda a, x: a + F.coalesce(x["stop"] - x["start"], F.lit(0)))
    c = c.where("text is not null").select("chunk_id", "text", F.size(F.coalesce("n.primary_entities", F.array())).alias("n_ner"), spans.alias("ner_chars"))
    llm = table(spark, d, "llm_entities").where("extractor <> 'statistical_ner'").groupBy("chunk_id").agg(
        F.count("*").alias("n_llm"), mean("confidence", 6).alias("llm_confidence")
    )
    return R.extraction_route(c.join(llm, "chunk_id", "left").na.fill(0, ["n_llm", "llm_confidence"])).select(
        "chunk_id", "technical_density", "relation_cues", "route", "route_confidence", "reason"
    )


def extraction_fallback(spark, d):
    """What to do after the extraction on record: its entities and relations of each chunk."""
    e = table(spark, d, "llm_entities").select("chunk_id", F.lit(True).alias("e"), "confidence")
    r = table(spark, d, "llm_relations").select("chunk_id", F.lit(False).alias("e"), "confidence")
    got = e.unionByName(r).groupBy("chunk_id").agg(
        F.count_if("e").alias("n_entities"), F.count_if(~F.col("e")).alias("n_relations"), mean("confidence", 6).alias("result_confidence")
    )
    full = extraction_route(spark, d).join(got, "chunk_id", "left").na.fill(0, ["n_entities", "n_relations", "result_confidence"])
    return R.fallback_route(full).select("chunk_id", "next_route", "next_confidence", "fallback_reason")


def answers(spark, d):
    """The rendered answer of every hundredth question, with facts and passages as its route asks."""
    e = facts.edges(spark, d).select("relation_row_id", "source_document", "predicate", "confidence", "s_type", "s_name", "t_type", "t_name")
    e = written(e, scratch_dir(spark, "edges"))
    q = _asked(e.where("relation_row_id % 100 = 0"))
    routes = _decided(q, graph.G.graph_edges(e.withColumn("quote", F.lit(None).cast("string"))), some=True).select("relation_row_id", "route")
    asked = q.join(routes, "relation_row_id").select(F.col("relation_row_id").alias("query_id"), "question", "route")
    asked = written(asked, scratch_dir(spark, "asked"))
    seeds = q.select(F.col("relation_row_id").alias("query_id"), F.col("s_name").alias("name"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return answer.rendered(answer.dispatched(asked, seeds, e, docs))


def query_language(spark, d):
    """Cleaned and matching forms of each question and its scripts."""
    q = questions(spark, d)
    return q.select("relation_row_id", Q.cleaned("question").alias("cleaned"), Q.match_text("question").alias("matching"), *[v.alias(k) for k, v in Q.language("question").items()])


def query_plan(spark, d):
    return Q.planned(questions(spark, d), "relation_row_id", "question", table(spark, d, "synonym_groups"))


QUERIES = {
    f.__name__: f
    for f in (answers, query_language, query_plan, query_markers, query_numeric_constraint, query_entities, route_decision, structured_filters, rag_filters, extraction_route, extraction_fallback)
}

_QS = f"""{EDGES}, qs AS (SELECT *, relation_row_id::VARCHAR AS n, relation_row_id % 8 AS k FROM edges),
q AS (SELECT relation_row_id, s_type, s_name, t_type, t_name, CASE k WHEN 0 THEN 'Что такое ' || s_name || '?' WHEN 1 THEN 'Почему ' || s_name || ' влияет на ' || t_name
  WHEN 2 THEN 'Сравнение ' || s_name || ' и ' || t_name || ' в 2015 году' WHEN 3 THEN s_name || ': отечественная практика и мировая практика'
  WHEN 4 THEN 'Содержание в ' || s_name || ' не выше ≤ ' || n || ' мг/л' WHEN 5 THEN 'Процесс ' || s_name || ' от ' || n || ' до 900 мг/л в Россия'
  WHEN 6 THEN 'pH > 4,5 для ' || t_name ELSE s_name || ' ' || t_name END AS question FROM qs)"""


def _has(p: str) -> str:
    return f"regexp_matches(lower(question) || ' ', '{R.bounded(p)}')"


_NUM = "([0-9]+(?:[.,][0-9]+)?)"
_RNG = f"(?:от|from|между|between) +{_NUM} *(?:до|to|-) *{_NUM} *({R.UNITS})?"
_PH = f"ph *([<>≤≥]=?) *{_NUM}"
_OP = f"(≤|<=|≥|>=|<|>) *{_NUM} *({R.UNITS})?"
_BARE = f"(?:^|[^0-9a-zа-яё.,]){_NUM} *({R.UNITS})"


def _x(p: str, k: int) -> str:
    return f"nullif(regexp_extract(lower(question), '{p}', {k}), '')"


def _v(x: str) -> str:
    return f"try_cast(replace({x}, ',', '.') AS DOUBLE)"


_SIGN = "CASE WHEN {0} IN ('≤', '<=', '≤=') THEN '<=' WHEN {0} IN ('≥', '>=', '≥=') THEN '>=' ELSE {0} END"
_ANALYZED = f"""{_QS}, a0 AS (SELECT *, CASE WHEN regexp_matches(lower(question), '{_RNG}') THEN 'range' WHEN regexp_matches(lower(question), '{_PH}') THEN 'unit_first'
  WHEN regexp_matches(lower(question), '{_OP}') THEN 'operator' WHEN regexp_matches(lower(question), '{_BARE}') THEN 'bare' END AS nk FROM q),
a1 AS (SELECT *, CASE nk WHEN 'range' THEN 'range' WHEN 'bare' THEN '=' WHEN 'unit_first' THEN {_SIGN.format(_x(_PH, 1))} WHEN 'operator' THEN {_SIGN.format(_x(_OP, 1))} END AS op,
  CASE nk WHEN 'unit_first' THEN {_v(_x(_PH, 2))} WHEN 'operator' THEN {_v(_x(_OP, 2))} END AS one FROM a0),
a AS (SELECT relation_row_id, question, s_type, s_name, contains(question, '?') OR {_has(R.QUESTION)} AS is_question, {_has(R.GEO)} OR {_has(R.GEO_COMPARISON)} AS has_geo,
  {_has(R.TEMPORAL)} AS has_temporal, {_has(R.DEFINITIONAL)} AS is_definitional, {_has(R.CAUSAL)} AS is_causal, {_has(R.COMPARISON)} AS is_comparison,
  {_has(R.GEO_COMPARISON)} AS is_geo_comparison, nk IS NOT NULL AS has_numeric, len(regexp_extract_all(question, '{R.WORD}'))::INT AS token_count, op AS numeric_operator,
  coalesce(CASE WHEN nk = 'range' THEN {_v(_x(_RNG, 1))} WHEN nk = 'bare' THEN {_v(_x(_BARE, 1))} WHEN op IN ('>=', '>') THEN one END, -1.0) AS low,
  coalesce(CASE WHEN nk = 'range' THEN {_v(_x(_RNG, 2))} WHEN nk = 'bare' THEN {_v(_x(_BARE, 1))} WHEN op IN ('<=', '<') THEN one END, -1.0) AS high,
  CASE nk WHEN 'range' THEN {_x(_RNG, 3)} WHEN 'unit_first' THEN 'pH' WHEN 'operator' THEN {_x(_OP, 3)} WHEN 'bare' THEN {_x(_BARE, 2)} END AS numeric_unit FROM a1)"""
_STEMS = ", ".join("('{}', '{}', {})".format(*x, i) for i, x in enumerate(R.STEMS))
_SEEDS = f"""stems(stem, label, place) AS (VALUES {_STEMS}), w AS (SELECT relation_row_id, unnest(regexp_extract_all(question, '{R.WORD}')) AS word FROM q),
dm AS (SELECT relation_row_id, word, arg_min(label, place) AS c FROM w JOIN stems ON starts_with(lower(word), stem) GROUP BY 1, 2),
sd AS (SELECT relation_row_id, lower(c) AS canonical, max(conf) AS confidence FROM (SELECT relation_row_id, c, 0.6::DOUBLE AS conf FROM dm
  UNION ALL SELECT relation_row_id, word, 0.55::DOUBLE FROM w WHERE regexp_matches(word, '^[A-ZА-ЯЁ]')) GROUP BY 1, 2)"""

_SPACE = r"[ \t\n\r\f\x0B]+"
_CLEAN = rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(question, '{_SPACE}', ' ', 'g')), ' +([,.;:?!])', '\1', 'g'), '^[.,;: ]+|[.,;: ]+$', '', 'g'))"

_ROUTED = rf"""WITH c0 AS (SELECT chunk_id, arg_max_null(text, ingested_at) AS text, arg_max_null(natasha, ingested_at) AS n FROM chunks GROUP BY 1),
l AS (SELECT chunk_id, count(*) AS n_llm, {mean_sql('confidence', 6)} AS lc FROM llm_entities WHERE extractor <> 'statistical_ner' GROUP BY 1),
c AS (SELECT c0.chunk_id, text, coalesce(len(n.primary_entities), 0) AS n_ner, coalesce(list_sum([coalesce(x.stop - x.start, 0) FOR x IN n.primary_entities]), 0) AS ner_chars,
  coalesce(n_llm, 0) AS n_llm, coalesce(lc, 0) AS lc, round(len(regexp_extract_all(text, '(?i)[0-9]+(?:[,.][0-9]+)?\s*(?:%|°C|г/л|мг/л|м3/ч|А/м2|pH)')) / greatest(length(text), 1), 6) AS technical_density,
  len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ('влияет', 'повышает', 'снижает', 'использует', 'получен', 'проводили', 'зависит', 'подтвержден', 'описан', 'применяется', 'заменяет')))::INT AS relation_cues FROM c0 LEFT JOIN l USING (chunk_id) WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN trim(text) = '' THEN 1 WHEN length(text) <= 350 AND relation_cues = 0 THEN 2 WHEN length(text) >= 4500 THEN 3
  WHEN (technical_density > 0.0015 OR relation_cues >= 2) AND n_ner > 0 THEN 4 WHEN technical_density > 0.0015 OR relation_cues >= 2 THEN 5
  WHEN n_llm > 0 AND lc < 0.55 THEN 6 WHEN n_ner > 0 AND ner_chars / greatest(length(text), 1) < 0.003 THEN 7 WHEN n_ner > 0 AND relation_cues = 0 THEN 8 ELSE 9 END AS k FROM c),
v(k, route, route_confidence, reason) AS (VALUES (1, 'skip', 1.0::DOUBLE, 'empty_chunk'), (2, 'natasha_only', 0.76, 'short_low_relation_signal'), (3, 'ensemble', 0.82, 'long_chunk_requires_llm_semantics'),
  (4, 'ensemble', 0.84, 'technical_or_relation_dense;natasha_seeds_available'), (5, 'llm_only', 0.75, 'technical_or_relation_dense'), (6, 'ensemble', 0.78, 'low_llm_confidence_requires_ensemble'),
  (7, 'llm_only', 0.72, 'sparse_natasha_coverage_requires_llm'), (8, 'natasha_only', 0.70, 'entity_only_chunk'), (9, 'ensemble', 0.68, 'default_semantic_extraction')),
routed AS (SELECT chunk_id, technical_density, relation_cues, route, route_confidence, reason FROM k JOIN v USING (k))
"""

SQL = {
    "query_language": f"""WITH {_QS} SELECT relation_row_id, {_CLEAN} AS cleaned, trim(regexp_replace(translate(lower(question), '{Q.SMALL}', '{Q.PLAIN}'), '{_SPACE}', ' ', 'g')) AS matching,
  regexp_matches(question, '[А-Яа-яЁё]') AS has_cyrillic, regexp_matches(question, '[A-Za-z]') AS has_latin, regexp_matches(question, '[A-Za-z]') AND NOT regexp_matches(question, '[А-Яа-яЁё]') AS is_english FROM q""",
    "query_markers": f"WITH {_ANALYZED} SELECT relation_row_id, {', '.join(MARKS)} FROM a",
    "query_numeric_constraint": f"WITH {_ANALYZED} SELECT relation_row_id, numeric_operator, low, high, numeric_unit FROM a WHERE has_numeric",
    "query_entities": f"WITH {_QS}, {_SEEDS} SELECT * FROM sd",
    "route_decision": f"""WITH {_ANALYZED}, {_SEEDS}, ns AS (SELECT relation_row_id, count(*) AS n_seeds FROM sd GROUP BY 1),
ge AS (SELECT {node('s_type', 's_name')} AS s, {node('t_type', 't_name')} AS t, confidence, source_document, predicate FROM edges),
en AS (SELECT s AS node, t AS other, confidence, source_document, predicate FROM ge WHERE s <> t UNION ALL SELECT t, s, confidence, source_document, predicate FROM ge WHERE s <> t),
cx AS (SELECT node, count(*) AS n_edges, count(DISTINCT other) + 1 AS n_nodes, count(DISTINCT source_document) AS n_sources, coalesce({mean_sql('confidence', 6)}, 0) AS mc,
  count(*) FILTER (predicate = 'contradicts') AS nc FROM en GROUP BY 1),
f AS (SELECT a.*, coalesce(n_seeds, 0) AS n_seeds, coalesce(n_edges, 0) AS n_edges, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_sources, 0) AS n_sources, coalesce(mc, 0) AS mc,
  coalesce(nc, 0) AS nc FROM a LEFT JOIN ns USING (relation_row_id) LEFT JOIN cx ON cx.node = {node('a.s_type', 'a.s_name')}),
g AS (SELECT *, CASE WHEN n_edges > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS sr, CASE WHEN n_edges > 0 AND n_sources < 2 THEN 1 ELSE 0 END AS gaps FROM f),
s AS (SELECT *, round(greatest(0.0, 0.4::DOUBLE * sr + 0.2::DOUBLE * (CASE WHEN n_edges > 0 THEN 0.35::DOUBLE ELSE 0.0 END) + 0.2::DOUBLE * least(1.0::DOUBLE, ln(1 + n_edges / greatest(n_nodes, 1)) / ln(5.0::DOUBLE))
   + 0.1::DOUBLE * least(1.0::DOUBLE, ln(1 + n_sources) / ln(6.0::DOUBLE)) + 0.1::DOUBLE * mc - CASE WHEN nc > 0 THEN 0.1::DOUBLE ELSE 0.0 END), 10) AS coverage_score,
  round(greatest(0.0, 0.65::DOUBLE * mc + 0.35::DOUBLE / (1 + gaps) - CASE WHEN nc > 0 THEN 0.05::DOUBLE ELSE 0.0 END), 10) AS confidence_score,
  round(0.45::DOUBLE * (CASE WHEN token_count <= 1 THEN 1.0::DOUBLE WHEN token_count <= 3 THEN 0.7::DOUBLE WHEN token_count <= 6 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END)
   + 0.35::DOUBLE * (CASE WHEN n_seeds = 0 THEN 0.8::DOUBLE WHEN n_seeds = 1 THEN 0.2::DOUBLE WHEN n_seeds <= 3 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END)
   + 0.2::DOUBLE * (1 - CASE WHEN n_edges >= 5 AND sr >= 0.6 THEN 0.7::DOUBLE WHEN n_edges > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END), 10) AS ambiguity_score FROM g),
r AS (SELECT *, CASE WHEN trim(question) = '' THEN 1 WHEN (token_count < 3 OR n_seeds = 0) AND NOT has_numeric THEN 2 WHEN is_definitional AND n_edges < 2 THEN 3
  WHEN is_geo_comparison AND n_edges > 0 THEN 4 WHEN is_comparison AND n_edges > 0 THEN 5 WHEN is_causal AND n_edges >= 1 THEN 6
  WHEN has_numeric AND n_edges >= 3 AND coverage_score >= 0.62::DOUBLE - 0.1::DOUBLE THEN 7 WHEN n_nodes = 0 AND n_edges = 0 AND n_seeds > 0 THEN 8 WHEN n_nodes = 0 AND n_edges = 0 THEN 9
  WHEN n_edges = 0 THEN 10 WHEN coverage_score >= 0.62 AND confidence_score >= 0.55 AND ambiguity_score <= 0.7 AND nc = 0 THEN 11
  WHEN nc > 0 OR coverage_score < 0.62 THEN 12 ELSE 13 END AS k FROM s),
rules(k, route, route_confidence, rule) AS (VALUES (1, 'no_data', 0.95::DOUBLE, 'empty_query'), (2, 'no_data', 0.95, 'low_signal_query'), (3, 'rag_only', 0.74, 'definitional_query'),
  (4, 'hybrid', 0.78, 'geo_comparison_query'), (5, 'hybrid', 0.76, 'comparison_query'), (6, 'hybrid', 0.75, 'causal_query'), (7, 'graph_only', 0.80, 'numeric_filtered_graph_sufficient'),
  (8, 'rag_only', 0.78, 'seeds_not_in_graph'), (9, 'no_data', 0.95, 'graph_empty'), (10, 'rag_only', 0.72, 'matched_nodes_without_relations'),
  (11, 'graph_only', 0.82, 'graph_only_conditions_met'), (12, 'hybrid', 0.74, 'partial_graph_coverage'), (13, 'rag_only', 0.70, 'below_hybrid_floor'))
SELECT relation_row_id, coverage_score, confidence_score, ambiguity_score, route, route_confidence, rule FROM r JOIN rules USING (k)""",
    "structured_filters": f"""WITH {_ANALYZED} SELECT relation_row_id, CASE WHEN contains(lower(question), 'росси') OR contains(lower(question), 'отечествен') THEN 'Russia'
  WHEN contains(lower(question), 'миров') OR contains(lower(question), 'зарубеж') THEN 'Worldwide' ELSE '' END AS geography,
  CASE WHEN has_temporal THEN (SELECT year(max(extracted_at)) FROM llm_relations) - 5 ELSE 0 END AS min_year, has_numeric AS numeric_present FROM a""",
    "rag_filters": f"""WITH {_ANALYZED}, {_SEEDS}, nm AS (SELECT relation_row_id, array_to_string(list_sort(list(DISTINCT canonical)), ';') AS names FROM sd GROUP BY 1)
SELECT nm.relation_row_id, names, coalesce(numeric_unit, '') AS property_name, coalesce(numeric_operator, '') AS operator FROM nm JOIN a USING (relation_row_id)""",
    "extraction_route": _ROUTED + "SELECT chunk_id, technical_density, relation_cues, route, route_confidence, reason FROM routed",
    "extraction_fallback": _ROUTED + f"""SELECT chunk_id, coalesce(nr, route) AS next_route, coalesce(nc, route_confidence) AS next_confidence, coalesce(fr, '') AS fallback_reason FROM (
SELECT routed.*, CASE k2 WHEN 2 THEN 'llm_only' WHEN 3 THEN 'ensemble' WHEN 4 THEN 'ensemble' END AS nr, CASE k2 WHEN 2 THEN 0.74::DOUBLE WHEN 3 THEN 0.7 WHEN 4 THEN 0.73 END AS nc,
  CASE k2 WHEN 2 THEN 'no_entities_after_primary_route' WHEN 3 THEN 'entities_without_relations' WHEN 4 THEN 'low_confidence_fallback' END AS fr FROM (
SELECT routed.chunk_id, CASE WHEN route = 'skip' THEN 1 WHEN coalesce(ne, 0) = 0 AND route <> 'llm_only' THEN 2 WHEN coalesce(ne, 0) > 0 AND coalesce(nr, 0) = 0 AND route = 'natasha_only' THEN 3
  WHEN coalesce(rc, 0) < 0.55 AND route <> 'ensemble' THEN 4 END AS k2 FROM routed LEFT JOIN (
SELECT chunk_id, count(*) FILTER (e) AS ne, count(*) FILTER (NOT e) AS nr, {mean_sql('confidence', 6)} AS rc FROM (SELECT chunk_id, true AS e, confidence FROM llm_entities UNION ALL
SELECT chunk_id, false, confidence FROM llm_relations) GROUP BY 1) x USING (chunk_id)) k JOIN routed USING (chunk_id))""",
}
