"""Pieces shared by the SQL twins of the queries."""

from __future__ import annotations


def canon(x: str) -> str:
    """SQL twin of functions.text.canonicalize."""
    kept = rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{85}}-]', '', 'g')"
    return rf"trim(regexp_replace({kept}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"


def mean_sql(x: str, digits: int) -> str:
    """SQL twin of functions.text.mean."""
    return f"round(sum(round({x} * 1e9)::BIGINT)::BIGINT / count({x}) / 1e9, {digits})"


def node(t: str, n: str) -> str:
    return rf"{t} || '::' || lower(trim(regexp_replace({n}, '[ \t\n\r\f\x0B]+', ' ', 'g')))"


ENT = """ent AS (
  SELECT entity_row_id, chunk_id, source_document, trim(local_id) AS local_id, trim(type) AS type, trim(canonical_name) AS name,
         mentions, attributes, page, confidence, extractor, needs_review, extracted_at
  FROM llm_entities WHERE retracted_at IS NULL AND trim(type) <> '' AND trim(canonical_name) <> '')"""

EDGES = (
    ENT
    + """,
ids AS (SELECT chunk_id, local_id, arg_min(type, entity_row_id) AS type, arg_min(name, entity_row_id) AS name
        FROM ent WHERE local_id <> '' GROUP BY 1, 2),
edges AS (
  SELECT r.relation_row_id, r.chunk_id, r.source_document, trim(r.predicate) AS predicate, r.quote, r.note, r.confidence, r.extractor,
         r.extracted_at, s.type AS s_type, s.name AS s_name, t.type AS t_type, t.name AS t_name, trim(r.subject) AS s_id, trim(r.object) AS t_id
  FROM llm_relations r JOIN ids s ON r.chunk_id = s.chunk_id AND trim(r.subject) = s.local_id
  JOIN ids t ON r.chunk_id = t.chunk_id AND trim(r.object) = t.local_id WHERE trim(r.predicate) <> '')"""
)

SOURCE = """CASE WHEN lower(coalesce(extractor, '')) LIKE '%natasha%' THEN 'natasha'
  WHEN lower(coalesce(extractor, '')) LIKE '%llm%' OR lower(coalesce(extractor, '')) LIKE '%yandex%' THEN 'yandex_llm'
  WHEN lower(coalesce(extractor, '')) LIKE '%ensemble%' THEN 'ensemble' WHEN coalesce(extractor, '') <> '' THEN extractor ELSE 'unknown' END"""
