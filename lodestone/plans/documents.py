"""Queries on documents, blocks and chunks: parsing, splitting, values, glossary, conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking, extraction, glossary, measurements
from lodestone.plans import facts
from lodestone.plans.facts import UNIT_ALIASES
from lodestone.plans.sql import canon
from lodestone.session import spread, table
from lodestone.sources import documents as S

# Operator words and signs.
OPERATORS = {
    "≤": "<=", "≥": ">=", "=>": ">=", "≈": "~", "~": "~", "не более": "<=", "не выше": "<=", "не превышает": "<=", "не превышать": "<=", "до": "<=",
    "менее": "<", "ниже": "<", "не менее": ">=", "не ниже": ">=", "от": ">=", "более": ">", "выше": ">", "около": "~", "примерно": "~", "порядка": "~",
}


def _blocks(spark, d):
    return table(spark, d, "parsed_blocks")


def _latest_chunks(spark, d):
    return spread(table(spark, d, "chunks").groupBy("chunk_id").agg(F.max_by("text", "ingested_at").alias("text")).where("text is not null"))


def block_markdown(spark, d):
    md = S.block_markdown("kind", "content", "level", "table_rows", "image_id", "caption")
    b = _blocks(spark, d).select("block_id", "parsed_at", "kind", md.alias("md"))
    return b.where("md is not null").select("block_id", "parsed_at", "kind", F.length("md").alias("n_chars"), F.md5(F.col("md").cast("binary")).alias("digest"))


def markdown_lines(spark, d):
    line = F.explode(F.split("text", "\n")).alias("line")
    rows = _latest_chunks(spark, d).select("chunk_id", line)
    kind = (
        F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s+\S"), "heading").when(F.trim("line").startswith("|"), "table")
        .when(F.trim("line").startswith("[IMAGE_"), "image").otherwise("text")
    )
    return rows.groupBy("chunk_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def front_matter(spark, d):
    """Documents given a head with their fields, and read back from it."""
    head = F.concat(F.lit("---\nsource: "), "source", F.lit("\nkind: "), F.coalesce("doc_type", F.lit("none")), F.lit("\n---\n"), "text")
    n, keys = S.front_matter("doc")
    t = table(spark, d, "documents").select("doc_id", head.alias("doc"))
    return t.select("doc_id", n.alias("offset"), F.element_at(keys, "source").alias("source"), F.element_at(keys, "kind").alias("kind"))


def sentences(spark, d):
    parts = F.regexp_extract_all("text", F.lit(r"[^.!?…]*[.!?…]+|[^.!?…\s][^.!?…]*$"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("bigint").alias("n_sentences"))


def chunk_documents(spark, d):
    return chunking.chunked(table(spark, d, "documents"), "doc_id", "text")


def chunk_cover(spark, d):
    """The texts put together again from their chunks, without blanks."""
    return chunking.cover(chunk_documents(spark, d))


def chunk_report(spark, d):
    return _blocks(spark, d).groupBy("doc_type", "kind").agg(
        F.count("*").alias("n_blocks"), F.count_distinct("source_file").alias("n_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars")
    )


def text_yield_flags(spark, d):
    b = _blocks(spark, d).where("unit is not null and content is not null")
    odd = F.length(F.regexp_replace("content", r"[\p{L}\p{N}\p{P}\p{Z}\s]", ""))
    return b.groupBy("source_file").agg(
        F.count_distinct("unit").alias("n_units"), F.round(F.sum(F.length("content")) / F.count_distinct("unit"), 4).alias("chars_per_unit"),
        F.round(F.sum(odd) / F.sum(F.length("content")), 8).alias("odd_share"),
    )


def image_references(spark, d):
    """Pictures of blocks without a caption, and files by their pictures."""
    return _blocks(spark, d).where("kind = 'image'").groupBy("source_file").agg(
        F.count_distinct("image_id").alias("n_images"), F.count_if(F.coalesce(F.trim("caption"), F.lit("")) == "").alias("n_without_caption")
    )


def signature_gate(spark, d):
    """Signatures of block contents as files: by the block's number its text stands alone, behind its format's own first bytes,
    behind a picture's, or as a page."""
    b = _blocks(spark, d).where("content is not null")
    head = lambda h: F.unhex(F.lit(h))
    begin = (
        F.when(F.col("block_id") % 4 == 1, F.when(F.col("doc_type") == "pdf", head("255044462D")).otherwise(head("504B030414")))
        .when(F.col("block_id") % 4 == 2, head("89504E470D0A")).when(F.col("block_id") % 4 == 3, head("0A3C48746D6C3E")).otherwise(head(""))
    )
    kind = S.signature(F.concat(begin, F.encode("content", "UTF-8")), F.regexp_extract("source_file", r"\.([a-z]+)$", 1))
    return b.groupBy("doc_type", kind.alias("signature")).agg(F.count("*").alias("n"))


def safe_paths(spark, d):
    return _blocks(spark, d).select("source_file").distinct().select("source_file", S.safe_path(F.regexp_extract("source_file", r"([^/]+)$", 1)).alias("safe"))


def numeric_simple(spark, d):
    v = _latest_chunks(spark, d).select(F.explode(measurements.simple_values("text")).alias("m"))
    unit = F.regexp_extract("m", measurements.SIMPLE, 2)
    return v.groupBy(unit.alias("unit")).agg(
        F.count("*").alias("n"), F.round(F.max(F.replace(F.regexp_extract("m", measurements.SIMPLE, 1), F.lit(","), F.lit(".")).cast("double")), 4).alias("largest")
    )


def value_labels(spark, d):
    """The values of each chunk in one line."""
    return _latest_chunks(spark, d).select("chunk_id", measurements.labels(measurements.simple_values("text")).alias("label"))


def short_quotes(spark, d):
    """What stands around the first mention of each entity in its chunk."""
    e = facts.entities(spark, d).select("entity_row_id", "chunk_id", F.coalesce(F.get("mentions", F.lit(0)), "name").alias("mention"))
    return e.join(_latest_chunks(spark, d), "chunk_id").select("entity_row_id", extraction.short_quote(F.col("text"), F.col("mention")).alias("quote"))


def numeric_expressions(spark, d):
    return measurements.extracted(_latest_chunks(spark, d), "chunk_id", "text")


def unit_normalize(spark, d):
    u = F.trim(F.try_element_at("attributes", F.lit("unit")))
    alias = F.create_map(*[F.lit(x) for p in UNIT_ALIASES.items() for x in p])
    return facts.entities(spark, d).select(u.alias("u")).where("u <> ''").groupBy(F.coalesce(F.try_element_at(alias, F.col("u")), "u").alias("unit")).agg(F.count("*").alias("n"))


def operator_normalize(spark, d):
    """Operators of value texts: the longest operator word or sign that begins the text."""
    raw = F.lower(F.trim(F.try_element_at("attributes", F.lit("value_raw"))))
    rows = facts.entities(spark, d).select(raw.alias("raw")).where("raw <> ''")
    op = F.lit("=")
    for word, sign in sorted(OPERATORS.items(), key=lambda x: len(x[0])):
        op = F.when(F.col("raw").startswith(word), sign).otherwise(op)
    return rows.groupBy(op.alias("operator")).agg(F.count("*").alias("n"))


def glossary_match(spark, d):
    return glossary.matches(_latest_chunks(spark, d), "chunk_id", "text", glossary.terms(table(spark, d, "synonym_groups"))).select(
        F.col("key").alias("chunk_id"), "canonical_id", "alias"
    ).groupBy("chunk_id", "canonical_id").agg(F.count_distinct("alias").alias("n_aliases"))


def nonoverlap_spans(spark, d):
    found = glossary.matches(_latest_chunks(spark, d), "chunk_id", "text", glossary.terms(table(spark, d, "synonym_groups")))
    return glossary.without_overlaps(found)


def synonym_candidates(spark, d):
    """Definitions in the chunks, and in the glossary's own entries written as such."""
    g = table(spark, d, "synonym_groups").select("canonical_id", "canonical_name", F.explode("aliases").alias("x")).where("trim(x) <> ''")
    written_out = F.array(
        F.concat(F.col("canonical_name"), F.lit(" ("), F.upper("x"), F.lit(")")), F.concat("canonical_name", F.lit(" / "), "x"), F.concat(F.upper("x"), F.lit(" - "), F.col("canonical_name"))
    )
    texts = _latest_chunks(spark, d).unionByName(g.select(F.col("canonical_id").alias("chunk_id"), F.explode(written_out).alias("text")))
    return glossary.candidates(texts, "chunk_id", "text")


def alias_pairs(spark, d):
    return glossary.alias_pairs(facts.entities(spark, d), "source_document", "mentions")


def mock_extraction(spark, d):
    found = _latest_chunks(spark, d).select("chunk_id", F.inline(extraction.stand_in("text")))
    return found.groupBy("keyword", "type").agg(F.count("*").alias("n_chunks"))


def _answers(spark, d):
    """Each chunk's extraction as a model's answer: JSON inside a fenced block inside prose."""
    e = table(spark, d, "llm_entities").groupBy("chunk_id").agg(
        F.collect_list(F.struct("local_id", "type", "canonical_name", "mentions", "attributes")).alias("entities"), F.min("source_document").alias("doc_id")
    )
    r = table(spark, d, "llm_relations").groupBy("chunk_id").agg(F.collect_list(F.struct("subject", "predicate", "object", "quote", "note")).alias("relations"))
    text = F.concat(F.lit("Ответ модели:\n```json\n"), F.to_json(F.struct("entities", "relations")), F.lit("\n```\nКонец."))
    return e.join(r, "chunk_id", "left").select("chunk_id", "doc_id", F.lit("OK").alias("status"), text.alias("text"))


def convert_results(spark, d):
    return extraction.converted(extraction.parsed(_answers(spark, d), "text"))


def json_recover(spark, d):
    t = _answers(spark, d).select("chunk_id", extraction.recovered_json("text").alias("j"))
    return t.select("chunk_id", F.json_array_length(F.get_json_object("j", "$.entities")).alias("n_entities"))


def mention_check(spark, d):
    out = extraction.mention_issues(facts.entities(spark, d), table(spark, d, "chunks"))
    return out.groupBy("entity_row_id").agg(F.count("*").alias("n_missing"))


QUERIES = {
    f.__name__: f
    for f in (
        block_markdown, markdown_lines, front_matter, sentences, chunk_documents, chunk_cover, chunk_report, text_yield_flags, image_references, signature_gate,
        safe_paths, numeric_simple, value_labels, short_quotes, numeric_expressions, unit_normalize, operator_normalize, glossary_match, nonoverlap_spans, synonym_candidates, alias_pairs,
        mock_extraction, convert_results, json_recover, mention_check,
    )
}

_LC = "c AS (SELECT * FROM (SELECT chunk_id, arg_max_null(text, ingested_at) AS text FROM chunks GROUP BY 1) WHERE text IS NOT NULL)"
_ROW = "'| ' || array_to_string([coalesce(x, '') FOR x IN {}], ' | ') || ' |'"
_MD = f"""CASE kind WHEN 'heading' THEN repeat('#', least(greatest(coalesce(level, 1), 1), 6)) || ' ' || trim(content)
 WHEN 'table' THEN CASE WHEN len(table_rows) > 0 THEN rtrim({_ROW.format('table_rows[1]')} || chr(10) || '| ' || array_to_string(['---' FOR x IN table_rows[1]], ' | ') || ' |' || chr(10)
   || array_to_string(['| ' || array_to_string([coalesce(x, '') FOR x IN r], ' | ') || ' |' FOR r IN table_rows[2:]], chr(10)), chr(10)) END
 WHEN 'image' THEN '[' || coalesce(image_id, 'IMAGE') || ']' || coalesce(' ' || nullif(trim(caption), ''), '') ELSE trim(content) END"""
_OPS = "CASE " + " ".join(f"WHEN starts_with(raw, '{w}') THEN '{s}'" for w, s in sorted(OPERATORS.items(), key=lambda x: -len(x[0]))) + " ELSE '=' END"
_ENT1 = "ent AS (SELECT * FROM llm_entities WHERE retracted_at IS NULL AND trim(type) <> '' AND trim(canonical_name) <> '')"
_FLAT = r"lower(trim(regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g')))"

SQL = {
    "block_markdown": f"WITH m AS (SELECT block_id, parsed_at, kind, {_MD} AS md FROM parsed_blocks) SELECT block_id, parsed_at, kind, length(md) AS n_chars, md5(md) AS digest FROM m WHERE md IS NOT NULL",
    "markdown_lines": rf"""WITH {_LC}, l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM c)
SELECT chunk_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 'heading' WHEN starts_with(trim(line), '|') THEN 'table'
  WHEN starts_with(trim(line), '[IMAGE_') THEN 'image' ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY 1, 2""",
    "front_matter": "SELECT doc_id, 4 + 8 + length(source) + 1 + 6 + length(coalesce(doc_type, 'none')) + 1 + 4 AS \"offset\", source, coalesce(doc_type, 'none') AS kind FROM documents",
    "sentences": r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?…]*[.!?…]+|[^.!?…\s][^.!?…]*$'), lambda x: trim(x) <> '')) AS n_sentences FROM documents",
    "chunk_cover": r"""WITH s AS (SELECT doc_id::VARCHAR AS doc_id, regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g') AS solid FROM documents)
SELECT doc_id, length(solid)::INT AS n_solid, md5(solid) AS digest FROM s WHERE solid <> ''""",
    "chunk_report": "SELECT doc_type, kind, count(*) AS n_blocks, count(DISTINCT source_file) AS n_files, coalesce(sum(length(content)), 0)::BIGINT AS n_chars FROM parsed_blocks GROUP BY 1, 2",
    "text_yield_flags": r"""SELECT source_file, count(DISTINCT unit) AS n_units, round(sum(length(content)) / count(DISTINCT unit), 4) AS chars_per_unit,
  round(sum(length(regexp_replace(content, '[\p{L}\p{N}\p{P}\p{Z}\s\x0B]', '', 'g'))) / sum(length(content)), 8) AS odd_share FROM parsed_blocks WHERE unit IS NOT NULL AND content IS NOT NULL GROUP BY 1""",
    "image_references": "SELECT source_file, count(DISTINCT image_id) AS n_images, count(*) FILTER (coalesce(trim(caption), '') = '') AS n_without_caption FROM parsed_blocks WHERE kind = 'image' GROUP BY 1",
    "signature_gate": """SELECT doc_type, CASE block_id % 4 WHEN 1 THEN CASE WHEN doc_type IN ('pdf', 'docx', 'pptx') THEN 'match' ELSE 'unknown' END WHEN 2 THEN 'image' WHEN 3 THEN 'html'
  ELSE CASE WHEN starts_with(content, 'BM') THEN 'image' ELSE 'unknown' END END AS signature, count(*) AS n FROM parsed_blocks WHERE content IS NOT NULL GROUP BY 1, 2""",
    "safe_paths": r"""SELECT DISTINCT source_file, CASE WHEN regexp_replace(regexp_replace(regexp_extract(source_file, '([^/]+)$', 1), '[<>:"\\|?*]', '_', 'g'), '[. ]+$', '') = '' THEN '_'
  ELSE regexp_replace(regexp_replace(regexp_extract(source_file, '([^/]+)$', 1), '[<>:"\\|?*]', '_', 'g'), '[. ]+$', '') END AS safe FROM parsed_blocks""",
    "numeric_simple": f"""WITH {_LC}, m AS (SELECT unnest(regexp_extract_all(text, '{measurements.SIMPLE}')) AS m FROM c)
SELECT regexp_extract(m, '{measurements.SIMPLE}', 2) AS unit, count(*) AS n, round(max(replace(regexp_extract(m, '{measurements.SIMPLE}', 1), ',', '.')::DOUBLE), 4) AS largest FROM m GROUP BY 1""",
    "value_labels": f"""WITH {_LC}, v AS (SELECT chunk_id, regexp_extract_all(text, '{measurements.SIMPLE}') AS v FROM c), u AS (SELECT *, list_filter(v, lambda x, i: list_position(v, x) = i)[:16] AS u FROM v)
SELECT chunk_id, CASE WHEN len(v) = 0 THEN '—' ELSE array_to_string(u, '; ') || CASE WHEN len(v) > len(u) THEN '; ... +' || (len(v) - len(u)) ELSE '' END END AS label FROM u""",
    "short_quotes": f"""WITH {_ENT1}, {_LC}, m AS (SELECT entity_row_id, text, instr(lower(text), lower(coalesce(mentions[1], trim(canonical_name)))) AS pos FROM ent JOIN c USING (chunk_id))
SELECT entity_row_id, trim(substr(text, CASE WHEN pos > 80 THEN pos - 80 ELSE 1 END, 240)) AS quote FROM m""",
    "unit_normalize": f"""WITH {_ENT1}, u AS (SELECT trim(attributes['unit']) AS u FROM ent), a(u, v) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in UNIT_ALIASES.items())})
SELECT coalesce(v, u.u) AS unit, count(*) AS n FROM u LEFT JOIN a ON a.u = u.u WHERE u.u <> '' GROUP BY 1""",
    "operator_normalize": f"WITH {_ENT1}, r AS (SELECT lower(trim(attributes['value_raw'])) AS raw FROM ent) SELECT {_OPS} AS operator, count(*) AS n FROM r WHERE raw <> '' GROUP BY 1",
    "glossary_match": f"""WITH {_LC}, g AS (SELECT canonical_id, unnest(list_append(aliases, canonical_name)) AS a FROM synonym_groups), t AS (SELECT DISTINCT canonical_id, {canon('a')} AS alias FROM g),
x AS (SELECT chunk_id, ' ' || {canon('text')} || ' ' AS body FROM c) SELECT chunk_id, canonical_id, count(DISTINCT alias) AS n_aliases FROM x JOIN t ON contains(body, ' ' || alias || ' ') WHERE alias <> '' GROUP BY 1, 2""",
    "synonym_candidates": rf"""WITH {_LC}, g AS (SELECT canonical_id, canonical_name, unnest(aliases) AS x FROM synonym_groups),
t AS (SELECT chunk_id AS key, text AS t FROM c UNION ALL SELECT canonical_id, unnest([canonical_name || ' (' || upper(x) || ')', canonical_name || ' / ' || x, upper(x) || ' - ' || canonical_name]) FROM g WHERE trim(x) <> ''),
f(form, p) AS (VALUES ('abbreviation', '([А-Яа-яA-Za-zЁё][А-Яа-яA-Za-zЁё0-9 ,-]{{6,80}}) *[(]([A-ZА-ЯЁ]{{2,12}}|[A-ZА-ЯЁ][A-ZА-ЯЁ0-9-]{{1,15}})[)]'),
  ('slash', '([А-Яа-яЁё][А-Яа-яЁё0-9 ,-]{{3,60}}) */ *([A-Za-z][A-Za-z0-9 ,-]{{3,60}})'), ('dash', '([A-ZА-ЯЁ]{{2,12}}) *[—–-] *([А-Яа-яA-Za-zЁё][А-Яа-яA-Za-zЁё0-9 ,-]{{6,80}})')),
m AS (SELECT key, left(t, 300) AS context, 'abbreviation' AS form, unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'abbreviation'), 1)) AS x, unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'abbreviation'), 2)) AS y FROM t
  UNION ALL SELECT key, left(t, 300), 'slash', unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'slash'), 1)), unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'slash'), 2)) FROM t
  UNION ALL SELECT key, left(t, 300), 'dash', unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'dash'), 1)), unnest(regexp_extract_all(t, (SELECT p FROM f WHERE form = 'dash'), 2)) FROM t),
n AS (SELECT key, context, form, trim(regexp_replace(lower(x), ' +', ' ', 'g'), ' ,.;:()[]{{}}') AS x, trim(regexp_replace(lower(y), ' +', ' ', 'g'), ' ,.;:()[]{{}}') AS y FROM m),
k AS (SELECT key, context, form, least(x, y) AS a, greatest(x, y) AS b FROM n),
w AS (SELECT * FROM k WHERE NOT regexp_matches(a || '|' || b, 'таблица|рисунок|figure|table|образец|sample|приложение|источник') AND length(a) > 1 AND length(b) > 1
  AND length(regexp_replace(a, '[^0-9]', '', 'g')) <= greatest(3, length(a) // 3) AND length(regexp_replace(b, '[^0-9]', '', 'g')) <= greatest(3, length(b) // 3)),
s AS (SELECT a, b, list(key || ': ' || context ORDER BY key)[:3] AS examples FROM (SELECT a, b, key, min(context) AS context FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT w.a, w.b, min(form) AS form, count(*) AS n, count(DISTINCT key) AS n_texts, any_value(examples) AS examples, rank() OVER (ORDER BY count(*) DESC) AS rank FROM w JOIN s ON w.a = s.a AND w.b = s.b GROUP BY 1, 2""",
    "alias_pairs": f"""WITH {_ENT1}, m AS (SELECT entity_row_id, source_document AS k, unnest(list_distinct([lower(trim(x)) FOR x IN mentions])) AS w FROM ent)
SELECT x.w AS a, y.w AS b, count(*) AS n, count(DISTINCT x.k) AS n_keys FROM m x JOIN m y ON x.entity_row_id = y.entity_row_id AND x.w < y.w WHERE x.w <> '' GROUP BY 1, 2""",
    "mock_extraction": f"WITH {_LC} " + " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, '{t}' AS type, count(*) AS n_chunks FROM c WHERE contains(lower(text), '{k}') HAVING count(*) > 0" for k, t in extraction.KEYWORDS.items()
    ),
    "convert_results": """WITH e AS (SELECT chunk_id, trim(local_id) AS l, coalesce(trim(local_id), '') <> '' AND coalesce(trim(canonical_name), '') <> '' AS ok, source_document FROM llm_entities WHERE chunk_id IS NOT NULL),
k AS (SELECT DISTINCT chunk_id, l FROM e WHERE ok), n AS (SELECT chunk_id, count(*) FILTER (ok) AS n_entities, count(*) FILTER (NOT ok) AS n_bad_entities FROM e GROUP BY 1),
r AS (SELECT r.chunk_id, EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND k.l = trim(r.subject)) AND EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND k.l = trim(r.object)) AS ok FROM llm_relations r),
m AS (SELECT chunk_id, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS b FROM r GROUP BY 1)
SELECT n.chunk_id, n_entities::INT AS n_entities, n_bad_entities::INT AS n_bad_entities, coalesce(a, 0)::INT AS n_relations, coalesce(b, 0)::INT AS n_bad_relations FROM n LEFT JOIN m USING (chunk_id)""",
    "json_recover": "SELECT chunk_id, count(*)::INT AS n_entities FROM llm_entities GROUP BY 1",
    "mention_check": f"""WITH {_ENT1}, t AS (SELECT chunk_id, arg_max_null(text, ingested_at) AS text FROM chunks GROUP BY 1), m AS (SELECT entity_row_id, chunk_id, unnest(mentions) AS mention FROM ent)
SELECT entity_row_id, count(*) AS n_missing FROM m JOIN t USING (chunk_id) WHERE trim(mention) <> '' AND NOT contains({_FLAT.format('text')}, {_FLAT.format('mention')}) GROUP BY 1""",
}
