"""Search queries. Questions are the rows whose id is divisible by 100; every row is searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.plans.facts import edges
from lodestone.plans.sql import EDGES
from lodestone.session import kept, parallel, scratch_dir, table, written


def _docs(spark, d):
    return parallel(table(spark, d, "documents").select("doc_id", "text", "title", "source", "lang", "doc_type"))


def _index(spark, d, binary=False):
    """The stored index of all documents: built with the first ranking over a data folder, read by every later one."""
    name, source = f"bags{'-binary' if binary else ''}", f"{d}/documents.parquet"
    whole = S.indexed(kept(spark, name, source, lambda: S.bags(_docs(spark, d), "doc_id", S.tokenize("text"), binary)))
    return S.Index(whole.bags, kept(spark, f"{name}-frequencies", source, lambda: whole.terms), kept(spark, f"{name}-totals", source, lambda: whole.totals))


def search_index(spark, d):
    """Builds the index where it isn't there, and tells its size."""
    i = _index(spark, d)
    n = i.bags.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("bigint").alias("n_postings"), F.sum("dl").alias("n_tokens"))
    return i.totals.select("n_docs").crossJoin(n).crossJoin(i.terms.agg(F.count("*").alias("n_terms"), F.max("df").alias("largest_df")))


def _questions(spark, d):
    q = _docs(spark, d).where("doc_id % 100 = 0 and title is not null")
    return q.select(F.col("doc_id").alias("query_id"), F.explode(S.tokenize("title")).alias("term"))


def tokenize_counts(spark, d):
    t = _docs(spark, d).select(F.explode(S.tokenize("text")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


def bm25_topk(spark, d):
    return S.bm25_top_k(_questions(spark, d), _index(spark, d), 10)


def bm25_okapi_topk(spark, d):
    return S.bm25_top_k(_questions(spark, d), _index(spark, d), 10, idf="okapi")


def binary_tf_bm25(spark, d):
    return S.bm25_top_k(_questions(spark, d), _index(spark, d, binary=True), 10, idf="okapi")


def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return S.dense_top_k(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), 10)


def rrf_hybrid(spark, d):
    """Both legs rank the documents: by their words and by vectors of their hashed words."""
    index = _index(spark, d)
    lexical = S.bm25_top_k(_questions(spark, d), index, 50)
    v = written(S.hashed_vectors(index.bags), scratch_dir(spark, "vectors"))
    dense = S.dense_top_k(v, "doc_id", "v", v.where("doc_id % 100 = 0"), 50)
    return S.top_k(S.rrf([lexical, dense]), 10)


def edge_documents(spark, d):
    return S.edge_documents(edges(spark, d)).select("doc_id", "text")


def _edge_index(spark, d):
    """Edges, the terms of every hundredth's subject, and the index of their texts; the names at their ends stay beside the bags."""
    e = written(S.edge_documents(edges(spark, d)), scratch_dir(spark, "edges"))
    q = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(S.tokenize("s_name")).alias("term"))
    ends = e.withColumn("ends", F.array(F.struct(F.lower("s_name").alias("a"), F.lower("t_name").alias("b"))))
    return e, q, S.indexed(written(S.bags(ends, "doc_id", S.tokenize("text"), keep="ends"), scratch_dir(spark, "bags")))


def edge_search(spark, d):
    _, q, index = _edge_index(spark, d)
    return S.bm25_top_k(q, index, 10)


def edge_search_padded(spark, d):
    """Ten edges for every question, those without a score last."""
    e, q, index = _edge_index(spark, d)
    return S.padded_top_k(S.bm25_top_k(q, index, 10), e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id")), e, 10)


def edge_search_seed_boost(spark, d):
    """Edges that touch the question's seed entity get 0.2 more."""
    e, q, index = _edge_index(spark, d)
    seed = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.lower("s_name").alias("seed"))
    return S.bm25_top_k(q, index, 10, seeds=seed)


def snippets_titles(spark, d):
    c = table(spark, d, "chunks")
    return c.select(
        "chunk_id", "ingested_at", S.snippet("text").alias("snippet"), S.title("provenance.source_document", "provenance.heading_path").alias("title")
    )


def embedding_texts(spark, d):
    c = table(spark, d, "chunks")
    head = F.array_join("provenance.heading_path", " > ")
    text = F.concat(F.lit("passage: Документ: "), "provenance.source_document", F.lit("\nРаздел: "), head, F.lit("\nТекст: "), "text")
    return c.select("chunk_id", "ingested_at", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


def short_text_filter(spark, d):
    c = table(spark, d, "chunks").where(F.length(F.trim("text")) >= 80)
    return c.groupBy("provenance.source_document").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def truncated_context(spark, d):
    x = S.truncate_middle(F.col("text"), 600)
    return _docs(spark, d).select("doc_id", F.length(x).alias("n_chars"), F.left(x, F.lit(320)).alias("head"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, search_index, bm25_topk, bm25_okapi_topk, binary_tf_bm25, dense_topk, rrf_hybrid, edge_documents, edge_search, edge_search_padded,
        edge_search_seed_boost, snippets_titles, embedding_texts, short_text_filter, truncated_context,
    )
}

_TOK = f"regexp_extract_all(lower({{}}), '{S.WORD}')"


def _bm25(docs: str, questions: str, idf: str = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))", binary: bool = False, floor: bool = False) -> str:
    tok = _TOK.format("text")
    tok = f"list_distinct({tok})" if binary else tok
    rule = "CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM t0) ELSE raw END" if floor else "raw"
    return f"""posting AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok}) AS term FROM {docs}) GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS dl FROM posting GROUP BY 1), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
t0 AS (SELECT term, {idf} AS raw FROM (SELECT term, count(*) AS df FROM posting GROUP BY 1), st), t AS (SELECT term, {rule} AS idf FROM t0),
q AS (SELECT query_id, term, count(*) AS qtf FROM ({questions}) GROUP BY 1, 2),
scores AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 4) AS score
  FROM posting JOIN q USING (term) JOIN t USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)"""


def _top(scores: str, k: int = 10) -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scores}) WHERE rank <= {k}"""


_Q = f"SELECT doc_id AS query_id, unnest({_TOK.format('title')}) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL"
_OKAPI = "ln((n_docs - df + 0.5) / (df + 0.5))"
_DENSE = """dense AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""
_EDGE = f"""{EDGES}, edocs AS (SELECT relation_row_id AS doc_id, s_name, t_name, concat_ws(' ', '[' || s_type || '] ' || s_name, '--' || predicate || '-->',
  '[' || t_type || '] ' || t_name, '.', nullif(trim(quote), ''), nullif(trim(source_document), '')) AS text FROM edges),
{_bm25('edocs', f"SELECT doc_id AS query_id, unnest({_TOK.format('s_name')}) AS term FROM edocs WHERE doc_id % 100 = 0")}"""
_WS = r"trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_TITLE = "CASE WHEN array_to_string(provenance.heading_path, ' > ') <> '' THEN provenance.source_document || ' | ' || array_to_string(provenance.heading_path, ' > ') ELSE provenance.source_document END"
_PASSAGE = "'passage: Документ: ' || provenance.source_document || chr(10) || 'Раздел: ' || array_to_string(provenance.heading_path, ' > ') || chr(10) || 'Текст: ' || text"

SQL = {
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1",
    "bm25_topk": f"WITH {_bm25('documents', _Q)} {_top('scores')}",
    "bm25_okapi_topk": f"WITH {_bm25('documents', _Q, _OKAPI, floor=True)} {_top('scores')}",
    "binary_tf_bm25": f"WITH {_bm25('documents', _Q, _OKAPI, binary=True, floor=True)} {_top('scores')}",
    "dense_topk": f"WITH {_DENSE} {_top('dense')}",
    "search_index": f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2)
SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens, count(DISTINCT term) AS n_terms, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY term)) AS largest_df FROM p""",
    "rrf_hybrid": f"""WITH {_bm25('documents', _Q)}, h AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS place, sum(tf)::DOUBLE AS n FROM posting GROUP BY 1, 2),
nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1), dense AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.n * b.n) / any_value(x.norm * y.norm), 4) AS score
  FROM h a JOIN h b ON a.place = b.place JOIN nm x ON x.doc_id = a.doc_id JOIN nm y ON y.doc_id = b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY 1, 2), legs AS ({_top('scores', 50)} UNION ALL {_top('dense', 50)}),
fused AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM legs GROUP BY 1, 2) {_top('fused')}""",
    "edge_documents": f"WITH {_EDGE} SELECT doc_id, text FROM edocs",
    "edge_search": f"WITH {_EDGE} {_top('scores')}",
    "edge_search_padded": f"""WITH {_EDGE}, qq AS (SELECT DISTINCT doc_id AS query_id FROM edocs WHERE doc_id % 100 = 0),
every AS (SELECT qq.query_id, e.doc_id, coalesce(s.score, 0.0)::DOUBLE AS score FROM qq CROSS JOIN edocs e LEFT JOIN scores s ON s.query_id = qq.query_id AND s.doc_id = e.doc_id) {_top('every')}""",
    "edge_search_seed_boost": f"""WITH {_EDGE}, boosted AS (SELECT s.query_id, s.doc_id, round(s.score +
  CASE WHEN lower(e.s_name) = lower(x.s_name) OR lower(e.t_name) = lower(x.s_name) THEN 0.2 ELSE 0.0 END, 4) AS score
  FROM scores s JOIN edocs x ON x.doc_id = s.query_id JOIN edocs e ON e.doc_id = s.doc_id) {_top('boosted')}""",
    "snippets_titles": f"SELECT chunk_id, ingested_at, CASE WHEN length({_WS}) > 700 THEN rtrim(substr({_WS}, 1, 700)) || '...' ELSE {_WS} END AS snippet, {_TITLE} AS title FROM chunks",
    "embedding_texts": f"SELECT chunk_id, ingested_at, length({_PASSAGE}) AS n_chars, md5({_PASSAGE}) AS digest FROM chunks",
    "short_text_filter": "SELECT provenance.source_document AS source_document, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM chunks WHERE length(trim(text)) >= 80 GROUP BY 1",
    "truncated_context": """SELECT doc_id, length(x) AS n_chars, left(x, 320) AS head FROM (SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE
  left(text, 300) || chr(10) || '[... ' || (length(text) - 600) || ' chars truncated ...]' || chr(10) || right(text, 300) END AS x FROM documents)""",
}
