"""Graph queries: filters, seeds, trails, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import mean
from lodestone.operators import graph as G
from lodestone.operators.entities import node_key, upsert_nodes
from lodestone.operators.search import tokenize
from lodestone.plans import facts
from lodestone.plans.sql import EDGES, ENT, mean_sql, node
from lodestone.session import table


def _edges(spark, d):
    return G.graph_edges(facts.edges(spark, d))


def _seeds(spark, d):
    g = table(spark, d, "synonym_groups").where("type = 'Facility'")
    return g.select(node_key("type", "canonical_name").alias("seed")).distinct()


def entities_by_name(spark, d):
    names = table(spark, d, "synonym_groups").select(F.lower("canonical_name").alias("key")).distinct()
    n = upsert_nodes(facts.entities(spark, d)).withColumn("key", F.lower("name"))
    return n.join(names, "key", "left_semi").select("label", "name", "n_documents", "n_rows")


def _geo(spark, d):
    e = facts.entities(spark, d)
    geo = e.where("type = 'Geography'").select("chunk_id", F.lower("name").alias("place"))
    return e.where("type <> 'Geography'").select("chunk_id", "type", "name"), geo


def by_geography(spark, d):
    e, geo = _geo(spark, d)
    return e.join(geo, "chunk_id").groupBy("place", "type").agg(F.count_distinct("name").alias("n_names"))


def _years(spark, d):
    e = facts.entities(spark, d)
    y = e.where("type = 'Year'").select("chunk_id", F.regexp_extract("name", r"(1[89]|20)\d\d", 0).try_cast("int").alias("year"))
    return e.where("type <> 'Year'").select("chunk_id", "type", "name").join(y.where("year is not null").distinct(), "chunk_id")


def by_year_range(spark, d):
    return G.year_filter(_years(spark, d), 2005, 2015).groupBy("year", "type").agg(F.count_distinct("name").alias("n_names"))


def _numbers(spark, d):
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    e = facts.entities(spark, d)
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    value = number(F.coalesce(get("value"), get("numeric_value")))
    return e.select(
        "entity_row_id", "type", "name", value.alias("value"), get("unit").alias("unit"), F.lower(F.trim(F.coalesce(get("property_name"), "name"))).alias("property_name"),
        F.coalesce(number(get("min")), value).alias("low"), F.coalesce(number(get("max")), value).alias("high"),
    )


def by_numeric_value(spark, d):
    return G.numeric_filter(_numbers(spark, d), 10, 5000, "мг/л").select("entity_row_id", "name", "value", "unit")


def by_property_value(spark, d):
    """Values and ranges of one property that meet an interval; the property is the most frequent of those with numbers."""
    n = _numbers(spark, d).where("low is not null or high is not null")
    most = n.groupBy("property_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "property_name").limit(1).select("property_name")
    return G.interval_filter(n.join(F.broadcast(most), "property_name"), 10, 5000).select("entity_row_id", "property_name", "low", "high", F.coalesce("unit", F.lit("")).alias("unit"))


def multi_filter_union(spark, d):
    """Results of the filters one after the other (not their intersection)."""
    a = entities_by_name(spark, d).select(F.lit("name").alias("filter"), F.col("label").alias("type"), "name")
    b = G.year_filter(_years(spark, d), 2005, 2015).select(F.lit("year").alias("filter"), "type", "name")
    c = G.numeric_filter(_numbers(spark, d), 10, 5000).select(F.lit("numeric").alias("filter"), "type", "name")
    return a.unionByName(b).unionByName(c).groupBy("filter", "type").agg(F.count_distinct("name").alias("n_names"))


def reach_4hop(spark, d):
    return G.reach(_seeds(spark, d), _edges(spark, d), 4).groupBy("seed", "hop").agg(F.count("*").alias("n_nodes"))


def trails_3hop(spark, d):
    t = G.trail_counts(_seeds(spark, d), _edges(spark, d), 3)
    return t.groupBy("seed", "hops").agg(F.sum("n_trails").alias("n_trails"), F.count("*").alias("n_nodes"))


def top_related(spark, d):
    t = G.trail_counts(_seeds(spark, d), _edges(spark, d), 2).where("node <> seed")
    r = t.groupBy("seed", "node").agg(F.sum("n_trails").alias("n_trails"), F.min("hops").alias("hops"))
    w = Window.partitionBy("seed").orderBy(F.col("n_trails").desc(), "node")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def _terms(spark, d):
    q = table(spark, d, "documents").where("doc_id % 100 = 0 and title is not null")
    return q.select(F.col("doc_id").alias("query_id"), F.explode(G.seed_terms(tokenize("title"))).alias("term"))


def fuzzy_seeds(spark, d):
    return G.fuzzy_seeds(facts.entities(spark, d), _terms(spark, d))


def subgraph(spark, d):
    """Per question the nodes that bear the title's words exactly, or else those whose names contain terms, and what one hop reaches."""
    names = facts.entities(spark, d).select(node_key("type", "name").alias("node"), "name").distinct()
    titles = table(spark, d, "documents").where("doc_id % 100 = 0 and title is not null")
    phrases = titles.select(F.col("doc_id").alias("query_id"), F.lower("title").alias("exact"))
    steps = G.undirected(_edges(spark, d)).select("a", "b")
    near = G.seeded(names, phrases, G.fuzzy_seeds(facts.entities(spark, d), _terms(spark, d)))
    hop = near.join(steps, F.col("node") == F.col("a")).select("query_id", F.col("b").alias("node")).distinct()
    out = near.groupBy("query_id", "found_by").agg(F.count("*").alias("n_seeds"))
    return out.join(hop.groupBy("query_id").agg(F.count("*").alias("n_neighbours")), "query_id", "left").na.fill(0, ["n_neighbours"])


def degree_isolated(spark, d):
    e = _edges(spark, d)
    ends = e.select(F.col("s").alias("node")).unionByName(e.select(F.col("t").alias("node")))
    deg = ends.groupBy("node").agg(F.count("*").alias("degree"))
    n = facts.entities(spark, d).select(node_key("type", "name").alias("node")).distinct()
    return n.join(deg, "node", "left").na.fill(0, ["degree"])


def coverage_report(spark, d):
    """Per document as the question's scope: size, density, confidence and diversity of its part of the graph."""
    e = _edges(spark, d)
    ends = e.select("source_document", F.col("s").alias("node")).unionByName(e.select("source_document", F.col("t").alias("node")))
    n = ends.groupBy("source_document").agg(F.count_distinct("node").alias("n_nodes"))
    m = e.groupBy("source_document").agg(F.count("*").alias("n_edges"), mean("confidence", 6).alias("mean_confidence"), F.count_distinct("predicate").alias("n_predicates"))
    density = F.round(F.least(F.lit(1.0), F.log1p(F.col("n_edges") / F.col("n_nodes")) / F.log1p(F.lit(4.0))), 4)
    return m.join(n, "source_document").withColumn("density_score", density)


def hop_stats(spark, d):
    e = _edges(spark, d)
    r = G.reach(_seeds(spark, d), e, 3).select("hop", "node").distinct()
    return r.join(e.select(F.col("s").alias("node"), "edge_id", "source_document"), "node").groupBy("hop").agg(
        F.count_distinct("node").alias("n_nodes"), F.count_distinct("edge_id").alias("n_edges"), F.count_distinct("source_document").alias("n_documents")
    )


def context_lines(spark, d):
    """The 40 most confident facts, one line each."""
    e = facts.edges(spark, d).where("confidence is not null").orderBy(F.col("confidence").desc(), "relation_row_id").limit(40)
    line = F.concat("s_name", F.lit(" --"), "predicate", F.lit("--> "), "t_name", F.lit(" ("), F.col("source_document"), F.lit(")"))
    return e.select("relation_row_id", line.alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        entities_by_name, by_geography, by_year_range, by_numeric_value, by_property_value, multi_filter_union, reach_4hop, trails_3hop, top_related, fuzzy_seeds,
        degree_isolated, coverage_report, hop_stats, context_lines, subgraph,
    )
}

_G = f"""{EDGES}, ge AS (SELECT relation_row_id AS edge_id, {node('s_type', 's_name')} AS s, {node('t_type', 't_name')} AS t, predicate, confidence, source_document, quote
  FROM edges)"""
_L = f"""{_G}, le AS (SELECT * FROM ge WHERE s <> t),
st AS (SELECT edge_id, s AS a, t AS b FROM le UNION ALL SELECT edge_id, t, s FROM le),
seeds AS (SELECT DISTINCT {node('type', 'canonical_name')} AS seed FROM synonym_groups WHERE type = 'Facility')"""
_TRAILS = """t1 AS (SELECT seed, b AS node, [edge_id] AS e FROM seeds JOIN st ON seed = a),
t2 AS (SELECT seed, b AS node, list_append(e, edge_id) AS e FROM t1 JOIN st ON node = a WHERE NOT list_contains(e, edge_id)),
t3 AS (SELECT seed, b AS node, list_append(e, edge_id) AS e FROM t2 JOIN st ON node = a WHERE NOT list_contains(e, edge_id))"""


def _reach(hops: int) -> str:
    parts = ["r0 AS (SELECT seed, seed AS node, 0 AS hop FROM seeds)"]
    for k in range(1, hops + 1):
        parts.append(
            f"r{k} AS (SELECT * FROM r{k-1} UNION ALL SELECT DISTINCT f.seed, st.b, {k} FROM r{k-1} f JOIN st ON f.node = st.a AND f.hop = {k-1} "
            f"WHERE NOT EXISTS (SELECT 1 FROM r{k-1} x WHERE x.seed = f.seed AND x.node = st.b))"
        )
    return ",\n".join(parts)


_NUM = """SELECT entity_row_id, type, name, try_cast(replace(coalesce(attributes['value'], attributes['numeric_value']), ',', '.') AS DOUBLE) AS value, attributes['unit'] AS unit,
  lower(trim(coalesce(attributes['property_name'], name))) AS property_name, try_cast(replace(attributes['min'], ',', '.') AS DOUBLE) AS mn, try_cast(replace(attributes['max'], ',', '.') AS DOUBLE) AS mx FROM ent"""
_YEARS = r"""SELECT DISTINCT e.chunk_id, e.type, e.name, y.year FROM ent e JOIN (SELECT chunk_id, try_cast(regexp_extract(name, '(1[89]|20)\d\d', 0) AS INT) AS year FROM ent WHERE type = 'Year') y
  ON e.chunk_id = y.chunk_id WHERE e.type <> 'Year' AND year BETWEEN 2005 AND 2015"""
_BYNAME = """SELECT label, name, n_documents, n_rows FROM (SELECT type AS label, name, count(DISTINCT source_document) AS n_documents, count(*) AS n_rows FROM ent GROUP BY 1, 2)
  WHERE lower(name) IN (SELECT lower(canonical_name) FROM synonym_groups)"""
_TOK = "regexp_extract_all(lower(title), '[a-zA-Zа-яА-ЯёЁ0-9]+(?:[-_][a-zA-Zа-яА-ЯёЁ0-9]+)?')"

_FUZZY = rf"""q AS (SELECT doc_id AS query_id, unnest({_TOK}) AS t FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
terms AS (SELECT DISTINCT query_id, t AS term FROM q WHERE length(t) >= 3 UNION SELECT query_id, substr(t, 1, 5) FROM q WHERE length(t) >= 6
  UNION SELECT query_id, substr(t, 1, 3) FROM q WHERE length(t) = 4),
names AS (SELECT DISTINCT name FROM ent),
h AS (SELECT query_id, name, sum(length(term))::BIGINT AS score FROM (SELECT DISTINCT query_id, name, term FROM terms JOIN names ON contains(lower(name), term) WHERE length(term) >= 3) GROUP BY 1, 2)
SELECT query_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM h) WHERE rank <= 25"""

SQL = {
    "entities_by_name": f"WITH {ENT} {_BYNAME}",
    "by_geography": f"""WITH {ENT} SELECT lower(g.name) AS place, e.type, count(DISTINCT e.name) AS n_names FROM ent e JOIN ent g ON e.chunk_id = g.chunk_id
WHERE g.type = 'Geography' AND e.type <> 'Geography' GROUP BY 1, 2""",
    "by_year_range": f"WITH {ENT}, y AS ({_YEARS}) SELECT year, type, count(DISTINCT name) AS n_names FROM y GROUP BY 1, 2",
    "by_numeric_value": f"WITH {ENT}, n AS ({_NUM}) SELECT entity_row_id, name, value, unit FROM n WHERE value BETWEEN 10 AND 5000 AND lower(unit) = 'мг/л'",
    "by_property_value": f"""WITH {ENT}, n AS (SELECT entity_row_id, property_name, coalesce(mn, value) AS low, coalesce(mx, value) AS high, coalesce(unit, '') AS unit FROM ({_NUM})),
k AS (SELECT * FROM n WHERE low IS NOT NULL OR high IS NOT NULL), p AS (SELECT property_name FROM k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT entity_row_id, property_name, low, high, unit FROM k WHERE property_name = (SELECT property_name FROM p) AND coalesce(high, low) >= 10 AND coalesce(low, high) <= 5000""",
    "multi_filter_union": f"""WITH {ENT}, u AS (SELECT 'name' AS filter, label AS type, name FROM ({_BYNAME}) UNION ALL SELECT 'year', type, name FROM ({_YEARS})
UNION ALL SELECT 'numeric', type, name FROM ({_NUM}) WHERE value BETWEEN 10 AND 5000) SELECT filter, type, count(DISTINCT name) AS n_names FROM u GROUP BY 1, 2""",
    "reach_4hop": f"WITH {_L}, {_reach(4)} SELECT seed, hop, count(*) AS n_nodes FROM r4 GROUP BY 1, 2",
    "trails_3hop": f"""WITH {_L}, {_TRAILS}, t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
SELECT seed, len(e)::INT AS hops, count(*) AS n_trails, count(DISTINCT node) AS n_nodes FROM t GROUP BY 1, 2""",
    "top_related": f"""WITH {_L}, {_TRAILS}, t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
r AS (SELECT seed, node, count(*) AS n_trails, min(len(e))::INT AS hops FROM t WHERE node <> seed GROUP BY 1, 2)
SELECT seed, node, n_trails, hops, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n_trails DESC, node) AS rank FROM r) WHERE rank <= 10""",
    "fuzzy_seeds": f"WITH {ENT}, {_FUZZY}",
    "subgraph": f"""WITH {_G}, st AS (SELECT s AS a, t AS b FROM ge WHERE s <> t UNION SELECT t, s FROM ge WHERE s <> t), n AS (SELECT DISTINCT {node('type', 'name')} AS node, name FROM ent),
p AS (SELECT doc_id AS query_id, lower(title) AS exact FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
x AS (SELECT DISTINCT query_id, node FROM n JOIN p ON lower(name) = exact), y AS ({'WITH ' + _FUZZY}),
z AS (SELECT query_id, node, 'exact' AS found_by FROM x UNION ALL SELECT DISTINCT query_id, node, 'terms' FROM y JOIN n USING (name) WHERE query_id NOT IN (SELECT query_id FROM x)),
h AS (SELECT query_id, count(DISTINCT b) AS n_neighbours FROM z JOIN st ON node = a GROUP BY 1)
SELECT query_id, found_by, count(*) AS n_seeds, coalesce(any_value(n_neighbours), 0) AS n_neighbours FROM z LEFT JOIN h USING (query_id) GROUP BY 1, 2""",
    "degree_isolated": f"""WITH {_G}, n AS (SELECT DISTINCT {node('type', 'name')} AS node FROM ent),
x AS (SELECT s AS node FROM ge WHERE s <> t UNION ALL SELECT t FROM ge WHERE s <> t), g AS (SELECT node, count(*) AS degree FROM x GROUP BY 1)
SELECT n.node, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (node)""",
    "coverage_report": f"""WITH {_G}, e AS (SELECT * FROM ge WHERE s <> t), x AS (SELECT source_document, s AS node FROM e UNION SELECT source_document, t FROM e),
n AS (SELECT source_document, count(*) AS n_nodes FROM x GROUP BY 1)
SELECT e.source_document, count(*) AS n_edges, {mean_sql('confidence', 6)} AS mean_confidence, count(DISTINCT predicate) AS n_predicates, any_value(n_nodes) AS n_nodes,
  round(least(1.0, ln(1 + count(*) / any_value(n_nodes)) / ln(5.0)), 4) AS density_score FROM e JOIN n USING (source_document) GROUP BY 1""",
    "hop_stats": f"""WITH {_L}, {_reach(3)} SELECT hop, count(DISTINCT node) AS n_nodes, count(DISTINCT edge_id) AS n_edges, count(DISTINCT source_document) AS n_documents
FROM r3 JOIN le ON le.s = r3.node GROUP BY 1""",
    "context_lines": f"""WITH {EDGES} SELECT relation_row_id, s_name || ' --' || predicate || '--> ' || t_name || ' (' || source_document || ')' AS line
FROM edges WHERE confidence IS NOT NULL ORDER BY confidence DESC, relation_row_id LIMIT 40""",
}
