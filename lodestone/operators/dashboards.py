"""Aggregates for overviews: entity rollups, documents at risk, coverage, chains, people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.entities import node_key

#: Key words of domains in document texts (fixed values).
DOMAINS = {
    "Гидрометаллургия": "выщелач электроэкстр сорбц католит раствор",
    "Пирометаллургия": "плавк конверт штейн печь обжиг",
    "Экология": "вод очистк выброс сток сульфат хвост",
    "Переработка отходов": "отход шлак хвост вторич регенер",
    "Геомеханика/безопасность": "удароопас сейсм горн вентиляц пород",
}


def rollup(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each node: name, rows, documents, mentions, degree, and a confidence that grows with the rows."""
    e = entities.withColumn("id", node_key("type", "name"))
    base = e.groupBy("id", "type").agg(
        F.min("name").alias("name"), F.count("*").alias("n_rows"), F.count_distinct("source_document").alias("doc_count"),
    )
    mentions = e.select("id", F.explode("mentions").alias("m")).where("trim(m) <> ''").groupBy("id").agg(F.count_distinct(F.substring("m", 1, 80)).alias("n_mentions"))
    ends = edges.select(node_key("s_type", "s_name").alias("id")).unionByName(edges.select(node_key("t_type", "t_name").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    out = base.join(mentions, "id", "left").join(degree, "id", "left").na.fill(0, ["n_mentions", "degree"])
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.6 + 0.05 * F.log1p("n_rows")), 3))


def risk_zones(entities: DataFrame, edges: DataFrame, least: int = 40) -> DataFrame:
    """Documents with few entities or with contradictions."""
    n = entities.groupBy("source_document").agg(F.count_distinct(node_key("type", "name")).alias("n_entities"))
    c = edges.where("predicate = 'contradicts'").groupBy("source_document").agg(F.count("*").alias("n_contradictions"))
    out = n.join(c, "source_document", "full").na.fill(0, ["n_entities", "n_contradictions"])
    return out.where((F.col("n_entities") < least) | (F.col("n_contradictions") > 0))


def domain_coverage(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose text has a key word of each domain; a document can count for several."""
    low = F.lower(text)
    counts = docs.agg(*[F.count_if(low.rlike("|".join(k.split()))).alias(d) for d, k in DOMAINS.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"`{d}`").alias("n_documents")) for d in DOMAINS]))
    return counts.select(stacked.alias("x")).select("x.*")


def top_nodes(nodes: DataFrame, type_: str, k: int) -> DataFrame:
    """The k nodes of a type with the highest degree (then documents, then id); a report of fixed size."""
    return nodes.where(F.col("type") == type_).orderBy(F.col("degree").desc(), F.col("doc_count").desc(), "id").limit(k)


def uncovered_pairs(nodes: DataFrame, edges: DataFrame, left: str, right: str, k: int = 20) -> DataFrame:
    """Pairs of the top k nodes of two types that no relation joins, in either direction."""
    a = top_nodes(nodes, left, k).select(F.col("id").alias("a"))
    b = top_nodes(nodes, right, k).select(F.col("id").alias("b"))
    e = edges.where("predicate = 'uses_material'").select(node_key("s_type", "s_name").alias("s"), node_key("t_type", "t_name").alias("t"))
    covered = e.select(F.col("s").alias("a"), F.col("t").alias("b")).unionByName(e.select(F.col("t").alias("a"), F.col("s").alias("b")))
    return a.crossJoin(F.broadcast(b)).join(covered, ["a", "b"], "left_anti")


def chains(edges: DataFrame) -> DataFrame:
    """Processes that use a material and have an output or equipment: up to 3 materials, 2 of equipment, 3 results, in order of rows."""
    e = edges.where(F.lower("s_type") == "process").where(F.col("predicate").isin("uses_material", "produces_output", "uses_equipment"))
    e = e.select(node_key("s_type", "s_name").alias("process"), "predicate", "t_name", "relation_row_id")
    first = e.groupBy("process", "predicate", "t_name").agg(F.min("relation_row_id").alias("first_row"))
    n = F.row_number().over(Window.partitionBy("process", "predicate").orderBy("first_row"))
    few = first.withColumn("n", n).where("n <= 3 and not (predicate = 'uses_equipment' and n > 2)")
    names = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("predicate") == p, F.struct("first_row", "t_name")))), lambda x: x["t_name"]), "; ")
    out = few.groupBy("process").agg(names("uses_material").alias("materials"), names("uses_equipment").alias("equipment"), names("produces_output").alias("results"))
    return out.where("materials <> '' and (equipment <> '' or results <> '')")


def affiliations(edges: DataFrame) -> DataFrame:
    """Experts with their affiliations and numbers of publications."""
    aff = edges.where(F.col("predicate").isin("affiliated_with", "used_in_facility", "performed_by") & (F.col("s_type") == "Expert"))
    aff = aff.groupBy(F.col("s_name").alias("expert")).agg(F.count_distinct("t_name").alias("n_affiliations"), F.min("t_name").alias("first_affiliation"))
    pub = edges.where("predicate = 'authored_by' and t_type = 'Expert'").groupBy(F.col("t_name").alias("expert")).agg(F.count("*").alias("n_publications"))
    return aff.join(pub, "expert", "full").select(
        "expert", F.coalesce("n_affiliations", F.lit(0)).alias("n_affiliations"), F.coalesce("first_affiliation", F.lit("")).alias("first_affiliation"),
        F.coalesce("n_publications", F.lit(0)).alias("n_publications"),
    )


def consensus(edges: DataFrame, least: int = 2) -> DataFrame:
    """Facts that at least ``least`` documents state."""
    return edges.groupBy(node_key("s_type", "s_name").alias("s"), "predicate", node_key("t_type", "t_name").alias("t")).agg(
        F.count_distinct("source_document").alias("n_documents"), F.count("*").alias("n_rows")
    ).where(F.col("n_documents") >= least)
