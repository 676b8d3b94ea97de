"""Quality of extracted facts: issues, contradictions and knowledge gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.entities import by_local_id, node_key

LOW = 0.45
#: Pairs of predicates that contradict each other between the same two entities (fixed values).
OPPOSING = [("has_limitation", "has_expected_result"), ("replaced_by", "uses_technology")]


def contradictions(edges: DataFrame) -> DataFrame:
    """Explicit contradictions, and all edges of pairs that carry two opposing predicates; each distinct edge once."""
    e = edges.select(node_key("s_type", "s_name").alias("s"), "predicate", node_key("t_type", "t_name").alias("t"), "quote")
    has = lambda p: F.bool_or(F.col("predicate") == p)
    clash = F.lit(False)
    for left, right in OPPOSING:
        clash = clash | (has(left) & has(right))
    pair = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
    involved = e.where(F.col("predicate").isin([p for x in OPPOSING for p in x]))
    opposed = involved.groupBy(*pair).agg(clash.alias("clash")).where("clash").drop("clash")
    implied = e.withColumns({"a": F.least("s", "t"), "b": F.greatest("s", "t")}).join(opposed, ["a", "b"], "left_semi").drop("a", "b")
    return e.where("predicate = 'contradicts'").unionByName(implied).distinct()


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without relations, nodes of low confidence, and nodes whose relations come from one document."""
    ends = edges.select(F.col("s_type").alias("label"), F.col("s_name").alias("name"), "source_document").unionByName(
        edges.select(F.col("t_type").alias("label"), F.col("t_name").alias("name"), "source_document")
    )
    degree = ends.groupBy("label", "name").agg(F.count("*").alias("degree"), F.count_distinct("source_document").alias("docs"))
    row = lambda df, code: df.select(F.lit(code).alias("code"), "label", "name")
    isolated = nodes.join(degree, ["label", "name"], "left_anti")
    low = nodes.where((F.col("confidence") > 0) & (F.col("confidence") < LOW))
    return row(isolated, "isolated_entity").unionByName(row(low, "low_confidence_entity")).unionByName(
        row(degree.where("docs < 2"), "single_source_support")
    )


def issues(entities: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, severity, chunk_id, evidence) of every issue."""
    row = lambda df, code, severity, evidence: df.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), "chunk_id", evidence.cast("string").alias("evidence")
    )
    ids = by_local_id(entities).select("chunk_id", "local_id")
    slot = lambda c: relations.withColumn("local_id", F.trim(c)).join(ids, ["chunk_id", "local_id"], "left_anti")
    missing = slot("subject").select("chunk_id", "relation_row_id").unionByName(slot("object").select("chunk_id", "relation_row_id")).distinct()
    pair = edges.where(F.col("predicate").isin("has_limitation", "has_expected_result")).groupBy(
        "chunk_id", F.least("s_id", "t_id").alias("a"), F.greatest("s_id", "t_id").alias("b")
    ).agg(F.count_distinct("predicate").alias("n")).where("n = 2")
    bare = entities.select("chunk_id").distinct().join(relations.select("chunk_id"), "chunk_id", "left_anti")
    parts = [
        row(entities.where(F.col("confidence") < LOW), "low_confidence_entity", "warning", F.col("entity_row_id")),
        row(relations.where(F.col("confidence") < LOW), "low_confidence_relation", "warning", F.col("relation_row_id")),
        row(missing, "missing_relation_endpoint", "error", F.col("relation_row_id")),
        row(relations.where("trim(predicate) = 'contradicts'"), "explicit_contradiction", "warning", F.col("relation_row_id")),
        row(pair, "possible_semantic_contradiction", "warning", F.concat_ws("|", "a", "b")),
        row(bare, "entities_without_relations", "warning", F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
