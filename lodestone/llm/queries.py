"""Queries of the text and training-data problems on the project's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import canonical, copies, lookalikes, mixing, packing, scans, tokens, truncation
from lodestone.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = copies.found_copies(
        table(spark, d, "llm_entities"), "chunk_id", "entity_row_id", ["type", "canonical_name"], "canonical_name"
    )
    return out.toDF("entity_row_id_a", "entity_row_id_b")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    out = copies.collapsed(
        table(spark, d, "llm_entities"), "chunk_id", "entity_row_id", ["type", "canonical_name"], "canonical_name", "attributes"
    )
    return out.select(F.col("first_id").alias("entity_row_id"), F.col("scope").alias("chunk_id"), "n_copies", "n_attribute_sets")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    blocks, chunks = scans.both_tables(table(spark, d, "parsed_blocks"), table(spark, d, "chunks"))
    return scans.noise(blocks.unionByName(chunks), scans.Learned(blocks))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    blocks, chunks = scans.both_tables(table(spark, d, "parsed_blocks"), table(spark, d, "chunks"), placed=True)
    return scans.paragraphs(blocks.unionByName(chunks).distinct(), scans.Learned(blocks))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    groups = canonical.reference_spellings(table(spark, d, "synonym_groups"), "canonical_id", "canonical_name", "aliases")
    return canonical.mapped_rows(table(spark, d, "llm_entities"), "entity_row_id", "canonical_name", "mentions", groups)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = _mapped(spark, d).where("entry is not null")
    return out.select(F.col("row_id").alias("entity_row_id"), F.col("entry").alias("canonical_id")).distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_entities").select("entity_row_id", "type", "canonical_name")
    named = _mapped(spark, d).where("entry is not null").select(F.col("row_id").alias("entity_row_id"))
    return rows.join(named, "entity_row_id", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = lookalikes.inconsistent_slots(table(spark, d, "llm_entities"), "entity_row_id", "canonical_name", "mentions")
    return out.select(F.col("row_id").alias("entity_row_id"), "slot").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    out = lookalikes.inconsistent_slots(table(spark, d, "llm_entities"), "entity_row_id", "canonical_name", "mentions")
    return out.select(F.col("row_id").alias("entity_row_id"), "slot", "value", "consistent")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.sized(table(spark, d, "documents"), "doc_id", "text")
    limits = table(spark, d, "pack_capacities").select(F.col("capacity_tokens").alias("capacity"))
    return packing.pack(sizes, limits).join(sizes.select("uid", "doc_id"), "uid")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "pack_capacities").select("capacity_id", F.col("capacity_tokens").alias("capacity"))
    return _packed(spark, d).join(names, "capacity").select("capacity_id", "container", "doc_id", "piece", F.col("size").alias("tokens"))


def p7_filling(spark: SparkSession, d: str) -> DataFrame:
    return packing.filling(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    columns = ["source", mixing.quality(F.col("text")).alias("weight"), F.sha2("text", 256).alias("digest")]
    sizes = tokens.sized(table(spark, d, "documents"), "doc_id", "text", *columns)
    targets = table(spark, d, "mix_targets")
    return mixing.selection(sizes, targets), targets, sizes.agg(F.sum("tokens").alias("total"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.verdicts(table(spark, d, "documents"), "doc_id", "text", "source").where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"), "doc_id", "text", "source")


QUERIES = {
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_containers": p7_containers,
    "p7_filling": p7_filling,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

_P2 = r"""
WITH n AS (
  SELECT entity_row_id, chunk_id,
         regexp_replace(lower(coalesce(type, '')), '[^\p{L}\p{N}]', '', 'g') AS t,
         regexp_replace(replace(replace(lower(coalesce(canonical_name, '')), 'и' || chr(774), 'й'), 'е' || chr(776), 'ё'), '[^\p{L}\p{N}]', '', 'g') AS c
  FROM llm_entities WHERE chunk_id IS NOT NULL),
g AS (SELECT *, min(entity_row_id) OVER (PARTITION BY chunk_id, t, c) AS a FROM n WHERE c <> '')
"""

SQL = {
    "p2_found": _P2 + "SELECT DISTINCT a AS entity_row_id_a, entity_row_id AS entity_row_id_b FROM g WHERE a <> entity_row_id",
}
