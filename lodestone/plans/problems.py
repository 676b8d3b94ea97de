"""Queries of the general data problems (1 and 5) on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import orphans, units
from lodestone.session import table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parents = orphans.parent_rows(
        table(spark, d, "llm_entities"), "chunk_id", "local_id", "entity_row_id", "extracted_at", "retracted_at"
    )
    refs = orphans.reference_rows(
        table(spark, d, "llm_relations"), "chunk_id", "relation_row_id", "extracted_at", ["subject", "object"]
    )
    return parents, refs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = orphans.orphans(*_references(spark, d))
    return out.select(F.col("ref_id").alias("relation_row_id"), F.col("slot").alias("endpoint"), "reason")


def p1_monthly(spark: SparkSession, d: str) -> DataFrame:
    out = orphans.orphans(*_references(spark, d))
    month = F.date_format(F.date_trunc("month", "made_at"), "yyyy-MM").alias("month")
    return out.groupBy(F.lit("llm_relations").alias("table_name"), month, F.col("slot").alias("endpoint"), "reason").agg(
        F.count("*").alias("n_orphans")
    )


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return orphans.snapshots(*_references(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    place = F.coalesce(
        F.regexp_extract("chunk_id", r"#(\d+)$", 1).try_cast("bigint"), F.pmod(F.xxhash64("entity_row_id"), F.lit(1 << 20))
    )
    rows = table(spark, d, "llm_entities").withColumn("__place", place)
    seen = units.observations(rows, "entity_row_id", "source_document", "canonical_name", "attributes", "__place")
    return units.common_values(seen, table(spark, d, "unit_reference"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).withColumnRenamed("row_id", "entity_row_id").distinct()


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Per quantity: values, and the least and greatest bound in the common unit."""
    v = _values(spark, d)
    low = F.regexp_extract("common_value", r"^(-?\d+)", 1).try_cast("bigint")
    high = F.regexp_extract("common_value", r"(-?\d+)$", 1).try_cast("bigint")
    return v.groupBy("quantity").agg(F.count("*").alias("n_values"), F.min(low).alias("least"), F.max(high).alias("greatest"))


_P1_CTE = """
WITH refs AS (
  SELECT relation_row_id, chunk_id, 'subject' AS endpoint, trim(subject) AS ref, extracted_at FROM llm_relations
  UNION ALL
  SELECT relation_row_id, chunk_id, 'object', trim(object), extracted_at FROM llm_relations),
idx AS (
  SELECT chunk_id, trim(local_id) AS local_id, count(*) AS n, count(*) FILTER (retracted_at IS NULL) AS live,
         min(extracted_at) FILTER (retracted_at IS NULL) AS first_live
  FROM llm_entities WHERE trim(local_id) <> '' GROUP BY 1, 2),
found AS (
  SELECT relation_row_id, endpoint, extracted_at,
         CASE WHEN n IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted'
              WHEN first_live > extracted_at THEN 'late' END AS reason
  FROM refs LEFT JOIN idx ON refs.chunk_id = idx.chunk_id AND refs.ref = idx.local_id
  WHERE ref <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_monthly": p1_monthly, "p1_snapshots": p1_snapshots, "p5_found": p5_found, "p5_ranges": p5_ranges}

SQL = {
    "p1_found": _P1_CTE + "SELECT DISTINCT relation_row_id, endpoint, reason FROM found WHERE reason IS NOT NULL",
    "p1_monthly": _P1_CTE
    + """SELECT 'llm_relations' AS table_name, strftime(extracted_at, '%Y-%m') AS month, endpoint, reason, count(*) AS n_orphans
FROM (SELECT DISTINCT relation_row_id, endpoint, extracted_at, reason FROM found WHERE reason IS NOT NULL)
GROUP BY ALL""",
    "p1_snapshots": """WITH refs AS (
  SELECT DISTINCT relation_row_id, chunk_id, 'subject' AS slot, trim(subject) AS ref, extracted_at AS made FROM llm_relations UNION ALL
  SELECT DISTINCT relation_row_id, chunk_id, 'object', trim(object), extracted_at FROM llm_relations),
ent AS (SELECT chunk_id, trim(local_id) AS local_id, extracted_at AS arrived, retracted_at AS gone FROM llm_entities WHERE trim(local_id) <> '' AND chunk_id IS NOT NULL),
q AS (SELECT DISTINCT date_trunc('quarter', t)::TIMESTAMP AS hi FROM (SELECT arrived AS t FROM ent UNION ALL SELECT gone FROM ent UNION ALL SELECT made FROM refs WHERE ref <> '') WHERE t IS NOT NULL),
p AS (SELECT hi AS known_until, hi FROM q WHERE hi > (SELECT min(hi) FROM q) UNION ALL SELECT NULL, TIMESTAMP '9999-12-31'),
idx AS (SELECT hi, chunk_id, local_id, count(*) AS n, count(*) FILTER (gone IS NULL OR gone >= hi) AS live, min(arrived) FILTER (gone IS NULL OR gone >= hi) AS first_live
  FROM ent JOIN p ON arrived IS NULL OR arrived < hi GROUP BY 1, 2, 3),
found AS (SELECT known_until, slot, CASE WHEN n IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first_live > made THEN 'late' ELSE 'found' END AS reason
  FROM (SELECT * FROM refs JOIN p ON ref <> '' AND (made IS NULL OR made < hi)) r LEFT JOIN idx ON r.hi = idx.hi AND r.chunk_id = idx.chunk_id AND r.ref = idx.local_id)
SELECT known_until, slot, reason, count(*) AS n FROM found GROUP BY ALL""",
}
