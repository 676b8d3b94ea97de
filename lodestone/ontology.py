"""Closed vocabularies of the knowledge graph, and their checks as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity types, relation types, auxiliary labels, numeric operators, geography kinds.
ENTITY_TYPES = (
    "Material Substance Process Equipment Property Parameter Condition Experiment Publication TechnologySolution Result "
    "Conclusion Limitation Facility Organization Expert Geography Year NumericValue"
).split()
RELATION_TYPES = (
    "has_subprocess replaced_by affects_property has_limitation has_quality_requirement has_distribution_requirement "
    "has_expected_result based_on applies_to uses_technology produces_output requires_expertise uses_equipment studies "
    "fed_through depends_on operates_at_condition measured_property operates_between validated_by performed_by uses_material "
    "described_in supported_by authored_by affiliated_with used_in_facility contradicts has_geography published_in_year "
    "has_numeric_value"
).split()
AUXILIARY_LABELS = ["Document", "Chunk", "Alias"]
NUMERIC_OPERATORS = ["<=", ">=", "=", "<", ">", "range"]
GOLDEN_TYPES = ENTITY_TYPES[:16]
GOLDEN_RELATIONS = RELATION_TYPES[:28]


def vocabulary(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A closed vocabulary as a one-column table of fixed size."""
    return spark.range(1).select(F.explode(F.lit(values)).alias(name))


def unknown_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value isn't in the vocabulary; null counts as unknown."""
    known = vocabulary(df.sparkSession, values, column)
    return df.join(F.broadcast(known), column, "left_anti")


def safe_relation_type(column: str):
    """Upper case, other characters than letters and digits as _, R_ before a leading digit."""
    text = F.regexp_replace(F.upper(F.trim(column)), r"[^A-Z0-9]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(text == "", "RELATED_TO").when(text.rlike(r"^[0-9]"), F.concat(F.lit("R_"), text)).otherwise(text)
