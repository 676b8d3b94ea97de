"""Extracted entities and relations as a graph: cleaned rows, endpoint resolution, upserts and merges of several extractors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import canonicalize


def clean_entities(df: DataFrame) -> DataFrame:
    """Valid entity rows (not retracted) with a type and a name, blanks trimmed."""
    out = df.where("retracted_at is null").select(
        "entity_row_id", "chunk_id", "source_document", F.trim("local_id").alias("local_id"), F.trim("type").alias("type"),
        F.trim("canonical_name").alias("name"), "mentions", "attributes", "page", "confidence", "extractor", "needs_review", "extracted_at",
    )
    return out.where("type <> '' and name <> ''")


def by_local_id(entities: DataFrame) -> DataFrame:
    """One row for each local id of a chunk: the earliest entity row stands for its copies."""
    first = F.min_by(F.struct("type", "name"), "entity_row_id").alias("e")
    return entities.where("local_id <> ''").groupBy("chunk_id", "local_id").agg(first).select("chunk_id", "local_id", "e.type", "e.name")


def resolved_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose endpoints name entities of their chunk, with the endpoints' types and names."""
    ids = by_local_id(entities)
    rel = relations.where("trim(predicate) <> ''").select(
        "relation_row_id", "chunk_id", "source_document", F.trim("subject").alias("s_id"), F.trim("object").alias("t_id"),
        F.trim("predicate").alias("predicate"), "quote", "note", "confidence", "extractor", "extracted_at",
    )
    s = ids.select("chunk_id", F.col("local_id").alias("s_id"), F.col("type").alias("s_type"), F.col("name").alias("s_name"))
    t = ids.select("chunk_id", F.col("local_id").alias("t_id"), F.col("type").alias("t_type"), F.col("name").alias("t_name"))
    return rel.join(s, ["chunk_id", "s_id"]).join(t, ["chunk_id", "t_id"])


def edges_or_ids(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation_row_id, source, predicate, target, n_resolved): every relation with a predicate; an endpoint that no entity of the chunk
    bears as its id falls back to an entity of that name, and without one stays as it was written."""
    ids = by_local_id(entities)
    names = entities.groupBy("chunk_id", F.lower("name").alias("key")).agg(F.min(F.struct("entity_row_id", "name")).alias("e")).select("chunk_id", "key", F.col("e.name").alias("named"))
    out = relations.where("trim(predicate) <> ''").select("relation_row_id", "chunk_id", F.trim("predicate").alias("predicate"), F.trim("subject").alias("s"), F.trim("object").alias("t"))
    for end in ("s", "t"):
        own = ids.select("chunk_id", F.col("local_id").alias(end), F.col("name").alias(f"{end}_name"))
        by_name = names.select("chunk_id", F.col("key").alias(f"{end}_key"), F.col("named").alias(f"{end}_named"))
        out = out.join(own, ["chunk_id", end], "left").withColumn(f"{end}_key", F.lower(end)).join(by_name, ["chunk_id", f"{end}_key"], "left")
        out = out.withColumn(f"{end}_found", F.coalesce(f"{end}_name", f"{end}_named"))
    resolved = sum((F.col(f"{end}_found").isNotNull().cast("int") for end in ("s", "t")), F.lit(0))
    text = lambda end: F.coalesce(f"{end}_found", F.nullif(F.col(end), F.lit("")), F.lit("?"))
    return out.select("relation_row_id", text("s").alias("source"), "predicate", text("t").alias("target"), resolved.alias("n_resolved"))


def node_key(type_: Column | str, name: Column | str) -> Column:
    """Graph-wide id of an entity: type and lower-case name with blanks collapsed."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(c(type_), F.lit("::"), F.lower(F.trim(F.regexp_replace(c(name), r"\s+", " "))))


def source_name(extractor: str) -> Column:
    """Evidence source of an extractor; the spellings are fixed values."""
    low = F.lower(F.coalesce(extractor, F.lit("")))
    return (
        F.when(low.contains("natasha"), "natasha").when(low.contains("llm") | low.contains("yandex"), "yandex_llm")
        .when(low.contains("ensemble"), "ensemble").when(F.coalesce(extractor, F.lit("")) != "", F.col(extractor)).otherwise("unknown")
    )


@dataclass(frozen=True)
class MergeWeights:
    """How much each evidence source counts, and when a merged fact needs a review."""

    llm: float = 0.7
    statistical: float = 0.3
    review_below: float = 0.58
    bonus: float = 0.08


def weight_of(source: Column, w: MergeWeights) -> Column:
    return F.when(source.isin("natasha", "statistical_ner"), w.statistical).otherwise(w.llm)


def merged_confidence(confidence: Column, weight: Column, w: MergeWeights) -> Column:
    """Weighted mean, with a bonus for more than one member, at most 1."""
    base = F.sum(confidence * weight) / F.sum(weight)
    return F.least(F.lit(1.0), F.round(base + F.when(F.count(F.lit(1)) > 1, w.bonus).otherwise(0.0), 4))


def merge_entities(entities: DataFrame, w: MergeWeights | None = None) -> DataFrame:
    """Entities of one chunk with the same type and canonical name become one row.

    The member with the highest confidence (then the longest name, then the first row) gives the name; sources are listed in order;
    rows from a single source below the threshold need a review. Ids count within the chunk in order of type and name.
    """
    w = w or MergeWeights()
    rows = entities.where("confidence is not null").withColumns({"canon": canonicalize("name"), "source": source_name("extractor")})
    rank = F.struct("confidence", F.length("name"), -F.col("entity_row_id"))
    out = rows.groupBy("chunk_id", "type", "canon").agg(
        F.max_by("name", rank).alias("name"), merged_confidence(F.col("confidence"), weight_of(F.col("source"), w), w).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n_members"),
    )
    single = ~F.col("sources").contains(",")
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("type", "canon"))
    return out.select(
        "chunk_id", F.concat(F.lit("ens_e"), n).alias("local_id"), "type", "canon", "name", "confidence",
        F.concat(F.lit("ensemble:"), "sources").alias("extractor"), "n_members",
        F.when(single, "single_source").otherwise("exact_canonical_match").alias("reason"),
        (single & (F.col("confidence") < w.review_below)).alias("needs_review"),
    )


def merge_relations(edges: DataFrame, w: MergeWeights | None = None) -> DataFrame:
    """Relations of one chunk between the same merged endpoints become one row, with the longest quote and the notes joined."""
    w = w or MergeWeights()
    rows = edges.where("confidence is not null").withColumns(
        {"s_canon": canonicalize("s_name"), "t_canon": canonicalize("t_name"), "source": source_name("extractor"), "q": F.trim(F.coalesce("quote", F.lit("")))}
    )
    keys = ["chunk_id", "s_type", "s_canon", "predicate", "t_type", "t_canon"]
    notes = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("note") != "", F.trim("note")))), "; ")
    return rows.groupBy(*keys).agg(
        merged_confidence(F.col("confidence"), weight_of(F.col("source"), w), w).alias("confidence"),
        F.max(F.length("q")).alias("quote_chars"), F.nullif(notes, F.lit("")).alias("note"), F.count("*").alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def entity_payloads(entities: DataFrame) -> DataFrame:
    """(chunk_id, type, canon, mentions, attributes) of merged entities: every distinct mention, and of each attribute key the value
    of the most confident member (then the latest row), written 'key=value' in order of the keys."""
    keys = ["chunk_id", "type", "canon"]
    rows = entities.where("confidence is not null").withColumn("canon", canonicalize("name"))
    mention = rows.select(*keys, F.explode_outer("mentions").alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.trim("m") != "", F.trim("m")))).alias("mentions"))
    each = rows.select(*keys, "confidence", "entity_row_id", F.explode("attributes").alias("k", "v")).where("v is not null")
    best = each.groupBy(*keys, "k").agg(F.max_by("v", F.struct("confidence", "entity_row_id")).alias("v"))
    merged = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat("k", F.lit("="), "v"))).alias("attributes"))
    return mention.join(merged, keys, "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))


def relation_payloads(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(chunk_id, source_id, predicate, target_id, quote, n_members): relations between merged entities by those entities' own ids,
    with the longest quote (of equally long ones that of the first row); an endpoint that was not merged keeps its type and name."""
    rows = edges.where("confidence is not null").withColumns({"s_canon": canonicalize("s_name"), "t_canon": canonicalize("t_name")})
    ids = merged.select("chunk_id", "type", "canon", "local_id")
    for end, out in (("s", "source_id"), ("t", "target_id")):
        own = ids.select("chunk_id", F.col("type").alias(f"{end}_type"), F.col("canon").alias(f"{end}_canon"), F.col("local_id").alias(f"{end}_local"))
        rows = rows.join(own, ["chunk_id", f"{end}_type", f"{end}_canon"], "left")
        rows = rows.withColumn(out, F.coalesce(f"{end}_local", F.concat_ws(":", f"{end}_type", f"{end}_canon")))
    q = F.trim(F.coalesce("quote", F.lit("")))
    return rows.groupBy("chunk_id", "source_id", "predicate", "target_id").agg(
        F.max_by(q, F.struct(F.length(q), -F.col("relation_row_id"))).alias("quote"), F.count("*").alias("n_members")
    )


def deduplicated(entities: DataFrame) -> DataFrame:
    """Within a chunk, entities of one type and canonical name: the first row stays, with the mentions of all of them."""
    rows = entities.withColumn("canon", canonicalize("name"))
    mention = rows.select("chunk_id", "type", "canon", F.explode_outer("mentions").alias("m"))
    mentions = mention.groupBy("chunk_id", "type", "canon").agg(F.count_distinct(F.when(F.trim("m") != "", F.col("m"))).alias("n_mentions"))
    first = rows.groupBy("chunk_id", "type", "canon").agg(
        F.min("entity_row_id").alias("entity_row_id"), F.min_by("name", "entity_row_id").alias("name"), F.count("*").alias("n_rows"),
        F.coalesce(F.min("page"), F.lit(0)).alias("first_page"), F.coalesce(F.max("page"), F.lit(0)).alias("last_page"),
    )
    return first.join(mentions, ["chunk_id", "type", "canon"])


def calibrated(confidence: Column, extractor: Column, support: Column, review: Column, quote: Column | None = None) -> Column:
    """Confidence after bonuses for merged sources, support and quotes and the penalty for a pending review, in 0..1."""
    c = confidence + F.when(F.lower(extractor).contains("ensemble"), 0.08).otherwise(0.0)
    c = c + F.least(F.lit(0.12), F.greatest(F.lit(0), support - 1) * 0.03) - F.when(review, 0.12).otherwise(0.0)
    if quote is not None:
        c = c + F.when(quote != "", 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(c, 4)))


def attribute_latest(entities: DataFrame) -> DataFrame:
    """Latest non-blank value of each attribute key of each node."""
    rows = entities.select(node_key("type", "name").alias("node"), "extracted_at", "entity_row_id", F.explode("attributes").alias("k", "v"))
    rows = rows.where("trim(v) <> ''")
    return rows.groupBy("node", "k").agg(F.max_by("v", F.struct("extracted_at", "entity_row_id")).alias("v"))


def upsert_nodes(entities: DataFrame) -> DataFrame:
    """Nodes by (type, name): first row creates, last row gives confidence; documents, chunks and distinct mentions are counted."""
    rank = F.struct("extracted_at", "entity_row_id")
    return entities.groupBy(F.col("type").alias("label"), "name").agg(
        F.min("extracted_at").alias("created_at"), F.max_by("confidence", rank).alias("confidence"),
        F.max_by("extractor", rank).alias("extractor"), F.count_distinct("source_document").alias("n_documents"),
        F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_rows"),
    )


def upsert_edges(edges: DataFrame) -> DataFrame:
    """Edges by (source, type, target): the note of the first row, the confidence and document of the last."""
    rank = F.struct("extracted_at", "relation_row_id")
    return edges.groupBy("s_type", "s_name", "predicate", "t_type", "t_name").agg(
        F.min_by("note", rank).alias("note"), F.max_by("confidence", rank).alias("confidence"),
        F.max_by("source_document", rank).alias("source_document"), F.count("*").alias("n_rows"),
        F.count_distinct("chunk_id").alias("n_chunks"),
    )


def satellites(entities: DataFrame) -> DataFrame:
    """Nodes that hang on entities: documents, chunks, aliases, geographies, years and numeric values, with their edges counted."""
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    base = entities.select("type", "name", "source_document", "chunk_id", "local_id", "mentions", "attributes")
    value = F.coalesce(get("value"), get("numeric_value")).try_cast("double")
    parts = [
        base.select(F.lit("Document").alias("label"), F.col("source_document").alias("id")),
        base.select(F.lit("Chunk").alias("label"), F.col("chunk_id").alias("id")),
        base.select(F.lit("Alias").alias("label"), F.explode("mentions").alias("id")),
        base.select(F.lit("Geography").alias("label"), F.when(F.col("type") == "Geography", F.col("name")).alias("id")),
        base.select(F.lit("Year").alias("label"), F.when(F.col("type") == "Year", F.regexp_extract("name", r"(1[89]|20)\d\d", 0)).alias("id")),
        base.where(value.isNotNull()).select(F.lit("NumericValue").alias("label"), F.concat_ws("::", "chunk_id", "local_id", F.lit("numeric")).alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("trim(id) <> ''").groupBy("label", "id").agg(F.count("*").alias("n_edges"))
