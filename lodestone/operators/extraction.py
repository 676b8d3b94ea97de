"""Model answers as records: recovery of JSON, typed parsing with quarantine, a deterministic stand-in for the model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = (
    "struct<entities:array<struct<local_id:string,type:string,canonical_name:string,mentions:array<string>,attributes:map<string,string>>>,"
    "relations:array<struct<subject:string,predicate:string,object:string,quote:string,note:string>>>"
)
#: Key words of the stand-in extractor with the type they imply (fixed values).
KEYWORDS = {"температур": "Parameter", "концентраци": "Parameter", "флотаци": "Process", "выщелачивани": "Process", "электролит": "Material", "реактор": "Equipment"}


_STEP = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text; braces in strings and escaped quotes don't count."""
    start = text.find("{") if text else -1
    while start >= 0:
        depth = 0
        for m in _STEP.finditer(text, start):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                return text[start : m.end()]
        start = text.find("{", start + 1)
    return None


def recovered_json(text: Column | str) -> Column:
    """The first JSON object of each answer; null where there is none."""

    @F.pandas_udf("string")
    def recover(texts: pd.Series) -> pd.Series:
        return texts.map(first_object, na_action="ignore")

    return recover(F.col(text) if isinstance(text, str) else text)


def parsed(answers: DataFrame, text: str) -> DataFrame:
    """Adds ``answer`` (typed, null where it doesn't parse).

    Nearly all answers parse from their first brace on, in the JVM; only those that don't, for prose with braces before the
    object or none at all, are read token by token.
    """
    quick = answers.withColumn("__quick", F.when(F.instr(text, "{") > 0, F.from_json(F.substring(F.col(text), F.instr(text, "{"), F.length(text)), ANSWER)))
    fine = F.coalesce(F.col("__quick.entities").isNotNull() | F.col("__quick.relations").isNotNull(), F.lit(False))
    slow = F.from_json(recovered_json(F.when(~fine, F.col(text))), ANSWER)  # only texts that need it cross to Python
    return quick.withColumn("answer", F.when(fine, F.col("__quick")).otherwise(slow)).drop("__quick")


def converted(records: DataFrame) -> DataFrame:
    """Per record (chunk_id, doc_id, status, answer): kept and rejected entities and relations.

    Records with another status than OK, SUCCESS or none, and such without chunk or document, are skipped. An entity
    needs a local id and a name; a relation needs both of its endpoints among the kept entities.
    """
    ok = F.upper(F.coalesce("status", F.lit("OK"))).isin("OK", "SUCCESS", "") & (F.trim("chunk_id") != "") & (F.trim("doc_id") != "")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    e = F.coalesce("answer.entities", F.array())
    r = F.coalesce("answer.relations", F.array())
    kept = F.filter(e, lambda x: ~blank(x["local_id"]) & ~blank(x["canonical_name"]))
    ids = F.transform(kept, lambda x: F.trim(x["local_id"]))
    joined = F.filter(r, lambda x: F.coalesce(F.array_contains(ids, F.trim(x["subject"])) & F.array_contains(ids, F.trim(x["object"])), F.lit(False)))
    return records.where(ok).select(
        "chunk_id", F.size(kept).alias("n_entities"), (F.size(e) - F.size(kept)).alias("n_bad_entities"), F.size(joined).alias("n_relations"),
        (F.size(r) - F.size(joined)).alias("n_bad_relations"),
    )


def rejections(entities: DataFrame, types: list[str]) -> DataFrame:
    """(chunk_id, n_entities, n_bad_types, n_repeated_ids, accepted): a record with an unknown type or a repeated id is rejected whole."""
    own = F.trim(F.coalesce("local_id", F.lit("")))
    by_id = entities.where("chunk_id is not null").groupBy("chunk_id", own.alias("id")).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.trim("type").isin(*types), F.lit(False))).alias("bad")
    )
    out = by_id.groupBy("chunk_id").agg(
        F.sum("n").alias("n_entities"), F.sum("bad").alias("n_bad_types"), F.count_if((F.col("id") != "") & (F.col("n") > 1)).alias("n_repeated_ids")
    )
    return out.withColumn("accepted", (F.col("n_bad_types") == 0) & (F.col("n_repeated_ids") == 0))


def short_quote(text: Column, mention: Column, before: int = 80, most: int = 240) -> Column:
    """``most`` characters from a little before the first occurrence of a mention; the text's beginning where it doesn't occur."""
    at = F.instr(F.lower(text), F.lower(mention))
    return F.trim(F.substring(text, F.when(at > before, at - before).otherwise(1), F.lit(most)))


FIELDS = {"source_document": ("source_file", "file"), "name": ("canonical_name", "entity", "label"), "type": ("entity_type", "kind")}


def one_dialect(records: DataFrame) -> DataFrame:
    """Records whose fields go by other names in some dialects (``FIELDS``): each field is the first of its names that has a value."""
    have = set(records.columns)
    pick = lambda own, others: F.coalesce(*[F.col(c) for c in (own, *others) if c in have], F.lit(None).cast("string"))
    rest = [c for c in records.columns if c not in FIELDS and c not in {x for v in FIELDS.values() for x in v}]
    return records.select(*rest, *[pick(own, others).alias(own) for own, others in FIELDS.items()])


def stand_in(text: Column | str) -> Column:
    """Array of (keyword, type) that a text names, in the order of the fixed list: what the stand-in extracts without a model."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    found = [F.when(low.contains(k), F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("type"))) for k, t in KEYWORDS.items()]
    return F.array_compact(F.array(*found))


def mention_issues(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity_row_id, mention): mentions that their chunk's text doesn't hold, blanks collapsed on both sides."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    m = entities.select("entity_row_id", "chunk_id", F.explode("mentions").alias("mention")).where("trim(mention) <> ''")
    t = chunks.groupBy("chunk_id").agg(F.max_by("text", "ingested_at").alias("text"))
    return m.join(t, "chunk_id").where(~F.contains(flat("text"), flat("mention"))).select("entity_row_id", "mention")
