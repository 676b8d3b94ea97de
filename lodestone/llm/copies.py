"""Duplicates hidden by formatting, found with a commutative multiset hash.

Every (field name, normalised value) pair is hashed on its own; the hashes are added in two independent 60-bit lanes,
so neither the order of fields nor the order of map entries matters while repeated pairs still count. Rows are grouped
by scope and fingerprint with hash aggregation (no sorting, combined before the shuffle, so a set of copies that holds a third
of all rows travels as one row for each map task). The normalised fields are part of the group's key behind the fingerprint,
so their equality is verified and a hash collision can't merge different records.

Defined results: null and empty values are equal to each other; a row whose required fields hold no letter or digit is
left out; repeated row ids count as one row each time they occur but list only once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import letters_digits
from lodestone.session import scratch_dir, written

_MASK = (1 << 60) - 1


def pair_hashes(fields: list[str], attributes: str | None, seed: int) -> Column:
    """Array of one hash for each field-value pair."""
    own = F.array(*[F.xxhash64(F.lit(seed), F.lit(f), F.col(f)) for f in fields])
    if attributes is None:
        return own
    entries = F.transform(
        F.map_entries(F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))),
        lambda e: F.xxhash64(F.lit(seed), F.lit("@"), letters_digits(e["key"]), letters_digits(e["value"])),
    )
    return F.concat(own, entries)


def multiset_hash(hashes: Column) -> Column:
    """Order-free sum of hashes modulo 2^60 (it never overflows a BIGINT)."""
    mask = F.lit(_MASK)
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: (a + h.bitwiseAND(mask)).bitwiseAND(mask))


def fingerprinted(df: DataFrame, scope: str, row_id: str, fields: list[str], attributes: str | None = None) -> DataFrame:
    """row_id, scope, the normalised fields as f0.., and the two lanes of the fingerprint."""
    names = [f"f{i}" for i in range(len(fields))]
    out = df.select(
        F.col(row_id).alias("row_id"), F.col(scope).alias("scope"),
        *[letters_digits(f).alias(n) for f, n in zip(fields, names, strict=True)],
        *([F.col(attributes).alias("attributes")] if attributes else []),
    )
    a = "attributes" if attributes else None
    return out.withColumns({f"h{k}": multiset_hash(pair_hashes(names, a, k)) for k in (1, 2)})


def copy_groups(df: DataFrame, scope: str, row_id: str, fields: list[str], required: str) -> DataFrame:
    """(row_id, first_id, scope) of every row that shares its normalised fields with another row of its scope.

    ``first_id`` is the smallest id of the group. ``required`` is the field that has to hold a letter or digit. The rows are
    normalised and hashed once; groups are made by the fingerprint first, and what shares one is held against the fields.
    """
    names = [f"f{i}" for i in range(len(fields))]
    rows = fingerprinted(df, scope, row_id, fields).where(F.col(f"f{fields.index(required)}") != "").where(F.col("scope").isNotNull())
    rows = written(rows, scratch_dir(df.sparkSession, "fingerprints"))
    key = ["scope", "h1", "h2", *names]  # the fields stand behind the fingerprint: equal hashes alone don't make a group
    groups = rows.groupBy(*key).agg(F.min("row_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups.hint("shuffle_hash"), key).select("row_id", "first_id", "scope")


def found_copies(df: DataFrame, scope: str, row_id: str, fields: list[str], required: str) -> DataFrame:
    """(first_id, copy_id) for each copy other than the first of its group."""
    out = copy_groups(df, scope, row_id, fields, required).where("row_id <> first_id")
    return out.select("first_id", F.col("row_id").alias("copy_id")).distinct()


def collapsed(df: DataFrame, scope: str, row_id: str, fields: list[str], required: str, attributes: str) -> DataFrame:
    """One row for each distinct record: its smallest id, its number of copies, and how many distinct attribute sets
    they have (the order and formatting of attributes don't count)."""
    names = [f"f{i}" for i in range(len(fields))]
    bag = F.transform(
        F.map_entries(F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))),
        lambda e: F.xxhash64(F.lit(3), letters_digits(e["key"]), letters_digits(e["value"])),
    )
    rows = df.select(
        F.col(row_id).alias("row_id"), F.col(scope).alias("scope"), multiset_hash(bag).alias("bag"),
        *[letters_digits(f).alias(n) for f, n in zip(fields, names, strict=True)],
    ).where(F.col(f"f{fields.index(required)}") != "")
    rows = rows.withColumns({f"h{k}": multiset_hash(pair_hashes(names, None, k)) for k in (1, 2)})
    by_bag = rows.groupBy("scope", "h1", "h2", "bag", *names).agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    return by_bag.groupBy("scope", "h1", "h2", *names).agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("n_copies"), F.count("*").alias("n_attribute_sets")
    ).select("first_id", "scope", "n_copies", "n_attribute_sets")
