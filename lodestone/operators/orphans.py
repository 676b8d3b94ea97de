"""References to records that do not exist, kept as keyed state and advanced batch by batch.

The state is two logs, both keyed by (parent scope, parent id). ``advance`` takes the events of one period and appends to each
log only what the period's keys change, so a period writes in proportion to its own keys; the row of the latest version holds:

* the parent index: rows ever seen, rows still valid, and when the first still valid row arrived;
* the references: what each of them found, as a code, and what it had found before.

New references probe the index; a parent that arrives settles the waiting references of its key (they stay on record as
'late'); a deletion reopens those that relied on it. Only the keys that the period touches are evaluated again. Counts at the
end of every period are sums over the changes, so snapshots need no pass over the whole state. Everything is joined on the
key; aggregates combine before the shuffle, so a parent key repeated by a third of all rows becomes one index row, and a key
that a third of the references name is split by the adaptive skew join.

Defined results: null and blank references are none; blanks around ids don't count, case does; a reference whose scope
is null finds nothing ('missing'); unknown times lie before all others and are never 'late'; parents of unknown arrival can be
deleted like others; empty tables give empty results; repeated parents count as rows of their key; repeated reference ids give
one row for each distinct (id, slot).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.session import scratch_dir, written

KEY = ["scope", "parent_id"]
REF_KEY = ["ref_id", "slot", *KEY, "made_at"]


@dataclass(frozen=True)
class OrphanState:
    """Logs of the parent index and of the evaluated references after some period, and the number of that period."""

    index: DataFrame
    references: DataFrame
    version: int = 0


def parent_rows(df: DataFrame, scope: str, parent_id: str, row_id: str, arrived: str, deleted: str) -> DataFrame:
    """Parents in the operator's columns; rows without a usable id can't be referred to and are left out."""
    out = df.select(
        F.col(scope).alias("scope"), strip(parent_id).alias("parent_id"), F.col(row_id).alias("row_id"),
        F.col(arrived).alias("arrived_at"), F.col(deleted).alias("deleted_at"),
    )
    return out.where((F.col("parent_id") != "") & F.col("scope").isNotNull())


def reference_rows(df: DataFrame, scope: str, ref_id: str, made_at: str, slots: list[str]) -> DataFrame:
    """One row for each reference slot that holds an id."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), strip(s).alias("parent_id")) for s in slots])
    out = df.select(
        F.col(ref_id).alias("ref_id"), F.col(scope).alias("scope"), F.col(made_at).alias("made_at"), F.inline(pairs)
    )
    return out.where(F.col("parent_id") != "")


def _summary(parents: DataFrame, now: Column) -> DataFrame:
    valid = F.col("deleted_at").isNull() | (F.col("deleted_at") >= now)
    return parents.groupBy(*KEY).agg(
        F.count("*").alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        F.min(F.when(valid, F.col("arrived_at"))).alias("first_valid_at"),
    )


REASONS = ["missing", "deleted", "late"]  # by code, from 1; 0 is a reference whose parent was there in time


def _probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The references with the code of what they find."""
    code = (
        F.when(F.col("n_rows").isNull(), 1).when(F.col("n_valid") == 0, 2).when(F.col("first_valid_at") > F.col("made_at"), 3).otherwise(0)
    )
    return refs.join(index, KEY, "left").select(*refs.columns, code.alias("code"))


def _reason(code: Column) -> Column:
    return F.when(code == 1, REASONS[0]).when(code == 2, REASONS[1]).when(code == 3, REASONS[2])


def _within(col: str, lo, hi) -> Column:
    c, test = F.col(col), F.lit(True)
    if lo is not None:
        test = test & (c >= F.lit(lo))
    if hi is not None:
        test = test & (c < F.lit(hi))
    return (c.isNull() | test) if lo is None else test


def _latest_index(log: DataFrame) -> DataFrame:
    """The index rows of the latest version."""
    rest = ["n_rows", "n_valid", "first_valid_at"]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*KEY, "x.*")


def _latest_codes(log: DataFrame) -> DataFrame:
    """The references with the code of the latest version; version and code travel as one number, so it is a hash aggregate."""
    packed = F.max(F.col("version").cast("bigint") * 4 + F.col("code")).alias("packed")
    return log.groupBy(*REF_KEY).agg(packed).select(*REF_KEY, (F.col("packed") % 4).cast("int").alias("code"))


def advance(state: OrphanState | None, parents: DataFrame, refs: DataFrame, lo, hi, folder: str) -> OrphanState:
    """The state after the events from ``lo`` (None: the beginning) to before ``hi`` (None: the end).

    ``parents`` and ``refs`` are the logs of events; only the rows of the period are read into the state, and of the parents
    also the rows of keys that have a deletion in the period. What the period changes is written to ``folder``.
    """
    now = F.lit(hi).cast("timestamp_ntz") if hi is not None else F.lit("9999-12-31").cast("timestamp_ntz")
    version = 0 if state is None else state.version + 1
    marked = lambda df, name: written(df.withColumn("version", F.lit(version)), f"{folder}/{name}")
    new_refs = refs.where(_within("made_at", lo, hi)).distinct().select(*REF_KEY, F.lit(None).cast("int").alias("was"))
    delta = _summary(parents.where(_within("arrived_at", lo, hi)), now)
    if state is None:
        index = marked(delta, "index")
        return OrphanState(index, marked(_probe(new_refs, index), "references"))
    gone = _within("deleted_at", lo, hi) & F.col("deleted_at").isNotNull() & (F.col("arrived_at").isNull() | (F.col("arrived_at") < F.lit(lo)))
    reopened = written(parents.where(gone).select(*KEY).distinct(), f"{folder}/reopened")
    recount = _summary(parents.where(_within("arrived_at", None, hi)).join(reopened, KEY, "left_semi"), now)
    arrived = written(delta.join(reopened, KEY, "left_anti"), f"{folder}/arrived")
    known = _latest_index(state.index.join(arrived, KEY, "left_semi"))
    merged = known.unionByName(arrived).groupBy(*KEY).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_valid").alias("n_valid"), F.min("first_valid_at").alias("first_valid_at")
    )
    changed = marked(merged.unionByName(recount), "index")
    keys = changed.select(*KEY)
    again = _latest_codes(state.references.join(keys, KEY, "left_semi")).withColumnRenamed("code", "was")
    touched = _probe(again.unionByName(new_refs.join(keys, KEY, "left_semi")), changed).where(~F.col("code").eqNullSafe(F.col("was")))
    others = new_refs.join(keys, KEY, "left_anti")  # nothing happened to their keys in this period
    before = _latest_index(state.index.join(others.select(*KEY).distinct(), KEY, "left_semi"))
    found = marked(touched.unionByName(_probe(others, before)), "references")
    return OrphanState(state.index.unionByName(changed), state.references.unionByName(found), version)


def period_bounds(parents: DataFrame, refs: DataFrame, period: str) -> list:
    """Beginnings of the calendar periods that hold events, without the first; a handful of values."""
    at = parents.select(F.col("arrived_at").alias("at")).union(parents.select("deleted_at")).union(refs.select("made_at"))
    rows = at.where("at is not null").select(F.date_trunc(period, F.col("at")).cast("timestamp_ntz").alias("p")).distinct().collect()
    return sorted(r.p for r in rows)[1:]


def replay(parents: DataFrame, refs: DataFrame, period: str = "year"):
    """Advance through all periods in order; yields (end of the period or None, state)."""
    folder, state, lo = scratch_dir(parents.sparkSession, "orphans"), None, None
    for k, hi in enumerate([*period_bounds(parents, refs, period), None]):
        state = advance(state, parents, refs, lo, hi, f"{folder}/{k}")
        yield hi, state
        lo = hi


def references_now(state: OrphanState) -> DataFrame:
    """(ref_id, slot, scope, parent_id, made_at, reason) of every reference, as last evaluated."""
    return _latest_codes(state.references).select(*REF_KEY, _reason(F.col("code")).alias("reason"))


def orphans(parents: DataFrame, refs: DataFrame, period: str = "year") -> DataFrame:
    """ref_id, slot, made_at and reason of every reference in conflict after all periods."""
    for _, state in replay(parents, refs, period):
        pass
    return references_now(state).where("reason is not null").select("ref_id", "slot", "made_at", "reason").distinct()


def snapshots(parents: DataFrame, refs: DataFrame, period: str = "quarter") -> DataFrame:
    """Counts of references by slot and reason at the end of each period, as known then ('missing' ones have no parent yet)."""
    ends = []
    for hi, state in replay(parents, refs, period):
        ends.append(hi)
    log = state.references
    change = log.select("version", "slot", "code", F.lit(1).alias("n")).unionByName(
        log.where("was is not null").select("version", "slot", F.col("was").alias("code"), F.lit(-1).alias("n"))
    ).groupBy("version", "slot", "code").agg(F.sum("n").alias("n"))
    periods = parents.sparkSession.createDataFrame(list(enumerate(ends)), "known int, known_until timestamp_ntz")
    out = periods.join(F.broadcast(change), F.col("version") <= F.col("known")).groupBy("known", "known_until", "slot", "code").agg(F.sum("n").alias("n"))
    return out.where("n > 0").select("known_until", "slot", F.coalesce(_reason(F.col("code")), F.lit("found")).alias("reason"), "n")
