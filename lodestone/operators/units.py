"""Values of one quantity in different units, converted to common units.

Each measured value is read from its text; the spelling of its unit names the units that it can stand for. A hidden
Markov model for each device (a source's series of one property, in order) has the unit as its hidden state. A spelling
emits the units it names freely and any other unit of their quantities at a cost (``MISLABELLED``, for values recorded in
another unit than the one written); staying in a unit is likelier than a switch; and the logarithm of the value in the common
unit stays near the smooth level of the series, as far as the series itself is smooth: the spread of its jumps is measured
in each segment. Viterbi decodes the units, so a run of values that jumps by a unit's factor and back under one spelling is
read in the unit that keeps the level, while series that scatter over decades keep what is written. Ambiguous spellings follow
the level and the quantity that the property has elsewhere; those shares are counted over all rows.

Series are cut into segments of ``SEGMENT`` positions, so no series grows without bound; a decoder sees one sorted
segment at a time and the level starts anew with each.

Defined results: values without a unit or with an unknown one (percentages, scores, pH, calendar years) give no row;
null attributes give none; repeated rows give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import reading, shown, unit_symbols
from lodestone.functions.text import letters_digits
from lodestone.session import scratch_dir, spread, written

SEGMENT = 256
VALUE_KEYS = ["value_raw", "value", "numeric_value"]
STAY, SWITCH, MISLABELLED, STILL_MISLABELLED, FAREST = math.log(0.9), math.log(0.1), 8.0, 1.0, 60.0
# Spread of the jumps of a series in decades: for short series, the least one, and the widest at which jumps can tell units.
SPREAD, LEAST_SPREAD, SMOOTH, ENOUGH = 1.5, 0.05, 0.3, 8
_PARSED = "row_id bigint, device string, property string, segment bigint, seq bigint, low double, high double, units array<string>"


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(symbol=[next(iter(unit_symbols(x)), None) for x in rows["unit_name"]])


def unit_table(reference: DataFrame) -> dict[str, tuple[str, float, float]]:
    """Symbol → (quantity, factor, shift); one row for each symbol, and symbols are at most the square of the known unit parts."""
    units = reference.where("unit_name is not null").select("unit_name", "quantity", "factor", "shift")
    named = units.mapInPandas(_symbols, "unit_name string, quantity string, factor double, shift double, symbol string")
    rows = named.where("symbol is not null").groupBy("symbol").agg(F.min(F.struct("quantity", "factor", "shift")).alias("u")).collect()
    return {r.symbol: (r.u.quantity, r.u.factor, r.u.shift) for r in rows}


def observations(df: DataFrame, row_id: str, device: str, name: str, attributes: str, position: str) -> DataFrame:
    """Rows whose attributes hold a value text, with device, property and place in the series."""
    get = lambda k: F.try_element_at(F.col(attributes), F.lit(k))
    raw = F.coalesce(*[F.when(F.trim(get(k)) != "", get(k)) for k in VALUE_KEYS])
    seq = F.coalesce(F.col(position).cast("bigint"), F.lit(0))
    return df.select(
        F.col(row_id).alias("row_id"), F.coalesce(device, F.lit("")).alias("device"), letters_digits(name).alias("property"),
        (seq / SEGMENT).cast("bigint").alias("segment"), seq.alias("seq"), raw.alias("raw"), get("unit").alias("unit"),
        get("operator").alias("operator"),
    ).where("raw is not null").where(F.col("raw").rlike(r"\d"))


def _parser(known: dict[str, tuple[str, float, float]]):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                read = reading(r.raw)
                if not read:
                    continue
                a, b, bound, spelling = read
                units = [u for u in unit_symbols(spelling or (r.unit or "")) if u in known]
                if not units:
                    continue
                if not bound and r.operator in ("<=", "<", ">=", ">"):
                    bound = r.operator[0]
                low, high = {"..": (a, b), "<": (None, a), ">": (a, None), "": (a, a)}[bound]
                out.append((r.row_id, r.device, r.property, r.segment, r.seq, low, high, units))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.split(", ")])

    return parse


def level_of(value: float, unit: tuple[str, float, float]) -> float:
    return math.log10(max(abs(value * unit[1] + unit[2]), 1e-9))


def spread_of(series: list[tuple[float, list[str]]], known: dict) -> float:
    """The jump that four fifths of the neighbours stay within, by the units written; ``SPREAD`` for short series."""
    levels = [level_of(v, known[u[0]]) for v, u in series]
    jumps = [j for a, b in zip(levels, levels[1:], strict=False) if (j := abs(b - a)) > 1e-9]  # copies of a value show nothing
    return max(LEAST_SPREAD, 1.5 * statistics.quantiles(jumps, n=5)[-1]) if len(jumps) >= ENOUGH else SPREAD


def viterbi(series: list[tuple[float, list[str]]], shares: dict[str, float], known: dict) -> list[str]:
    """Most likely units of a series of (value, units that the spelling names), given each quantity's share for this property."""
    spread_ = spread_of(series, known)
    column: dict[str, tuple[float, float, tuple | None]] = {}
    written_before: list[str] = []
    for value, units in series:
        others = [u for u in known if u not in units and known[u][0] in {known[x][0] for x in units}] if spread_ <= SMOOTH else []
        nxt = {}
        for u in [*units, *others]:
            level = level_of(value, known[u])
            emit = math.log(shares.get(known[u][0], 0.0) + 0.01)
            best = None
            for last, (score, before, path) in column.items():
                far = 0.5 * ((level - before) / spread_) ** 2
                jump = -min(FAREST, far) if known[last][0] == known[u][0] else -4.0
                wrong = 0.0 if u in units else STILL_MISLABELLED if last == u and u not in written_before else MISLABELLED
                total = score + emit + jump - wrong + (STAY if last == u else SWITCH)
                if best is None or total > best[0]:
                    best = (total, level if far >= FAREST else before + 0.5 * (level - before), (u, path))
            nxt[u] = best or (emit - (0.0 if u in units else MISLABELLED), level, (u, None))
        column, written_before = nxt, units
    path, out = max(column.values(), key=lambda x: x[0])[2] if column else None, []
    while path:
        u, path = path
        out.append(u)
    return out[::-1]


def _decoder(known: dict[str, tuple[str, float, float]]):
    def decoded(rows: list) -> Iterator[tuple]:
        values = [r.low if r.low == r.low and r.low is not None else r.high for r in rows]
        shares = dict(zip(rows[0].quantities, rows[0].shares, strict=True)) if rows[0].quantities is not None else {}
        units = viterbi([(v, list(r.units)) for v, r in zip(values, rows, strict=True)], shares, known)
        for r, u in zip(rows, units, strict=True):
            quantity, factor, shift = known[u]
            low, high = (None if x is None or x != x else x * factor + shift for x in (r.low, r.high))
            yield r.row_id, quantity, shown(low, high)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if (r.device, r.property, r.segment) != key:
                    out.extend(decoded(held)) if held else None
                    key, held = (r.device, r.property, r.segment), []
                held.append(r)
            yield pd.DataFrame(out, columns=["row_id", "quantity", "common_value"])
        if held:
            yield pd.DataFrame(list(decoded(held)), columns=["row_id", "quantity", "common_value"])

    return decode


def common_values(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """(row_id, quantity, common_value) of each observation whose unit is known."""
    known = unit_table(reference)
    spark = observed.sparkSession
    parsed = written(spread(observed).mapInPandas(_parser(known), _PARSED), scratch_dir(spark, "units"))
    quantity = F.create_map(*[F.lit(x) for s, (q, _, _) in known.items() for x in (s, q)]) if known else F.create_map()
    sure = parsed.where(F.size("units") == 1).groupBy("property", F.try_element_at(quantity, F.col("units")[0]).alias("quantity")).count()
    shares = sure.groupBy("property").agg(
        F.collect_list(F.struct("quantity", "count")).alias("found"), F.sum("count").alias("total")
    ).select(
        "property", F.col("found.quantity").alias("quantities"),
        F.transform("found", lambda x: x["count"] / F.col("total")).alias("shares"),
    )
    series = spread(parsed.join(shares, "property", "left"), "device", "property", "segment")
    ordered = series.sortWithinPartitions("device", "property", "segment", "seq", "row_id")
    return ordered.mapInPandas(_decoder(known), "row_id bigint, quantity string, common_value string")
