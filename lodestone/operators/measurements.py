"""Numeric expressions in running text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import LOWER, UPPER, number
from lodestone.session import spread

#: Units in running text (fixed values); longer spellings come first when the pattern is made.
UNITS = (
    "% °C г/л мг/л мг/дм3 кг/т т/сут т/год кг/ч м3/ч м3/сут А/м2 кА/м2 мкм мм см м м3 кг г мг т МПа кПа Па бар атм об/мин мин ч сут месяцев часов суток "
    "g/L mg/L kg/t t/d A/m2 m3 microns months hours h µm mm kg °F K"
)
#: Stems of parameter names that may precede a value (fixed values).
PARAMETERS = (
    "содержани концентраци температур давлени скорост расход плотност напряжени потенциал овп влажност размер степень извлечени выход "
    "остаток минерализаци ph"
)
_U = "|".join(re.escape(u) for u in sorted(UNITS.split(), key=len, reverse=True))
_N = r"[-−–]?\d+(?:[   ]\d{3})*(?:[.,]\d+)?"
EXPRESSION = re.compile(rf"(?<![\w.,/#№-])(?P<a>{_N})(?:\s*(?:-|–|—|…|до|to)\s*(?P<b>{_N}))?\s*(?P<u>{_U})(?![\w/])")
PH = re.compile(rf"(?<!\w)(?:pH|рН)\s*(?:[=:<>≤≥~]\s*)?(?P<a>{_N})(?:\s*[-–—]\s*(?P<b>{_N}))?", re.I)
_PARAM = re.compile("|".join(PARAMETERS.split()), re.I)
#: Pattern that every regex engine reads, for counts.
SIMPLE = r"([0-9]+(?:[.,][0-9]+)?) ?(мг/л|г/л|кг/т|т/сут|А/м2|мкм|об/мин|mg/L|g/L|kg/t|t/d|A/m2|microns|°C|%)"
SCHEMA = "row_key string, start int, stop int, operator string, low double, high double, unit string, parameter string"


def expressions(text: str) -> list[tuple]:
    """(start, end, operator, low, high, unit, parameter) of the values of a text, in order, without overlaps and outside tables."""
    tables = [(m.start(), m.end()) for m in re.finditer(r"(?m)^\s*\|.*\|\s*$", text)]
    found = []
    for pattern, unit in ((PH, "pH"), (EXPRESSION, None)):
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(a <= s < b for a, b in tables) or any(a < e and s < b for a, b, *_ in found):
                continue
            low = number(m["a"].lstrip("-−–")) * (-1 if m["a"][0] in "-−–" else 1)
            high = number(m["b"].lstrip("-−–")) if m["b"] else None
            before = text[max(0, s - 120) : s].lower()
            op = "range" if high is not None else "<=" if re.search(UPPER, before.rstrip()) else ">=" if re.search(LOWER, before.rstrip()) else "~" if re.search(r"(?:около|примерно|порядка|about|≈|~)\s*$", before) else "="
            names = _PARAM.findall(re.split(r"[\n|.;]", before)[-1])
            found.append((s, e, op, None if op == "<=" else low, high if high is not None else None if op == ">=" else low, unit or m["u"], names[-1].lower() if names else None))
    return sorted(found)


def extracted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """All numeric expressions of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *x) for k, t in zip(b["row_key"], b["text"], strict=True) for x in expressions(t)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spread(rows.where(f"{text} is not null").selectExpr(f"cast({key} as string) as row_key", f"{text} as text")).mapInPandas(run, SCHEMA)


def simple_values(text: Column | str) -> Column:
    """Matches of ``SIMPLE`` as an array of texts."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(SIMPLE), F.lit(0))


def labels(values: Column, shown: int = 16) -> Column:
    """Distinct values in one line, in order; the number of those left out, repeated ones included, follows."""
    first = F.slice(F.array_distinct(values), 1, shown)
    more = F.when(F.size(values) > F.size(first), F.concat(F.lit("; ... +"), (F.size(values) - F.size(first)).cast("string"))).otherwise("")
    return F.when(F.size(values) == 0, "—").otherwise(F.concat(F.array_join(first, "; "), more))
