"""Reading a quantity from free text: numbers in several notations, ranges, bounds, and the spelling of units."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Spellings of unit parts, by symbol. A trailing * stands for any ending.
PARTS = """
mg: мг mg миллиграмм*; g: г g гр грамм*; kg: кг kg килограмм*; ug: мкг ug микрограмм*; t: т t тонн* tonne*;
l: л l дм3 dm3 литр* liter* litre*; ml: мл ml см3 cm3 миллилитр*; m3: м3 m3 кубм кубометр*;
h: ч h час часов часа часах hr hour*; min: мин min минут* minute*; s: с s сек sec секунд* second*; d: сут суток сутки d день дней дня day*;
pa: па pa паскал*; kpa: кпа kpa килопаскал*; mpa: мпа mpa мегапаскал*; bar: бар bar; atm: атм atm атмосфер*;
mmhg: ммртст mmhg торр torr; um: мкм um микрон* micron* микрометр*; mm: мм mm миллиметр*; cm: см cm сантиметр*; nm: нм nm нанометр*;
a: а a ампер*; ka: ка ka килоампер*; ma: ма ma миллиампер*; m2: м2 m2 квм; cm2: см2 cm2 квсм;
degc: °c °с degc градc градс градусовцельсия градусцельсия градцельсия цельсия; k: k к кельвин*; degf: °f f degf градф градусовфаренгейта фаренгейта
"""
# Words before a number that make it a bound.
UPPER = r"(?:≤|<=?|не\s+более|не\s+выше|не\s+больше|(?<!не\s)(?:менее|ниже)|at\s+most|up\s+to|less\s+than|below|максимум|max)\s*$"
LOWER = r"(?:≥|>=?|не\s+менее|не\s+ниже|не\s+меньше|(?<!не\s)(?:более|выше)|свыше|at\s+least|more\s+than|above|over|минимум|min)\s*$"
SCALES = {"тыс": 1e3, "млн": 1e6, "": 1.0}

_EXACT: dict[str, str] = {}
_STEMS: list[tuple[str, str]] = []
for _entry in PARTS.replace("\n", " ").split(";"):
    _symbol, _names = _entry.split(":")
    for _name in _names.split():
        if _name.endswith("*"):
            _STEMS.append((_name[:-1], _symbol.strip()))
        else:
            _EXACT[_name] = _symbol.strip()

_NUMBER = (
    r"(?:\d{1,3}(?:[     ]\d{3})+(?!\d)|\d+)(?:[.,]\d+)?"
    r"(?:\s*[·×xх*⋅]\s*10\s*\^?\s*[-+]?\d+|[eE][+-]?\d+)?(?:\s*(?:тыс|млн)\b\.?)?"
)
_FIRST = re.compile(rf"(?P<sign>минус\s+|minus\s+|(?<![\w.,])[-−–](?=\d))?(?P<num>{_NUMBER})", re.I)
_SECOND = re.compile(
    rf"\s*(?P<to>-|−|–|—|…|\.\.\.?|до\b|to\b|and\b|и\b)\s*(?P<sign>минус\s+|minus\s+|[-−–](?=\d))?(?P<num>{_NUMBER})", re.I
)
_AFTER = re.compile(r"\s*(?:в\s+среднем|on\s+average|in\s+average|среднее)\s*$", re.I)
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")


def _plain(text: str) -> str:
    """Superscripts after 10 get a caret, so that they stay exponents; compatibility forms are normalised."""
    text = text.replace("º", "°").replace("˚", "°")
    marked = re.sub(r"(?<=10)([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)", lambda m: "^" + m[1], text)
    return unicodedata.normalize("NFKC", marked.translate(_SUPER))


def number(text: str) -> float:
    """Value of one matched number."""
    m = re.fullmatch(r"([\d\s]+(?:[.,]\d+)?)\s*(?:[·×xх*⋅]\s*10\s*\^?\s*([-+]?\d+)|[eE]([+-]?\d+))?\s*(тыс|млн)?\.?", text, re.I)
    base, power, exp, scale = m.groups()
    digits = re.sub(r"\s", "", base).replace(",", ".")
    return float(f"{digits}e{power or exp or 0}") * SCALES[(scale or "").lower()]


def _part(text: str) -> str | None:
    found = _EXACT.get(text)
    if found:
        return found
    return next((symbol for stem, symbol in _STEMS if text.startswith(stem) and len(text) - len(stem) <= 3), None)


@lru_cache(65536)
def unit_symbols(spelling: str) -> tuple[str, ...]:
    """What a spelling can stand for, as symbols like 'mg/l'; empty if it is no known unit."""
    t = unicodedata.normalize("NFKC", spelling.replace("º", "°").replace("˚", "°")).strip().replace("μ", "u").replace("µ", "u")
    bare = t.strip(". ")
    if bare in ("С", "C"):
        return ("degc", "s")
    t = t.lower().replace("−", "-").replace("^", "")
    t = re.sub(r"\s+(?:на|в|per)\s+", "/", t)
    t = re.sub(r"[.\s]", "", t)
    t = re.sub(r"[·*⋅]([^/·*⋅]+)-1$", r"/\1", t)
    parts = [_part(p) for p in t.split("/")]
    return () if len(parts) > 2 or None in parts else ("/".join(parts),)


@lru_cache(65536)
def reading(text: str) -> tuple[float, float | None, str, str] | None:
    """(first, second, bound, unit spelling) of a text with a value; bound is '<', '>', '..' or ''. None if it has none."""
    t = _plain(text)
    first = _FIRST.search(t)
    if not first:
        return None
    before = " ".join(t[: first.start()].lower().split())
    if re.search(r"(?:^|\W)ph\W*$", before):
        return None
    a = number(first["num"].strip()) * (-1 if first["sign"] else 1)
    end, b = first.end(), None
    second = _SECOND.match(t, first.end())
    if second:
        b, end = number(second["num"].strip()) * (-1 if second["sign"] else 1), second.end()
    bound = ".." if second else "<" if re.search(UPPER, before) else ">" if re.search(LOWER, before) else ""
    if not bound and re.search(r"(?:^|\s)(?:до|to)$", before):
        bound = "<"
    unit = _AFTER.sub("", t[end:]).strip(" ,;")
    if unit == "г." and a == int(a) and 1800 <= a <= 2100:
        return None
    return a, b, bound, unit


def shown(low: float | None, high: float | None) -> str:
    """Rounded value, range or bound as text."""
    text = lambda x: "" if x is None else str(round(x) + 0)
    return text(low) if low == high else f"{text(low)}..{text(high)}"
