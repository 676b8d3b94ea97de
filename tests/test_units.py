import pytest

from lodestone.functions.measures import reading, shown, unit_symbols
from lodestone.operators import units

REF = [
    ("мг/л", "concentration", "мг/л", 1.0, 0.0), ("г/л", "concentration", "мг/л", 1000.0, 0.0), ("°C", "temperature", "°C", 1.0, 0.0),
    ("с", "duration", "мин", 1 / 60, 0.0), ("мин", "duration", "мин", 1.0, 0.0), ("°F", "temperature", "°C", 5 / 9, -160 / 9), ("т", "mass", "кг", 1000.0, 0.0),
]
SCHEMA = "id bigint, doc string, name string, attributes map<string,string>, seq bigint, raw string, units string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("9076–11 341 мм рт. ст.", (9076, 11341, "..", "mmhg")), ("6,5·10^3 mg/L в среднем", (6500, None, "", "mg/l")), ("= 87×10³ µg/L", (87000, None, "", "ug/l")),
        ("17 тыс. … 21250 л/ч", (17000, 21250, "..", "l/h")), ("≥ 1,2 тыс. с", (1200, None, ">", "s")), ("составляет минус 39 °C", (-39, None, "", "degc")),
        ("не ниже 4,1 кА/м2", (4.1, None, ">", "ka/m2")), ("не выше 30 L/h", (30, None, "<", "l/h")), ("3 мг·л⁻¹", (3, None, "", "mg/l")),
        ("−38.2 deg F", (-38.2, None, "", "degf")), ("-5–-3 ºC", (-5, -3, "..", "degc")),
    ],
)
def test_reading(text, want):
    a, b, bound, unit = reading(text)
    assert (a, b, bound, unit_symbols(unit)[0]) == want


@pytest.mark.parametrize("text", ["pH 2,5", "в 2006 г.", "высокая", "", "2015 г."])
def test_no_reading(text):
    assert reading(text) is None


@pytest.mark.parametrize("unit", ["%", "мас.%", "к.о.", "баллов", "усл. ед.", ""])
def test_no_unit(unit):
    assert unit_symbols(unit) == ()


def test_shown():
    assert [shown(1.4, 1.4), shown(None, 3.0), shown(2.6, None), shown(1.0, 2.0), shown(-0.2, -0.2)] == ["1", "..3", "3..", "1..2", "0"]


def _run(spark, rows):
    seen = units.observations(spark.createDataFrame(rows, SCHEMA), "id", "doc", "name", "attributes", "seq")
    ref = spark.createDataFrame(REF, "unit_name string, quantity string, common_unit string, factor double, shift double")
    return sorted((r.row_id, r.quantity, r.common_value) for r in units.common_values(seen, ref).collect())


def test_conventions_and_ambiguous_unit(spark):
    rows = [
        (1, "d", "t", {"value_raw": "20..30 °C", "operator": "range"}, 1, None, None),
        (2, "d", "t", {"value": "25", "unit": "С"}, 2, None, None),
        (3, "d", "t", {"numeric_value": "77", "unit": "°F", "property_name": "t"}, 3, None, None),
        (4, "e", "время", {"value_raw": "120 с"}, 1, None, None),
        (5, "e", "время", {"value_raw": "180 С", "unit": None}, 2, None, None),
        (6, "e", "масса", {"value_raw": "5", "operator": "<=", "unit": "т"}, None, None, None),
        (7, None, None, {"value_raw": "7 г/л"}, 1, None, None),
        (8, "d", "x", None, 1, None, None), (9, "d", "x", {}, 1, None, None), (10, "d", "x", {"value_raw": "5 %"}, 1, None, None),
    ]
    assert _run(spark, rows) == [
        (1, "temperature", "20..30"), (2, "temperature", "25"), (3, "temperature", "25"), (4, "duration", "2"), (5, "duration", "3"), (6, "mass", "..5000"),
        (7, "concentration", "7000"),
    ]


def test_empty_and_repeated(spark):
    assert _run(spark, []) == []
    row = (1, "d", "t", {"value_raw": "20 °C"}, 1, None, None)
    assert _run(spark, [row, row]) == [(1, "temperature", "20")] * 2


def test_viterbi_follows_the_level():
    known = {"degc": ("temperature", 1.0, 0.0), "s": ("duration", 1 / 60, 0.0)}
    assert units.viterbi([(90.0, ["degc"]), (95.0, ["degc", "s"]), (92.0, ["degc"])], {"temperature": 0.5, "duration": 0.5}, known) == ["degc"] * 3
    assert units.viterbi([], {}, known) == []


def test_switches_under_one_spelling_are_decoded_from_jumps(spark):
    smooth = [40.0 + (k * 7) % 5 for k in range(40)]
    recorded = [v / 1000 if 12 <= k < 24 else v for k, v in enumerate(smooth)]  # recorded in г/л while мг/л is written
    rows = [(k, "d", "x", {"value": f"{v:.4f}", "unit": "мг/л"}, k, None, None) for k, v in enumerate(recorded)]
    assert [v for _, _, v in _run(spark, rows)] == [str(round(v)) for v in smooth]
    wild = [(k, "w", "x", {"value": f"{10 ** (k * 7 % 5 - 1)}", "unit": "мг/л"}, k, None, None) for k in range(40)]
    assert [v for _, _, v in _run(spark, wild)] == [str(round(10 ** (k * 7 % 5 - 1))) for k in range(40)]
    grown = [(k, "g", "x", {"value": "5" if k < 60 else "5000", "unit": "мг/л"}, k, None, None) for k in range(120)]
    assert [v for _, _, v in _run(spark, grown)] == ["5"] * 60 + ["5000"] * 60


def test_every_reference_unit_counts(spark):
    ref = spark.createDataFrame([(f"unknown {k}", "q", "x", 1.0, 0.0) for k in range(20_000)] + REF, "unit_name string, quantity string, common_unit string, factor double, shift double")
    assert len(units.unit_table(ref)) == len(REF)
