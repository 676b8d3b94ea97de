import random

import pytest

from lodestone.llm import canonical
from lodestone.llm.canonical import BKTree, Matcher, damerau, levenshtein

GROUPS = [
    ("p1", "вакуумное рафинирование", ["ВРА", "вакуумное рафинирование", "vacuum refining", None, " "]),
    ("m1", "медно-цинковая пульпа", ["медно-цинковая пульпа", "copper-zinc pulp", "ЩЦБ"]), ("m2", "оборотный электролит", ["recirculated electrolyte", "ЩЦБ"]),
]
G = "canonical_id string, canonical_name string, aliases array<string>"


def _plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_distances_against_plain_tables():
    g = random.Random(4)
    w = lambda: "".join(g.choice("абвг") for _ in range(g.randint(0, 9)))
    for _ in range(300):
        a, b = w(), w()
        head, tail = w(), w()
        assert damerau(head + a + tail, head + b + tail) == damerau(a, b) == damerau(b, a)
        assert levenshtein(a, b) == _plain(a, b) and damerau(a, b) <= levenshtein(a, b) <= 2 * damerau(a, b)
    assert damerau("абв", "бав") == 1 and levenshtein("абв", "бав") == 2


def test_tree_finds_everything_within_the_radius():
    g = random.Random(6)
    keys = list({"".join(g.choice("abcde") for _ in range(g.randint(3, 9))) for _ in range(300)})
    keys.append("abc" * 30)
    asked = {"".join(g.choice("abcde") for _ in range(g.randint(3, 9))): g.randint(0, 3) for _ in range(60)} | {"abc" * 29 + "ab": 2, "": 3}
    got = sorted(BKTree(keys).within_all(asked))
    assert got == sorted((q, k) for q, r in asked.items() for k in keys if _plain(q, k) <= r)


def test_spellings():
    m = Matcher(tuple((i, a) for i, n, al in GROUPS for a in [n, *al] if a and a.strip()))
    one = lambda t: set(m.best([t])[0][2])
    for t in ("вакуумного рафинирования", "рафинирование, вакуумное", "vakuumnoe rafinirovanie", "Vacuum  refining [3]", "вакумное рафинировние", "вакуум. рафинирование", "вакуумное рафинирование (проба 7)", "вак. раф.", "рафинир. вакуум.", "вакум. рафинирование"):
        assert one(t) == {"p1"}, t
    for t in ("вакуумная экстракция", "температура", "", "медно-цинковый огарок", "вак. экстр."):
        assert one(t) == set(), t
    assert one("медно-цинковой пульпы") == one("медноцинк. пульпа") == one("мед.-цинк. пульпа") == {"m1"} and one("вра") == {"p1"} and len(one("ЩЦБ")) == 2


def test_many_abbreviations_stay_cheap():
    g = random.Random(9)
    word = lambda a: a + "".join(g.choice("abcdefgh") for _ in range(6))
    spellings = tuple((str(k), " ".join(word(a) for a in ("ka", "le", "mo"))) for k in range(3000))
    m = Matcher((*spellings, ("x", "kabumaro lekulano mosibeta")))
    assert m.best(["ka. le. mo.", "kabuma. lekul. mosibet."])[1] == (False, 1, ["x"]) and len(m.best(["ka. le. mo."])[0][2]) == 3001


def _map(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, name string, mentions array<string>, entry string, code string")
    groups = canonical.reference_spellings(spark.createDataFrame(GROUPS, G), "canonical_id", "canonical_name", "aliases")
    return {r.row_id: r.entry for r in canonical.mapped_rows(df, "id", "name", "mentions", groups).collect()}


def test_rows(spark):
    rows = [
        (1, "Вакуумнoe рафинирование", None, "x", "y"), (2, "поз. 12", ["оборотного электролита"], "x", "y"), (3, "ВРА", [], "x", "y"), (4, "ЩЦБ", None, "x", "y"),
        (5, None, ["вакуумное рафинирование"], "x", "y"), (6, "n/a", None, "x", "y"), (7, "ВРА", ["никелистая шихта"], "x", "y"),
        (8, "продукт12345678", [None, "copper-zinc pulp"], "x", "y"), (9, "продукт 12345678", ["copper-zinc pulp", "ВРА"], "x", "y"), (10, "вакуумное рафинирование" + " и очистка" * 4000, None, "x", "y"),
    ]
    assert _map(spark, rows) == {1: "p1", 2: "m2", 3: "p1", 4: None, 5: None, 6: None, 7: None, 8: "m1", 9: "m1", 10: None}
    assert _map(spark, []) == {}
    none = canonical.reference_spellings(spark.createDataFrame([(None, "медь", ["x"]), ("a", None, None)], G), "canonical_id", "canonical_name", "aliases")
    df = spark.createDataFrame([(1, "медь", None), (2, None, None)], "id bigint, name string, mentions array<string>")
    assert {r.row_id: r.entry for r in canonical.mapped_rows(df, "id", "name", "mentions", none).collect()} == {1: None, 2: None}


@pytest.mark.parametrize("shard", [1, 3, 20_000])
def test_shards_agree(spark, monkeypatch, shard):
    monkeypatch.setattr(canonical, "SHARD", shard)
    extra = [("t1", "графитовый анод", []), ("t2", "графитовый анид", []), ("t3", "Z7", []), ("t4", "цинковая суспензия", ["Z7"]), ("t5", "цинковый сустав", [])]
    monkeypatch.setitem(globals(), "GROUPS", GROUPS + extra)
    names = ["vacuum refinin", "оборотный електролит", "copper zinc pulp", "zzz", "графитовый ануд", "графитовый анод", "Z7", "ВРА", "цинк. сус.", "цинк. суспензия", "цинков. сустав"]
    want = ["p1", "m2", "m1", None, None, "t1", None, "p1", None, "t4", "t5"]
    assert _map(spark, [(k, t, None, "x", "y") for k, t in enumerate(names)]) == dict(enumerate(want))
