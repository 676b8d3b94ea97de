import pytest

from lodestone.llm import lookalikes

SCORES = {(a, b): -1.0 for w in ("^кек$", "^медный$", "^copper$", "^опыт$") for a, b in zip(w, w[1:], strict=False)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｃｏｐｐｅｒ", "copper"), ("кaльций", "кальций"), ("cоpper", "copper"), ("oпыт", "опыт"), ("a b c", "a b c"), ("мед­ный", "медный"),
        ("й", "й"), ("a‑b", "a-b"), ("ﬁne", "fine"), ("МPФЛ", "МРФЛ"), ("ﬁ１２", "fi12"),
    ],
)
def test_forms(text, want):
    assert lookalikes.consistent(text, SCORES) == want


@pytest.mark.parametrize("text", ["Опыт № 5", "«кек»", "a — b – c", "δ-форма", "x-лучи", "Ёлка", "", "two\twords\nhere  x", "К2-14"])
def test_already_consistent(text):
    assert lookalikes.consistent(text, SCORES) == text


def test_slots_and_nulls(spark):
    rows = [(1, "кек", ["кeк", None, "кек"], "x", 5), (2, None, None, "x", 5), (3, "cоpper", [], "x", 5), (3, "cоpper", [], "x", 5)]
    df = spark.createDataFrame(rows, "id bigint, name string, mentions array<string>, value string, slot int")
    got = sorted((r.row_id, r.slot) for r in lookalikes.inconsistent_slots(df, "id", "name", "mentions").collect())
    assert got == [(1, 1), (3, 0), (3, 0)]
    assert lookalikes.inconsistent_slots(df.limit(0), "id", "name", "mentions").count() == 0


def test_equal_looking_names_become_equal(spark):
    df = spark.createDataFrame([("кaльций",), ("кальций",), ("к­альций",)], "value string")
    assert {r.consistent for r in lookalikes.with_consistent(df).collect()} == {"кальций"}
