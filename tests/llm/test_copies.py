import random
import re

from lodestone.llm import copies

S = "id bigint, chunk string, type string, name string, attributes map<string,string>, row_id string, h1 string"
norm = lambda x: re.sub(r"[^\w]|_", "", (x or "").lower())


def _found(spark, rows):
    df = copies.found_copies(spark.createDataFrame(rows, S), "chunk", "id", ["type", "name"], "name")
    return {tuple(r) for r in df.collect()}


def _brute(rows):
    groups = {}
    for i, c, t, n, *_ in rows:
        if c is not None and norm(n):
            groups.setdefault((c, norm(t), norm(n)), set()).add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_against_brute_force(spark):
    g = random.Random(5)
    names = ["Медный кек", "медный-кек", " МЕДНЫЙ  кек.", "медныйкек", "кек медный", "", None, "...", "a_b", "AB"]
    rows = [(k, g.choice(["c1", "c2", None]), g.choice(["Material", "material.", " MATERIAL", None, "Process"]), g.choice(names), None, "x", "y") for k in range(150)]
    assert _found(spark, rows) == _brute(rows)


def test_hot_group_repeats_and_empty(spark):
    rows = [(k % 300, "c", "T", "One Name" if k % 2 else "one name", None, "x", "y") for k in range(600)]
    assert _found(spark, rows) == {(0, k) for k in range(1, 300)}
    assert _found(spark, []) == set()


def test_order_of_attributes_does_not_count(spark):
    rows = [(1, "c", "T", "n", {"a": "1", "b": "2"}, "x", "y"), (2, "c", "t", "N", {"B ": "2.", "A": "1"}, "x", "y"), (3, "c", "T", "n.", {"a": "2", "b": "1"}, "x", "y"), (4, "c", "T", "m", None, "x", "y")]
    df = copies.collapsed(spark.createDataFrame(rows, S), "chunk", "id", ["type", "name"], "name", "attributes")
    assert {(r.first_id, r.n_copies, r.n_attribute_sets) for r in df.collect()} == {(1, 3, 2), (4, 1, 1)}


def test_collisions_are_separated(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(copies, "multiset_hash", lambda h: F.lit(7).cast("bigint"))
    rows = [(1, "c", "T", "a", None, "x", "y"), (2, "c", "T", "b", None, "x", "y"), (3, "c", "T", "B.", None, "x", "y"), (4, "c", "T", "A", None, "x", "y")]
    assert _found(spark, rows) == {(1, 4), (2, 3)}
