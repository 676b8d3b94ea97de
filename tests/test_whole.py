"""Traversals, overlaps and seeds over every row, against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import graph
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
SPANS = "SELECT DISTINCT chunk_id, provenance.source_document, provenance.char_start, provenance.char_end FROM chunks"


def test_overlaps_of_every_chunk(spark):
    spans = [x for x in oracle.connection().execute(SPANS).fetchall() if None not in x and x[3] > x[2]]
    shared = {(f, a, b): (min(e, y) - max(s, x), e - s) for a, f, s, e in spans for b, g, x, y in spans if f == g and min(e, y) > max(s, x)}
    got = {(r.file, r.gold_id, r.span_id): r.shared for r in entry.queries()["overlap_all"](spark, oracle.DATA).collect()}
    assert got == {k: n for k, (n, size) in shared.items() if n >= 0.3 * size}
    assert {a for _, a, _ in got} == {x[0] for x in spans}
    best = {}
    for (f, a, b), (n, size) in shared.items():
        if a != b and n >= 0.05 * size:
            best[f, a] = min(best.get((f, a), (0, "")), (-n, b))
    got = {(r.file, r.gold_id): (-r.shared, r.span_id) for r in entry.queries()["overlap_match"](spark, oracle.DATA).collect()}
    assert got == best and any(not a.endswith("0") for _, a in got)


def test_trails_are_counted_as_enumerated(spark):
    g = random.Random(3)
    rows = [(i, *g.sample("abcdef", 2)) for i in range(30)] + [(90, "x", "y"), (91, "y", "z")]
    e = spark.createDataFrame(rows, "edge_id int, s string, t string")
    seeds = spark.createDataFrame([("a",), ("b",), ("x",), ("none",)], "seed string")
    for hops in (1, 2, 3):
        want = graph.trails(seeds, e, hops).groupBy("seed", "node", F.size("edges").alias("hops")).count().collect()
        assert {tuple(r) for r in graph.trail_counts(seeds, e, hops).select("seed", "node", "hops", "n_trails").collect()} == {tuple(r) for r in want}


def test_seeds_contain_terms_anywhere(spark):
    names = spark.createDataFrame([("Two-stage separation",), ("Hydrometallurgy",), ("ab",)], "name string")
    terms = spark.createDataFrame([(1, "two-stage"), (1, "metal"), (1, "metal")], "query_id long, term string")
    assert {tuple(r) for r in graph.fuzzy_seeds(names, terms).collect()} == {(1, "Two-stage separation", 9), (1, "Hydrometallurgy", 5)}


def test_exact_seeds_come_first(spark):
    names = spark.createDataFrame([("M::a b", "A b"), ("M::ab", "ab"), ("M::xyz", "xyz")], "node string, name string")
    exact = spark.createDataFrame([(1, "a b"), (2, "none")], "query_id long, exact string")
    fuzzy = spark.createDataFrame([(1, "ab", 2), (2, "xyz", 3)], "query_id long, name string, score long")
    assert {tuple(r) for r in graph.seeded(names, exact, fuzzy).collect()} == {(1, "M::a b", "exact"), (2, "M::xyz", "terms")}
