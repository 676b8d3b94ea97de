import math
import random

import pytest

from lodestone.llm import mixing, packing, tokens


def _sizes(spark, values):
    return spark.createDataFrame([(k, k, v) for k, v in enumerate(values)], "uid bigint, doc_id bigint, tokens bigint")


def test_every_token_once_and_no_container_too_full(spark):
    g = random.Random(3)
    values = [g.choice([0, 5, 50, 120, 300, 512, 700, 2100]) + g.randint(0, 9) for _ in range(1200)]
    rows = packing.pack(_sizes(spark, values), [512, 2048]).collect()
    for cap in (512, 2048):
        own = [r for r in rows if r.capacity == cap]
        per_doc, per_bin = {}, {}
        for r in own:
            per_doc[r.uid] = per_doc.get(r.uid, 0) + r["size"]
            per_bin[r.container] = per_bin.get(r.container, 0) + r["size"]
        assert per_doc == dict(enumerate(values)) and max(per_bin.values()) <= cap
        assert all(r.piece == 0 for r in own if values[r.uid] <= cap)
        assert len(per_bin) <= 1.05 * math.ceil(sum(values) / cap) + 2


def test_large_capacities_are_filled_too(spark):
    g = random.Random(4)
    values = [g.randint(1, 900) for _ in range(6000)]
    rows = packing.pack(_sizes(spark, values), spark.createDataFrame([(20_000,), (20_000,), (None,)], "capacity int")).collect()
    assert sum(r["size"] for r in rows) == sum(values) and len({r.container for r in rows}) <= math.ceil(sum(values) / 20_000) + 1


def test_hot_and_empty(spark):
    rows = packing.pack(_sizes(spark, [100] * 900), [512]).collect()
    assert len(rows) == 900 and len({r.container for r in rows}) == 180
    assert packing.pack(_sizes(spark, []), [512]).count() == 0 and packing.pack(_sizes(spark, [5]), [None, 0, -1]).count() == 0


def test_crossover_keeps_all_items():
    g = random.Random(1)
    sizes = [g.randint(1, 100) for _ in range(200)]
    a, b = packing._start(sizes, 128, g, True), packing._start(sizes, 128, g, False)
    child = packing.crossover(a, b, sizes, 128, g)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 128 for x in child)


def test_token_counts(spark):
    enc = tokens.encoder(tokens.TOKENIZER)
    texts = ["Медный кек, 5 г/л", "", None, "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.doc_id: r.tokens for r in tokens.sized(df, "id", "t").collect()}
    assert got == {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[0])) == texts[0]


M = "uid bigint, doc_id bigint, source string, tokens bigint, weight double, digest string"
T = "source string, target_share double, max_repeats int, tokens int, total int"


def test_shares_repeats_and_epochs(spark):
    g = random.Random(8)
    rows = [(k, k, "big" if k < 700 else "hot" if k < 1400 else "small", g.randint(20, 200), g.random() * 0.9 + 0.1, f"d{k}") for k in range(1500)]
    targets = spark.createDataFrame([("big", 0.5, 3, 1, 1), ("hot", 0.3, 2, 1, 1), ("small", 0.15, 2, 1, 1), ("none", 0.05, 1, 1, 1)], T)
    sizes = spark.createDataFrame(rows, M)
    chosen = mixing.selection(sizes, targets).collect()
    total = sum(r[3] for r in rows)
    size = {r[1]: r[3] for r in rows}
    used = {s: sum(size[c.doc_id] * c.times for c in chosen if c.source == s) for s in ("big", "hot", "small")}
    assert abs(used["big"] - 0.5 * total) < 20 and abs(used["hot"] - 0.3 * total) < 20
    assert used["small"] == 2 * sum(r[3] for r in rows if r[2] == "small") and max(c.times for c in chosen) == 2
    report = {r.source: r for r in mixing.shares(mixing.selection(sizes, targets), targets, sizes.selectExpr("sum(tokens) total")).collect()}
    assert report["none"].mix_tokens == 0 and report["none"].tokens_short > 0 and report["small"].most_repeats == 2


def test_budgets_are_filled_as_far_as_repeats_allow(spark):
    rows = [(0, 0, "s", 60, 1.0, "a"), (1, 1, "s", 45, 1.0, "b"), (2, 2, "t", 95, 1.0, "c")]  # s: budget 100 of 105
    targets = spark.createDataFrame([("s", 0.5, 2, 1, 1), ("t", 0.5, 2, 1, 1)], T)
    got = {c.doc_id: c.times for c in mixing.selection(spark.createDataFrame(rows, M), targets).collect()}
    used = 60 * got.get(0, 0) + 45 * got.get(1, 0)
    assert got[2] == 1 and used <= 100 and 100 - used < 45  # nothing that fits is left


def test_low_weights_spread_over_ranges(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(mixing.sample_key(F.col("id"), F.lit(0.1), 1).alias("key"))
    most = keys.groupBy(F.floor(F.log2("key") * mixing.PER_OCTAVE).alias("bucket")).count().agg(F.max("count").alias("n")).first().n
    assert most < 20_000 * 0.005


def test_heavier_texts_come_first(spark):
    rows = [(k, k, "s", 10, 1.0 if k % 2 else 0.1, f"d{k}") for k in range(2000)]
    targets = spark.createDataFrame([("s", 0.3, 1, 1, 1)], T)
    chosen = mixing.selection(spark.createDataFrame(rows, M), targets).collect()
    assert len(chosen) == 600 and sum(c.doc_id % 2 for c in chosen) > 450


def test_identical_texts_count_once(spark):
    rows = [(k, k, "s", 10, 1.0, "same") for k in range(50)] + [(99, 99, None, 10, 1.0, None), (98, 98, "s", 0, 1.0, "z")]
    targets = spark.createDataFrame([("s", 1.0, 3, 1, 1)], T)
    assert [(c.doc_id, c.times) for c in mixing.selection(spark.createDataFrame(rows, M), targets).collect()] == [(0, 3)]
    assert mixing.selection(spark.createDataFrame([], M), targets).count() == 0


@pytest.mark.parametrize(("text", "want"), [("abc", 1.0), ("1 2", 0.1), ("", 0.1), (None, 0.1)])
def test_quality(spark, text, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string").select(mixing.quality(F.col("t")).alias("q"))
    assert abs(df.first().q - want) < 1e-9
