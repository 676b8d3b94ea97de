import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import answer
from lodestone.operators import chunking, evaluation, extraction, glossary, graph, measurements, routing, search
from lodestone.sources import documents as sources


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B b", "text one. two! three", "| a | b |", "", "[IMAGE_1]", "long " * 30 + "."]), max_size=40))
def test_chunks_are_slices_in_order(lines):
    doc = "\n".join(lines)
    sizes = chunking.ChunkSizes(target=200, most=400, least=40, overlap_chars=80)
    got = chunking.chunk(doc, sizes)
    starts = [a for a, *_ in got]
    assert starts == sorted(starts) and all(0 <= a < b <= len(doc) for a, b, *_ in got)
    own = [(a + o, b) for a, b, o, *_ in got]
    assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
    covered = set().union(*[set(range(a, b)) for a, b in own]) if own else set()
    assert all(i in covered for i, c in enumerate(doc) if not c.isspace())


def test_chunk_rules():
    three = "---\na: b\nc: d\n---\n# T\n\n" + "\n\n".join(" ".join(f"Sentence {i} of it." for i in range(20)) for _ in range(3))
    got = chunking.chunk(three, chunking.ChunkSizes(target=500, most=800, least=50))
    assert got[1][2] > 0 and got[0][0] >= three.index("# T")
    table = "Before.\n\n" + "\n".join("| a | b |" for _ in range(40)) + "\n\nAfter."
    pieces = [table[a:b] for a, b, *_ in chunking.chunk(table, chunking.ChunkSizes(target=100, most=200, least=10))]
    assert sum("| a | b |" in p for p in pieces) == 1
    assert chunking.chunk("---\na: b\n---\n\n  \n", chunking.ChunkSizes()) == []
    assert [c[4] for c in chunking.chunk("# A\nx.\n## B\ny.\n## C\nz.", chunking.ChunkSizes(least=1))] == [["A"], ["A", "B"], ["A", "C"]]


def test_chunks_of_long_texts_take_linear_time():
    text = "Смена приняла сырьё и провела опыт. " * 30_000
    began = time.time()
    got = chunking.chunk(text, chunking.ChunkSizes())
    assert len(text) > 1_000_000 and time.time() - began < 3 and all(o <= 400 for _, _, o, *_ in got)
    assert chunking.body_start("---\na\n" * 200_000) == 10 and chunking.body_start("---\n" + "a\n" * 500_000) == 0


def test_short_chunks_and_leads():
    sizes = chunking.ChunkSizes(target=55, most=100, least=30, overlap_sentences=1, overlap_chars=40)
    text = "One is here. Two is there now. Three is a longer sentence than two. Four.\n### Head\n[IMAGE_1]\nFive comes after the picture and the head."
    got = chunking.chunk(text, sizes)
    assert [text[a + o : b] for a, b, o, *_ in got] == [
        "One is here. Two is there now.", "Three is a longer sentence than two. Four.\n### Head\n", "[IMAGE_1]\nFive comes after the picture and the head.",
    ] and [text[a : a + o] for a, _, o, *_ in got] == ["", "Two is there now. ", "Four.\n### Head\n"]
    assert [c[4] for c in got] == [[], [], ["Head"]]


def test_chunked_handles_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Some text. More."), (3, "Some text. More.")], "id int, text string")
    assert [r.doc_id for r in chunking.chunked(df, "id", "text").collect()] == ["3", "3"]


def test_json_recovery(spark):
    good = '{"entities": [{"local_id": "e1", "canonical_name": "a {b} \\" c", "type": "Material"}], "relations": [{"subject": "e1", "object": "e9"}]}'
    assert extraction.first_object(f"text ```json\n{good}\n``` more {{}}") == good
    assert extraction.first_object("no json") is None and extraction.first_object("{ open") is None and extraction.first_object(None) is None
    rows = [("c", "d", "ok", good), ("c2", "d", "FAILED", good), ("", "d", "OK", good), ("c3", "d", None, "nothing")]
    df = extraction.parsed(spark.createDataFrame(rows, "chunk_id string, doc_id string, status string, text string"), "text")
    got = {r.chunk_id: tuple(r)[1:] for r in extraction.converted(df).collect()}
    assert got == {"c": (1, 0, 0, 1), "c3": (0, 0, 0, 0)}


def test_numeric_expressions():
    text = "Концентрация не более 5,2 г/л, расход 10-12 м3/ч и pH 6,5–7,5 при 20 °C.\n| 5 | 6 мг/л |\nОбразец К2-14 и [12]."
    got = [(op, lo, hi, u) for _, _, op, lo, hi, u, _ in measurements.expressions(text)]
    assert got == [("<=", None, 5.2, "г/л"), ("range", 10.0, 12.0, "м3/ч"), ("range", 6.5, 7.5, "pH"), ("=", 20.0, 20.0, "°C")]


def test_spans_do_not_overlap(spark):
    groups = spark.createDataFrame([("g1", "copper zinc pulp", ["zinc pulp", None, " "]), ("g2", "zinc", ["Zinc"])], "canonical_id string, canonical_name string, aliases array<string>")
    texts = spark.createDataFrame([("t", "The copper-zinc pulp and zinc; Copper zinc pulp"), ("u", None), ("v", "")], "k string, x string")
    found = glossary.matches(texts, "k", "x", glossary.terms(groups))
    got = sorted((r.start, r.n_words, r.alias) for r in glossary.without_overlaps(found).collect())
    assert (5, 3, "copper zinc pulp") in got or (6, 3, "copper zinc pulp") in got
    taken = [i for s, n, _ in got for i in range(s, s + n)]
    assert len(taken) == len(set(taken))


def test_overlap_against_brute_force(spark):
    g = random.Random(1)
    gold = [("f", f"g{i}", (s := g.randint(0, 9000)), s + g.randint(1, 3000)) for i in range(40)]
    span = [("f", f"p{i}", (s := g.randint(0, 9000)), s + g.randint(1, 3000)) for i in range(60)]
    want = {(a[1], b[1]) for a in gold for b in span if (o := min(a[3], b[3]) - max(a[2], b[2])) > 0 and o >= 0.3 * (a[3] - a[2])}
    got = evaluation.overlaps(spark.createDataFrame(gold, "file string, gold_id string, s int, e int"), spark.createDataFrame(span, "file string, span_id string, s int, e int"), 500)
    assert {(r.gold_id, r.span_id) for r in got.collect()} == want


def test_reach_and_trails(spark):
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "d"), (5, "x", "y")]
    e = spark.createDataFrame(rows, "edge_id int, s string, t string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r.node, r.hop) for r in graph.reach(seeds, e, 4).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    trails = [tuple(r.edges) for r in graph.trails(seeds, e, 3).collect()]
    assert len(trails) == len(set(trails)) and all(len(set(t)) == len(t) for t in trails) and (1, 2, 3) in trails and (1, 2, 4) in trails
    assert graph.reach(seeds.limit(0), e, 2).count() == 0


def test_dense_top_k_is_exact(spark):
    g = random.Random(2)
    v = [(i, [g.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(v, "id long, e array<float>")
    got = {(r.query_id, r.rank): r.doc_id for r in search.dense_top_k(df, "id", "e", df.where("id % 100 = 0"), 5).collect()}
    unit = lambda x: [y / sum(z * z for z in x) ** 0.5 for y in x]
    for q in (0, 100, 200):
        s = sorted(((-round(sum(a * b for a, b in zip(unit(v[q][1]), unit(x), strict=True)), 4), i) for i, x in v))[:5]
        assert [got[(q, k + 1)] for k in range(5)] == [i for _, i in s]


def test_sources(spark):
    files = spark.createDataFrame([("a/x.part2.rar",), ("a/x.part1.rar",), ("a/y.zip",), ("b/z.7z.001",), ("b/z.7z.002",), ("b/n.txt",)], "p string")
    got = {(r.base, r.volumes, r.entry) for r in sources.archive_sets(files, "p").collect()}
    assert got == {("x", 2, "a/x.part1.rar"), ("y", 1, "a/y.zip"), ("z", 2, "b/z.7z.001")}
    heads = [(bytearray(b"%PDF-1.7 x"), "pdf"), (bytearray(b"\x89PNG\r\n"), "pdf"), (bytearray(b"<!DOCTYPE html>"), "pdf"), (bytearray(b"zzz"), "pdf"), (bytearray(b"zzz"), "zip")]
    df = spark.createDataFrame(heads, "c binary, x string").select(sources.signature("c", "x").alias("s"))
    assert [r.s for r in df.collect()] == ["match", "image", "html", "unknown", "unknown"]
    have = spark.createDataFrame([("old/a.pdf", 1), ("old/b.pdf", 2), ("old/c.pdf", 3)], "path string, size int")
    want = spark.createDataFrame([("n/a.pdf", 9), ("n/b.pdf", 2), ("m/b.pdf", 7), ("n/c.pdf", 8), ("m/c.pdf", 8)], "path string, size int")
    moves = {r.path: (r.target, r.ambiguous) for r in sources.relocations(have, want).collect()}
    assert moves == {"old/a.pdf": ("n/a.pdf", False), "old/b.pdf": ("n/b.pdf", False), "old/c.pdf": (None, True)}
    assert sources.first_non_empty([have.limit(0), want]).count() == 5


def test_markdown_reader_falls_back(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("Текст".encode())
    (tmp_path / "b.md").write_bytes("Текст".encode("cp1251"))
    assert [r.text for r in sources.read_markdown(spark, str(tmp_path)).collect()] == ["Текст", "Текст"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n\n{"a": 2}\n')
    rows = sources.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted(r.a for r in rows if r._corrupt_record is None) == [1, 2] and sum(r._corrupt_record is not None for r in rows) == 1


def test_answers(spark):
    asked = spark.createDataFrame([(1, "zinc pulp", "hybrid"), (2, "nothing", "no_data"), (3, "zinc", "rag_only")], "query_id long, question string, route string")
    seeds = spark.createDataFrame([(1, "Zinc"), (2, "Zinc")], "query_id long, name string")
    edges = spark.createDataFrame([(5, "zinc", "uses_material", "acid", 0.9, "d")], "relation_row_id long, s_name string, predicate string, t_name string, confidence double, source_document string")
    docs = spark.createDataFrame([(7, "zinc pulp text"), (8, "other")], "doc_id long, text string")
    got = {r.query_id: r.answer for r in answer.rendered(answer.dispatched(asked, seeds, edges, docs)).collect()}
    assert "uses_material" in got[1] and "zinc pulp text" in got[1] and "No data" in got[2] and "uses_material" not in got[3]
    assert answer.backend("unknown") is answer.backend("none") and "bm25" in answer.backends()
    calls = []
    research = answer.Research(lambda t, q: calls.append((t, q)) or [f"{t}:{q}"], budget=3)
    assert research.run("q", [("graph", "Q"), ("graph", "z")]) == ["graph:q", "documents:q"] and research.notes == ["repeated_query"]


def test_streaming_matches_batch(spark, tmp_path):
    from lodestone.operators.entities import clean_entities, upsert_nodes
    from lodestone.streaming import ingest

    schema = (
        "entity_row_id long, chunk_id string, source_document string, local_id string, type string, canonical_name string, mentions array<string>, attributes map<string,string>,"
        "page int, confidence double, extractor string, needs_review boolean, extracted_at timestamp, retracted_at timestamp"
    )
    from datetime import datetime

    rows = [(i, f"c{i % 3}", "d", "e", "Material", f"n{i % 4}", None, None, 1, 0.5, "x", False, datetime(2024, 1, 1 + i), None) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where(F.col("entity_row_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    q = ingest.node_stream(ingest.read_stream(spark, str(tmp_path / "in"), df.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "version=2"))
    want = upsert_nodes(clean_entities(df))
    key = lambda d: sorted((r.label, r.name, r.n_rows) for r in d.select("label", "name", "n_rows").collect())
    assert key(got) == key(want)


def test_glossary_takes_aliases_of_any_length(spark):
    long = "one two three four five six seven eight"
    groups = spark.createDataFrame([("g", long, ["six"])], "canonical_id string, canonical_name string, aliases array<string>")
    texts = spark.createDataFrame([(1, f"Zero {long} nine.")], "id int, text string")
    found = glossary.matches(texts, "id", "text", glossary.terms(groups))
    assert {(r.alias, r.start) for r in found.collect()} == {(long, 2), ("six", 7)}
    assert [(r.alias, r.start) for r in glossary.without_overlaps(found).collect()] == [(long, 2)]
    assert glossary.matches(texts, "id", "text", glossary.terms(groups.limit(0))).count() == 0


def test_candidates_keep_three_examples_of_hot_pairs(spark):
    rows = [(k, f"Вариант {k}: печь Ванюкова (ПВ) работает") for k in range(50)] + [(90, "ЭВ - электровыщелачивание меди"), (91, "рисунок печи (РП)"), (92, "медная пульпа / copper pulp"), (93, None)]
    got = {(r.a, r.b): r for r in glossary.candidates(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    hot = got["пв", "печь ванюкова"]
    assert (hot.n, hot.n_texts, hot.rank, hot.form) == (50, 50, 1, "abbreviation") and [e.split(":")[0] for e in hot.examples] == ["0", "1", "2"]
    assert got["эв", "электровыщелачивание меди"].form == "dash" and got["copper pulp", "медная пульпа"].form == "slash" and len(got) == 3


def test_front_matter_and_signatures(spark):
    df = spark.createDataFrame([("---\na: 1\na: 2\nb: x:y\n---\nBody",), ("---\n---\nx",), ("---\n" + "a\n" * 50_000,), ("no",), (None,)], "t string")
    n, keys = sources.front_matter("t")
    assert [tuple(r) for r in df.select(n.alias("n"), keys.alias("k")).collect()] == [(25, {"a": "2", "b": "x:y"}), (8, {}), (0, {}), (0, {}), (0, None)]
    files = [(b"%PDF-1", "pdf"), (b"PK\x03\x04", "docm"), (b"\xff\xd8", "pdf"), (b"GIF89a", "gif"), (b"\n <HTML>", "doc"), (b"", "pdf"), (b"PK\x03\x04", "txt")]
    got = spark.createDataFrame(files, "c binary, x string").select(sources.signature("c", "x").alias("k")).collect()
    assert [r.k for r in got] == ["match", "match", "image", "match", "html", "unknown", "unknown"]


def test_extraction_routes_and_fallbacks(spark):
    base = ("text", 0, 0, 0, 0.0)
    rows = [("", *base[1:]), ("Коротко.", *base[1:]), ("Это влияет и снижает.", 1, 4, 0, 0.0), ("Это влияет и снижает.", *base[1:]), ("x" * 5000, *base[1:]), ("а" * 400, 1, 4, 0, 0.0)]
    df = spark.createDataFrame(rows, "text string, n_ner int, ner_chars int, n_llm int, llm_confidence double")
    got = routing.extraction_route(df)
    assert [r.route for r in got.collect()] == ["skip", "natasha_only", "ensemble", "llm_only", "ensemble", "natasha_only"]
    after = got.withColumns({"n_entities": F.lit(2), "n_relations": F.lit(0), "result_confidence": F.lit(0.5)})
    assert [r.next_route for r in routing.fallback_route(after).collect()] == ["skip", "ensemble", "ensemble", "ensemble", "ensemble", "ensemble"]
    none = got.withColumns({"n_entities": F.lit(0), "n_relations": F.lit(0), "result_confidence": F.lit(0.0)})
    assert [r.next_route for r in routing.fallback_route(none).collect()] == ["skip", "llm_only", "llm_only", "ensemble", "llm_only", "llm_only"]
