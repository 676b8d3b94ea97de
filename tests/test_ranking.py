"""Rankings of many questions over many documents: the same rows as DuckDB, and no row for each pair of them."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone import answer
from tests import oracle

N = 3000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts in which every word is common, some ids twice, one without an id and one without words."""
    g = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(g.choices(words, k=12)), " ".join(g.choices(words, k=6))) for i in range(N)]
    rows += [(i, " ".join(g.choices(words, k=12)), "word1 word2") for i in (7, 100, 100)] + [(None, "word3 word3 rare", "word3"), (N, "...", None), (N + 1, None, None)]
    path = tmp_path_factory.mktemp("ranking")
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, title string").selectExpr("*", "'s' AS source", "'en' AS lang", "'t' AS doc_type")
    texts.coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


def shuffled(spark, before=0):
    """Rows that all stages so far wrote for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size())) - before


def same_as_sql(name, folder, got, tables=("documents",)):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()[name]).df()
    assert len(want) and oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", ["bm25_okapi_topk", "bm25_topk", "binary_tf_bm25", "rrf_hybrid"])
def test_no_row_for_each_pair(spark, folder, name):
    entry.queries()["search_index"](spark, folder).collect()
    before = shuffled(spark)
    got = entry.queries()[name](spark, folder).toPandas()
    assert 0 < shuffled(spark, before) < N * N / 100 / 3
    same_as_sql(name, folder, got)


def test_no_row_for_each_pair_of_edges(spark, tmp_path):
    """The given facts many times over, one relation twice."""
    for name, key in (("llm_entities", "entity_row_id"), ("llm_relations", "relation_row_id")):
        rows = spark.read.parquet(f"{oracle.DATA}/{name}.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
        rows = rows.withColumns({key: rows[key] + rows["copy"] * 100_000, "chunk_id": F.concat("chunk_id", F.lit("-"), "copy")}).drop("copy")
        if name == "llm_relations":
            rows = rows.unionByName(rows.where(f"{key} in (100, 200, 201)"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = shuffled(spark)
    got = entry.queries()["edge_search_seed_boost"](spark, str(tmp_path)).toPandas()
    assert 0 < shuffled(spark, before) < 4 * spark.read.parquet(str(tmp_path / "llm_entities.parquet")).count()
    same_as_sql("edge_search_seed_boost", tmp_path, got, ("llm_entities", "llm_relations"))


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
def test_plan_of_answers_holds_the_edges_once(spark):
    """The joins that make the edges are run before, not planned again for each use of them."""
    df = entry.queries()["answers"](spark, oracle.DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 40 and "llm_entities.parquet" not in plan and df.count()


def test_facts_of_shared_names_are_cut_for_each_name(spark):
    """A hundred questions for one name meet its best facts only."""
    edges = spark.createDataFrame([(i, "A", "p", "b", "d", i % 50 / 50) for i in range(2000)], "relation_row_id long, s_name string, predicate string, t_name string, source_document string, confidence double")
    seeds = spark.createDataFrame([(q, n) for q in range(100) for n in ("a", "B")], "query_id long, name string")
    before = shuffled(spark)
    got = answer.graph_facts(seeds, edges, 3).collect()
    assert sorted(r["rank"] for r in got) == [1] * 100 + [2] * 100 + [3] * 100 and shuffled(spark, before) < 20_000
