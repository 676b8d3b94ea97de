"""Traversal and filters on the fact graph.

Reachability expands a frontier hop by hop and keeps each (seed, node) once with its least number of hops, so hubs don't
multiply. Trails (edges not repeated) are enumerated only where they are asked for, with the number of hops fixed; their
numbers alone come from walks counted for each (seed, node), which stay few however many trails there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.entities import node_key
from lodestone.session import scratch_dir, written


def graph_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, s, t, predicate, confidence, source_document, quote) with graph-wide node ids; loops are left out."""
    return edges.select(
        F.col("relation_row_id").alias("edge_id"), node_key("s_type", "s_name").alias("s"), node_key("t_type", "t_name").alias("t"),
        "predicate", "confidence", "source_document", "quote",
    ).where("s <> t")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions as (edge_id, a, b)."""
    return edges.select("edge_id", F.col("s").alias("a"), F.col("t").alias("b")).unionByName(
        edges.select("edge_id", F.col("t").alias("a"), F.col("s").alias("b"))
    )


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): every node within ``hops`` of each seed, with the least number of hops."""
    hops = min(max(hops, 1), 4)
    folder = scratch_dir(edges.sparkSession, "reach")
    steps = written(undirected(edges).select("a", "b").distinct(), f"{folder}/steps")
    known = written(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")), f"{folder}/0")
    for k in range(1, hops + 1):
        front = known.where(F.col("hop") == k - 1).join(steps, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        new = front.join(known, ["seed", "node"], "left_anti").withColumn("hop", F.lit(k))
        known = written(known.unionByName(new), f"{folder}/{k}")
    return known


def trails(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, edges): every trail of up to ``hops`` edges from each seed; no edge twice."""
    steps = undirected(edges)
    front = seeds.join(steps, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("node"), F.array("edge_id").alias("edges"))
    out = front
    for _ in range(min(max(hops, 1), 4) - 1):
        nxt = front.join(steps, F.col("node") == F.col("a")).where(~F.array_contains("edges", F.col("edge_id")))
        front = nxt.select("seed", F.col("b").alias("node"), F.array_append("edges", F.col("edge_id")).alias("edges"))
        out = out.unionByName(front)
    return out


def related(trail_rows: DataFrame) -> DataFrame:
    """Nodes other than the seed by the number of distinct trails that lead to them."""
    rows = trail_rows.where("node <> seed")
    return rows.groupBy("seed", "node").agg(F.count("*").alias("n_trails"), F.min(F.size("edges")).alias("hops"))


def trail_counts(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops, n_trails): how many trails of one, two and up to three edges lead from each seed to each node.

    Exact, without enumeration: walks by the number m of parallel edges, less those that repeat an edge. Of two edges
    these are the ways there and back; of three, those whose first and second (the seed's degree times m), second and third
    (the node's degree times m) or first and third edge (m times m) are the same, those of one edge only counted once.
    Needs edges without loops and one row for each edge.
    """
    if hops not in (1, 2, 3):
        raise ValueError("trails are counted for one to three hops")
    folder = scratch_dir(edges.sparkSession, "trails")
    m = written(undirected(edges).groupBy("a", "b").agg(F.count("*").alias("m")), f"{folder}/steps")
    degree = m.groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("degree"))

    def on(walks: DataFrame) -> DataFrame:
        nxt = walks.join(m, F.col("node") == F.col("a")).groupBy("seed", F.col("b").alias("node"))
        return nxt.agg(F.sum(F.col("n") * F.col("m")).alias("n"))

    one = written(on(seeds.select("seed", F.col("seed").alias("node"), F.lit(1).cast("long").alias("n")).distinct()), f"{folder}/1")
    out = one.withColumn("hops", F.lit(1))
    own = seeds.select("seed").distinct().join(degree.withColumnsRenamed({"node": "seed", "degree": "own"}), "seed")
    if hops > 1:
        two = written(on(one), f"{folder}/2")
        back = own.select("seed", F.col("seed").alias("node"), "own")
        less = F.col("n") - F.coalesce("own", F.lit(0))
        out = out.unionByName(two.join(back, ["seed", "node"], "left").select("seed", "node", less.alias("n"), F.lit(2).alias("hops")))
    if hops > 2:
        first = one.withColumnRenamed("n", "m").join(own, "seed").join(degree, "node")
        again = first.select("seed", "node", (F.col("m") * (F.col("own") + F.col("degree") + F.col("m") - 2)).alias("again"))
        less = F.col("n") - F.coalesce("again", F.lit(0))
        out = out.unionByName(on(two).join(again, ["seed", "node"], "left").select("seed", "node", less.alias("n"), F.lit(3).alias("hops")))
    return out.where("n > 0").withColumnRenamed("n", "n_trails")


def seed_terms(tokens: Column) -> Column:
    """Search terms of a question: words of three letters and more, with prefixes of five (long words) or three (four letters)."""
    long = F.filter(tokens, lambda t: F.length(t) >= 3)
    prefix = F.transform(
        long, lambda t: F.when(F.length(t) >= 6, F.array(t, F.substring(t, 1, 5))).when(F.length(t) == 4, F.array(t, F.substring(t, 1, 3))).otherwise(F.array(t))
    )
    return F.array_distinct(F.flatten(prefix))


def fuzzy_seeds(names: DataFrame, terms: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, name, score): the k best node names that contain terms (three letters and more), by the summed length of the terms.

    A term may stand anywhere in a name, also within a word or over a hyphen. Distinct names and distinct terms meet by equality in the term's first three letters before they are compared whole.
    """
    low = names.select("name").distinct().withColumn("low", F.lower("name")).where("length(low) >= 3")
    three = F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3)))
    asked = terms.where("length(term) >= 3").select("query_id", "term").distinct()
    start = asked.select("term", F.substring("term", 1, 3).alias("three")).distinct()
    found = low.select("name", "low", F.explode(F.array_distinct(three)).alias("three")).join(start, "three").where(F.contains("low", "term"))
    scored = found.select("name", "term").join(asked, "term").groupBy("query_id", "name").agg(F.sum(F.length("term")).cast("long").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def seeded(names: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(query_id, node, found_by): nodes whose name is a question's phrase; for questions without any, those found by terms."""
    hits = names.join(exact, F.lower("name") == F.col("exact")).select("query_id", "node", F.lit("exact").alias("found_by")).distinct()
    others = fuzzy.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(names, "name")
    return hits.unionByName(others.select("query_id", "node", F.lit("terms").alias("found_by")).distinct())


def by_names(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Nodes whose name is on a list, whatever the case."""
    return nodes.where(F.lower("name").isin([n.lower() for n in names]))


def numeric_filter(values: DataFrame, low: float | None = None, high: float | None = None, unit: str | None = None) -> DataFrame:
    """Values within optional bounds and of an optional unit; no condition keeps all."""
    out = values
    if low is not None:
        out = out.where(F.col("value") >= low)
    if high is not None:
        out = out.where(F.col("value") <= high)
    return out if unit is None else out.where(F.lower("unit") == unit.lower())


def interval_filter(values: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Ranges (low, high) that meet an interval; a missing end of a range is its other end."""
    out = values
    if low is not None:
        out = out.where(F.coalesce("high", "low") >= low)
    return out if high is None else out.where(F.coalesce("low", "high") <= high)


def year_filter(values: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Years within bounds; without any bound the result is empty."""
    if low is None and high is None:
        return values.limit(0)
    out = values if low is None else values.where(F.col("year") >= low)
    return out if high is None else out.where(F.col("year") <= high)
