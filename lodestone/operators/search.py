"""Lexical, dense and fused ranking for batches of questions.

Documents are bags of words or vectors, one row each; a batch of questions goes to the tasks that read them, and only the best
of each task are shuffled. Top-k uses a window for each query with the document id as the last tie-break.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import parallel, scratch_dir, written

#: Words of letters and digits, one inner hyphen or underscore allowed (fixed pattern).
WORD = r"[a-zA-Zа-яА-ЯёЁ0-9]+(?:[-_][a-zA-Zа-яА-ЯёЁ0-9]+)?"
#: Documents and words in a block of bags; terms and vector values of the queries that go to the tasks at once.
BLOCK, WORDS, TERMS, VALUES = 1 << 16, 1 << 21, 200_000, 1 << 21
#: More than rounding to four decimals, once or twice, can move a score.
SLACK = 2e-4


def tokenize(text: Column | str) -> Column:
    """Lower-case words in order, repetitions kept."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bags(docs: DataFrame, doc_id: str, tokens: Column, binary: bool = False, keep: str | None = None) -> DataFrame:
    """(doc_id, terms, tfs, dl): the distinct words of each document with their counts in one row, made without a shuffle.

    Rows that share an id become one document; those without words are left out. ``binary`` counts each word of a text once.
    ``keep`` names an array that stays beside them (chained where rows share an id).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"), *([keep] if keep else []))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"doc_id {kind['doc_id']}, terms array<string>, tfs array<int>, dl bigint" + (f", {keep} {kind[keep]}" if keep else "")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, n = batch.column("tokens"), batch.num_rows
            words = listed.flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            found, times = np.unique(np.repeat(np.arange(n), _lengths(listed)) * size + words.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(found, np.arange(n + 1) * size)
            tf = np.ones_like(times) if binary else times
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (words.dictionary.take(pa.array(found % size)), pa.array(tf, pa.int32()))]
            sums = np.concatenate([[0], np.cumsum(tf)]).astype("int64")
            out = [batch.column("doc_id"), *lists, pa.array(sums[ends[1:]] - sums[ends[:-1]])]
            names = ["doc_id", "terms", "tfs", "dl"]
            yield pa.RecordBatch.from_arrays([*out, batch.column(keep)] if keep else out, [*names, keep] if keep else names)

    bag = rows.mapInArrow(counted, shape)
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    if not again.isEmpty():
        shared = F.col("doc_id").eqNullSafe(F.col("again"))
        several = bag.join(again, shared, "left_semi")
        words = several.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("doc_id", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("tf"))
        one = words.groupBy("doc_id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("x"), F.sum("tf").alias("dl"))
        one = one.select("doc_id", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"), "dl")
        if keep:
            kept = several.groupBy(F.col("doc_id").alias("again")).agg(F.flatten(F.collect_list(keep)).alias(keep))
            one = one.join(kept, shared).drop("again")
        bag = bag.join(again, shared, "left_anti").unionByName(one)
    return bag.where("dl > 0")


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Index:
    """What lexical ranking reads: the bags of words of the documents, document frequencies, and totals (one row)."""

    bags: DataFrame
    terms: DataFrame
    totals: DataFrame


def indexed(bag: DataFrame) -> Index:
    """The index of a table of bags."""
    terms = bag.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Index(bag, terms, bag.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))


class _Best:
    """The k best documents of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids, self.least = k, [np.empty(0)] * n, [np.empty(0, "int64")] * n, np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > self.k:
            chosen = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids = scores[chosen], ids[chosen]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = self.scores[q][-1]

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        found = np.repeat(queries, [len(x) for x in self.ids])
        columns = [found, np.concatenate([np.empty(0, "int64"), *self.ids]), np.concatenate([np.empty(0), *self.scores])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "doc_id", "score"])


def _rounded(x: np.ndarray) -> np.ndarray:
    """Four decimals, halves away from 0."""
    return np.copysign(np.floor(np.abs(x) * 1e4 + 0.5) / 1e4, x) + 0.0


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Bags in blocks that are worth a pass over all queries: ``BLOCK`` documents or ``WORDS`` words."""
    held, docs, words = [], 0, 0
    for batch in batches:
        held, docs, words = [*held, batch], docs + batch.num_rows, words + len(batch.column("terms").flatten())
        if docs >= BLOCK or words >= WORDS:
            yield pa.Table.from_batches(held)
            held, docs, words = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _part(df: DataFrame, i: int, n: int) -> pa.Table:
    """The i-th of n parts of a table of queries."""
    return (df.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else df).toArrow()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _whole(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def bm25_top_k(
    queries: DataFrame, index: Index, k: int, idf: str = "plus", k1: float = 1.5, b: float = 0.75, floor: float = 0.25,
    seeds: DataFrame | None = None, boost: float = 0.2,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query. ``queries`` is (query_id, term), repeated terms count again.

    idf 'plus' is ln(1 + (N - df + .5) / (df + .5)); 'okapi' is without the 1 +, negative values replaced by ``floor``
    times the mean idf of all terms. Every task ranks its documents for all queries, and only the k best of each query leave it: the
    pairs of queries and documents are never rows. Queries go to the tasks ``TERMS`` terms at a time.

    With ``seeds`` (query_id, seed) documents whose ``ends`` (array of structs of two names) hold the seed get ``boost`` more.
    """
    spark = index.bags.sparkSession
    df = index.terms.crossJoin(F.broadcast(index.totals.select("n_docs")))
    ratio = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if idf == "plus":
        terms = df.select("term", F.log1p(ratio).alias("idf"))
    else:
        raw = df.select("term", F.log(ratio).alias("idf"))
        mean = raw.agg((floor * F.avg("idf")).alias("least"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("least")).otherwise(F.col("idf")).alias("idf"))
    wanted = queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(terms, "term")
    wanted = written(wanted.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), scratch_dir(spark, "wanted"))
    mean_length = index.totals.first()["avgdl"]
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.bags.schema]}
    docs = parallel(index.bags.where("doc_id is not null"))
    n = max(1, -(-wanted.count() // TERMS))
    parts = []
    for i in range(n):
        rank = _ranking(_part(wanted, i, n), _part(seeds, i, n) if seeds is not None else None, k, k1, b, mean_length, boost)
        parts.append(docs.mapInArrow(rank, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double"))
    return top_k(reduce(DataFrame.unionByName, parts), k)


def _ranking(wanted: pa.Table, seeds: pa.Table | None, k: int, k1: float, b: float, mean_length: float | None, boost: float):
    """The step over batches of bags that ranks them for some queries."""
    term = _whole(wanted, "term").dictionary_encode()
    vocabulary, order = term.dictionary, np.argsort(_numbers(wanted, "query_id"), kind="stable")
    query, first = np.unique(_numbers(wanted, "query_id")[order], return_index=True)
    term, weight = term.indices.to_numpy()[order].tolist(), _numbers(wanted, "weight")[order].tolist()
    first, positive = [*first.tolist(), len(term)], min(weight, default=1) > 0
    own: list[list[int]] = [[-1]] * len(query)
    names = None
    if seeds is not None:
        seed = _whole(seeds, "seed").dictionary_encode()
        names, own = seed.dictionary, [[] for _ in query]
        place = {q: i for i, q in enumerate(query.tolist())}
        for q, s in zip(_numbers(seeds, "query_id").tolist(), seed.indices.to_pylist(), strict=True):
            if q in place:
                own[place[q]].append(-1 if s is None else s)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(query), k)
        for block in _joined(batches):
            listed, n = _whole(block, "terms"), block.num_rows
            code = pc.index_in(listed.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
            hit = np.flatnonzero(code >= 0)
            hit = hit[np.argsort(code[hit], kind="stable")]
            doc, tf = np.repeat(np.arange(n), _lengths(listed))[hit], _whole(block, "tfs").flatten().to_numpy()[hit]
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * _numbers(block, "dl")[doc] / mean_length))
            start = np.searchsorted(code[hit], np.arange(len(vocabulary) + 1)).tolist()
            ids, entry = _numbers(block, "doc_id"), None
            if names is not None:
                entry, ends = np.repeat(np.arange(n), _lengths(_whole(block, "ends"))), _whole(block, "ends").flatten()
                ids, side = ids[entry], [pc.index_in(x, value_set=names, skip_nulls=True).fill_null(-1).to_numpy().astype("int64") for x in ends.flatten()]
                pair = np.unique(np.concatenate([x * len(entry) + np.arange(len(entry)) for x in side]))
                pair = pair[pair >= 0]
                touched = (pair % max(1, len(entry)))
                touch = np.searchsorted(pair, np.arange(len(names) + 1) * len(entry)).tolist()
                bonus = np.zeros(len(entry))
            total, seen = np.zeros(n), np.zeros(n, bool)
            for q in range(len(query)):
                some = False
                for j in range(first[q], first[q + 1]):
                    x, y = start[term[j]], start[term[j] + 1]
                    if x < y:
                        some = True
                        total[doc[x:y]] += weight[j] * gain[x:y]
                        if not positive:
                            seen[doc[x:y]] = True
                if not some:
                    continue
                for s in own[q]:
                    score, found = total, None if positive else seen
                    if entry is not None:
                        score, found = total[entry], None if positive else seen[entry]
                        raised = touched[touch[s] : touch[s + 1]] if s >= 0 else touched[:0]
                        raised = raised[score[raised] > 0 if positive else found[raised]]
                        bonus[raised] = boost
                        score[raised] += boost
                    least = best.least[q] - SLACK
                    at = np.flatnonzero(score > max(least, 0.0)) if positive else np.flatnonzero(found & (score > least))
                    if entry is not None:
                        final = _rounded(_rounded(total[entry[at]]) + bonus[at])
                        bonus[raised] = 0.0
                    else:
                        final = _rounded(score[at])
                    if len(at):
                        best.add(q, final, ids[at])
                total.fill(0.0)
                if not positive:
                    seen.fill(False)
        yield best.rows(query)

    return rank


def hashed_vectors(bag: DataFrame, size: int = 64) -> DataFrame:
    """(doc_id, v): documents as vectors of ``size`` hashed term counts, made from their bags: the dense leg's encoder."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, n = batch.column("terms"), batch.num_rows
            words = listed.flatten().dictionary_encode()
            place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size for w in words.dictionary.to_pylist()], "int64")
            at = np.repeat(np.arange(n), _lengths(listed)) * size + place[words.indices.to_numpy()]
            v = np.bincount(at, weights=batch.column("tfs").flatten().to_numpy(), minlength=n * size).astype("float64")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(v))], ["doc_id", "v"])

    full = bag.where("doc_id is not null").select("doc_id", "terms", "tfs")
    return full.mapInArrow(summed, f"doc_id {full.schema['doc_id'].dataType.simpleString()}, v array<double>")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query, ranked from 1; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def padded_top_k(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query; where fewer have a score, the first others by id follow with 0.

    A query with fewer than k hits needs at most the 2k smallest ids to fill up, so no query meets all documents.
    """
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    filler = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    best = top_k(scores, k).select("query_id", "doc_id", "score").unionByName(filler.select("query_id", "doc_id", "score"))
    return top_k(best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def dense_top_k(vectors: DataFrame, vec_id: str, embedding: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine, exact: blocks of queries against the vectors where they lie.

    Every task multiplies its vectors with all queries, and only its k best per query leave it; no vector is copied for the queries.
    Queries go to the tasks ``VALUES`` numbers at a time.
    """
    row = lambda df, name: df.select(F.col(vec_id).alias(name), F.col(embedding).cast("array<double>").alias("v"))
    wanted, rows = row(queries, "query_id"), parallel(row(vectors, "id"))
    kind = wanted.schema["query_id"].dataType.simpleString()
    size = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n = max(1, -(-size["n"] * (size["width"] or 0) // VALUES))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def against(part: pa.Table):
        query = _numbers(part, "query_id")
        matrix = lambda v, n: v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        q = unit(matrix(_whole(part, "v"), len(query))) if len(query) else None

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(query), k)
            for batch in batches:
                if not batch.num_rows or q is None:
                    continue
                d, ids = unit(matrix(batch.column("v"), batch.num_rows)).T, batch.column("id").to_numpy()
                for low in range(0, len(query), 256):
                    for i, s in enumerate(q[low : low + 256] @ d, low):
                        at = np.flatnonzero(s > best.least[i] - SLACK)
                        if len(at):
                            best.add(i, np.round(s[at], 4), ids[at])
            yield best.rows(query)

        return score

    parts = [rows.mapInArrow(against(_part(wanted, i, n)), f"query_id {kind}, doc_id {kind}, score double") for i in range(n)]
    return top_k(reduce(DataFrame.unionByName, parts), k)


def rrf(legs: list[DataFrame], constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score): reciprocal ranks of several ranked legs summed."""
    rows = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))


def edge_documents(edges: DataFrame) -> DataFrame:
    """Edges as short texts that can be searched like documents."""
    end = lambda t, n: F.concat(F.lit("["), t, F.lit("] "), n)
    text = F.concat_ws(
        " ", end("s_type", "s_name"), F.concat(F.lit("--"), F.col("predicate"), F.lit("-->")), end("t_type", "t_name"), F.lit("."),
        F.nullif(F.trim("quote"), F.lit("")), F.nullif(F.trim("source_document"), F.lit("")),
    )
    return edges.select(F.col("relation_row_id").alias("doc_id"), text.alias("text"), "s_name", "t_name")


def snippet(text: Column | str, size: int = 700) -> Column:
    """Blanks collapsed, cut at ``size`` characters with dots."""
    c = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    return F.when(F.length(c) > size, F.concat(F.rtrim(F.substring(c, 1, size)), F.lit("..."))).otherwise(c)


def title(source: Column | str, headings: Column | str) -> Column:
    """Source, and the heading path where there is one."""
    own = F.col(source) if isinstance(source, str) else source
    path = F.array_join(headings, " > ")
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat_ws(" | ", own, path)).otherwise(own)


def truncate_middle(text: Column, size: int) -> Column:
    """Head and tail of a long text around a note on what was left out."""
    half = size // 2
    note = F.concat(F.lit("\n[... "), (F.length(text) - size).cast("string"), F.lit(" chars truncated ...]\n"))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half))))
