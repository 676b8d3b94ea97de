"""Answers to questions from the graph, the documents or both: dispatch, context text, plug-in retrieval, bounded research.

All steps work on tables of questions; only the final texts, one for each question, are made on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.session import scratch_dir, written

#: Retrieval back ends: (documents, questions(query_id, question), k) -> (query_id, doc_id, score, rank).
Backend = Callable[[DataFrame, DataFrame, int], DataFrame]
_BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    """Add a retrieval back end under a name."""
    if not name.strip():
        raise ValueError("a back end needs a name")
    _BACKENDS[name.strip().lower()] = backend


def backends() -> list[str]:
    return sorted(_BACKENDS)


def backend(name: str) -> Backend:
    """The named back end; the empty one where the name isn't known."""
    return _BACKENDS.get(name.strip().lower(), _BACKENDS["none"])


def bm25_backend(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Lexical retrieval over (doc_id, text)."""
    terms = questions.select("query_id", F.explode(S.tokenize("question")).alias("term"))
    bag = written(S.bags(docs, "doc_id", S.tokenize("text")), scratch_dir(docs.sparkSession, "bags"))
    return S.bm25_top_k(terms, S.indexed(bag), k)


def no_backend(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    return questions.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)


register_backend("bm25", bm25_backend)
register_backend("none", no_backend)


def graph_facts(seeds: DataFrame, edges: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, line, rank): the most confident facts that touch a question's seed names (query_id, name).

    Facts are ranked for each name, and only the k best of a name meet the questions that ask for it.
    """
    s = seeds.select("query_id", F.lower("name").alias("n")).distinct()
    line = F.concat("s_name", F.lit(" --"), "predicate", F.lit("--> "), "t_name", F.lit(" ("), F.coalesce("source_document", F.lit("?")), F.lit(")"))
    e = edges.select("relation_row_id", line.alias("line"), F.coalesce("confidence", F.lit(0.0)).alias("score"), F.explode(F.array_distinct(F.array(F.lower("s_name"), F.lower("t_name")))).alias("n"))
    e = e.join(s.select("n").distinct(), "n", "left_semi").groupBy(F.col("n").alias("query_id"), F.col("relation_row_id").alias("doc_id")).agg(F.max("score").alias("score"), F.first("line").alias("line"))
    best = S.top_k(e, k).select(F.col("query_id").alias("n"), "doc_id", "score", "line")
    hits = s.join(best, "n").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.first("line").alias("line"))
    return S.top_k(hits, k).select("query_id", "line", "rank")


def dispatched(decisions: DataFrame, seeds: DataFrame, edges: DataFrame, docs: DataFrame, k: int = 8, retrieval: str = "bm25") -> DataFrame:
    """(query_id, route, facts, passages): what each question's route asks for.

    ``decisions`` is (query_id, question, route). Graph facts are looked up for graph_only and hybrid, passages for
    rag_only and hybrid; no_data gets neither.
    """
    wants_graph = decisions.where(F.col("route").isin("graph_only", "hybrid")).select("query_id")
    wants_text = decisions.where(F.col("route").isin("rag_only", "hybrid")).select("query_id", "question")
    facts = graph_facts(seeds.join(wants_graph, "query_id", "left_semi"), edges).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("facts")
    )
    hits = backend(retrieval)(docs, wants_text, k).join(docs.select("doc_id", S.snippet("text").alias("snippet")), "doc_id")
    passages = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]).alias("passages"))
    return decisions.select("query_id", "question", "route").join(facts, "query_id", "left").join(passages, "query_id", "left")


def rendered(answers: DataFrame, size: int = 12_000) -> DataFrame:
    """(query_id, answer): Markdown from the facts and passages alone, cut in the middle beyond ``size`` characters."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n- "), F.array_join(c, "\n- ")))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("question")), part("Facts", "facts"), part("Documents", "passages"))
    empty = F.when((F.coalesce(F.size("facts"), F.lit(0)) <= 0) & (F.coalesce(F.size("passages"), F.lit(0)) <= 0), F.lit("\n\nNo data."))
    return answers.select("query_id", S.truncate_middle(F.concat(body, F.coalesce(empty, F.lit(""))), size).alias("answer"))


@dataclass
class Research:
    """Bounded research on one question without a language model: graph first, then documents, then stop.

    ``search`` maps a tool name ('graph' or 'documents') and a query to the lines it finds. A query that was asked
    before and a spent budget end the work.
    """

    search: Callable[[str, str], list[str]]
    budget: int = 10
    steps: list[tuple[str, str, int]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def run(self, question: str, plan: list[tuple[str, str]] | None = None) -> list[str]:
        """All distinct lines in the order found; ``plan`` adds further (tool, query) calls."""
        found: dict[str, None] = {}
        asked: set[tuple[str, str]] = set()
        for tool, query in [("graph", question), ("documents", question), *(plan or [])]:
            key = (tool, " ".join(query.lower().split()))
            if len(self.steps) >= self.budget:
                self.notes.append("budget_exhausted")
                break
            if key in asked:
                self.notes.append("repeated_query")
                break
            asked.add(key)
            lines = self.search(tool, query)
            self.steps.append((tool, query, len(lines)))
            found.update(dict.fromkeys(lines))
        return list(found)
