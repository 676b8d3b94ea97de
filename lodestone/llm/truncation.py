"""Texts that lost their end by a field limit or a broken transfer.

Method: a structural completeness check. A stack automaton runs over the whole text: brackets, guillemets, curly and
straight quotes, markup tags; escaped characters are passed over. A closer closes everything above its opener; a closer
without its opener is ignored. What is left on the stack, marks of a cut, broken multibyte sequences and dangling escapes or
markup are proof of a cut; in a text whose last line is terminated an opener left open is proof only where the source
closes its openers (at most ``OPEN_SHARE`` of its terminated texts leave one).

A last line without a terminator is only suspicious, because headings, captions, lists, table lines, signatures and formulas
have none either. Each source has a baseline: the share of its long and of its short lines inside texts, which no cut has
touched, that end with a terminator. The ending is then judged by how its last two words (the last one taken as a possible
fragment) go on elsewhere: continuations against ends of lines, with the source's baseline as ``PRIOR`` votes. Without any
occurrence of the two words the last word alone decides, and without that the baseline alone.

Every distinct text counts once, however often it was loaded, and a text is no witness of its own ending. All statistics count
all texts; texts are never truncated or sampled, and counts are combined before the shuffle. Only pairs that begin with
a word of a suspicious ending are taken apart into prefixes, and only into the lengths asked for.

Defined results: null and blank texts are not truncated; a null source is a source of its own; repeated texts are judged each
on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import parallel, scratch_dir, written

# Closers with their openers, marks left by a cut, abbreviations that never end a text.
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
MARKS = r"(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\ufffd|>>)\s*$"
ABBREVIATIONS = r"(?iu)(?:^|[\s(])(?:см|тыс|рис|табл|стр|мас|fig|no|vol|see)\.\s*$"
BROKEN_ESCAPE = r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?[0-9a-zA-Z]{0,8}))$"
OPEN_TAG = r"^[/a-zA-Z][^>]*$"  # what stands behind the last '<'
TERMINATORS = ".!?"
CAPTION = r"(?iu)(?:^|[.!?\])»]\s+)(?:рис|рисунок|табл|таблица|схема|fig|figure|table|scheme)\.?\s*\d+[^!?]*$"
LABEL = r"(?u)^(?:\p{L}+[ -]){0,2}\p{L}+:\s*\S"
LIST_ITEM = r"(?u)^(?:[-*•–—]|\d{1,3}[.)])\s+\S"
# Markup elements that have no end tag or may go without one.
WITHOUT_END = ("area", "base", "br", "col", "dd", "dt", "embed", "hr", "img", "input", "li", "link", "meta", "option", "p", "source", "tbody", "td", "th", "thead", "tr", "track", "wbr")
OPEN_SHARE, PRIOR, LONG_LINE = 0.05, 1.0, 80

_ATTRIBUTE = r"""\s+[A-Za-z:-]+=(?:"[^"]*"|'[^']*'|[^\s"'<>]+)"""
_TOKEN = rf"""\\.|[0-9]?"|[()\[\]{{}}«»“”]|(?<![\p{{L}}\p{{N}}])<[A-Za-z][A-Za-z0-9]*(?:{_ATTRIBUTE})*\s*>|</[A-Za-z][A-Za-z0-9]*\s*>"""
_END = "\x01"  # stands after each element of the stack
_STOP = "\x03"  # stands after a text
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f")


def open_brackets(text: Column) -> Column:
    """What is left on the stack after the brackets, quotes and tags of a text."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z0-9]+)", 1))
    opener_of = F.create_map(*[F.lit(x) for p in PAIRS.items() for x in p])

    def step(stack: Column, token: Column) -> Column:
        quote, tag = token.endswith('"'), token.startswith("<")
        own = F.when(tag, F.concat(F.lit("<"), name(token))).when(quote, F.lit('"')).otherwise(F.coalesce(opener_of[token], token))
        element = F.concat(own, F.lit(_END))
        back = F.instr(F.reverse(stack), F.reverse(element))  # the last one of its kind on the stack
        closes = token.isin(*PAIRS) | token.startswith("</") | (quote & ((back > 0) | (token != '"')))
        closed = F.when(back > 0, F.left(stack, F.length(stack) - back - F.length(element) + 1)).otherwise(stack)
        passed = token.startswith("\\") | (tag & name(token).isin(*WITHOUT_END))
        return F.when(passed, stack).when(closes, closed).otherwise(F.concat(stack, element))

    every, plain = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (_TOKEN, r"[()\[\]{}«»“”]"))
    holds = lambda chars: functools.reduce(lambda a, b: a | b, [text.contains(c) for c in chars])
    tokens = F.when(holds('"<\\'), every).otherwise(plain)  # most texts hold brackets only
    return F.when(holds('([{«“"<'), F.replace(F.aggregate(tokens, F.lit(""), step), F.lit(_END), F.lit(""))).otherwise("")


def _words(text: Column) -> Column:
    """Words with digits as 9, and marks behind them: what ends with a line feed ends a line, with ``_STOP`` the text."""
    flat = F.regexp_replace(F.lower(text), r"[0-9]+(?:[.,][0-9]+)?", "9")
    return F.regexp_extract_all(F.concat(flat, F.lit(_STOP)), F.lit(rf"[\p{{L}}\p{{N}}]+|[.!?]*\s*[\n{_STOP}]"), F.lit(0))


def _is_end(token: Column) -> Column:
    return token.endswith("\n") | token.endswith(_STOP)


def endings(docs: DataFrame, doc_id: str, text: str, source: str | None = None) -> DataFrame:
    """Each text's structural verdict, its last two words and its lines.

    kind is 'cut', 'complete', 'open' (terminated, but something is left open), 'listlike' or 'unknown'; n_long, n_short and
    their terminated ones count the lines inside the text.
    """
    t = F.rtrim(text, F.lit(_BLANKS))
    own = F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.where(F.col(text).rlike(r"(?U)\S")).select(F.col(doc_id).alias("doc_id"), own.alias("source"), t.alias("t"))
    base = rows.select(
        "doc_id", "source", F.xxhash64("t").alias("digest"), F.trim(F.substring_index("t", "\n", -1)).alias("line"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "").alias("lines"), open_brackets(F.col("t")).alias("left_open"),
    ).withColumn("lines", F.slice("lines", 1, F.size("lines") - 1))
    line = F.col("line")  # the other proofs lie at the end of the last line
    last_sign = F.right(F.rtrim(line, F.lit("\"'»”)]")), F.lit(1))
    segment = F.regexp_replace(line, r"^.*[.!?][\"»”)\]]*(?:\s*\[\d+\])?\s+(?=\S)", "")
    proof = (
        F.right(line, F.lit(8)).rlike(MARKS) | F.right(line, F.lit(16)).rlike(ABBREVIATIONS) | F.right(line, F.lit(16)).rlike(BROKEN_ESCAPE)
        | (line.contains("<") & F.substring_index(line, "<", -1).rlike(OPEN_TAG)) | F.right(line, F.lit(1)).isin(*",;:(«[{–—-") | ((F.left(segment, F.lit(1)) == "|") & (F.right(segment, F.lit(1)) != "|"))
    )
    kind = (
        F.when(proof, "cut")
        .when(last_sign.isin(*TERMINATORS), F.when(F.col("left_open") != "", "open").otherwise("complete"))
        .when(F.col("left_open") != "", "cut")
        .when(segment.rlike(r"^\|.*\|$") | segment.rlike(r"^\(.*\)$"), "complete")
        .when(segment.rlike(r"^#+\s") | line.rlike(CAPTION) | segment.rlike(LABEL) | segment.rlike(LIST_ITEM), "listlike")
        .otherwise("unknown")
    )
    words = F.when(kind.isin("listlike", "unknown"), F.filter(_words(line), lambda w: ~_is_end(w)))
    long = lambda x: F.length(x) > LONG_LINE
    ended = lambda x: F.right(F.rtrim(x, F.lit(" \t\r\"'»”)]")), F.lit(1)).isin(*TERMINATORS)
    count = lambda test: F.size(F.filter("lines", test))
    return base.select(
        "doc_id", "source", "digest", kind.alias("kind"), long(line).alias("long"),
        count(long).alias("n_long"), count(lambda x: long(x) & ended(x)).alias("n_long_ended"),
        count(lambda x: ~long(x)).alias("n_short"), count(lambda x: ~long(x) & ended(x)).alias("n_short_ended"),
        F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")).alias("w1"),
        F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("w2"),
    )


def baselines(ends: DataFrame) -> DataFrame:
    """(source, long_ended, short_ended, closes): shares of lines inside texts that are terminated; whether openers get closed."""
    share = lambda n, of: F.coalesce((F.sum(n) + 1) / (F.sum(of) + 2), F.lit(0.5))
    n_open, n_ended = F.count_if(F.col("kind") == "open"), F.count_if(F.col("kind").isin("open", "complete"))
    return ends.groupBy("source").agg(
        share("n_long_ended", "n_long").alias("long_ended"), share("n_short_ended", "n_short").alias("short_ended"),
        (n_open <= F.greatest(F.lit(1), F.lit(OPEN_SHARE) * n_ended)).alias("closes"),
    )


def continuations(docs: DataFrame, text: str) -> DataFrame:
    """For each pair of neighbouring words of a line: how often it goes on, ends a line within the text, ends the text."""
    w = _words(F.rtrim(text, F.lit(_BLANKS)))
    n = F.size("w")
    before, own, after = F.concat(F.array(F.lit("")), F.slice("w", 1, n - 2)), F.slice("w", 1, n - 1), F.slice("w", 2, n - 1)
    rows = docs.where(F.col(text).isNotNull()).select(w.alias("w")).where("size(w) > 1")
    rows = rows.select(F.inline(F.arrays_zip(before.alias("w1"), own.alias("w2"), after.alias("next")))).where(~_is_end(F.col("w2")))
    w1, last = F.when(_is_end(F.col("w1")), "").otherwise(F.col("w1")), F.col("next").endswith(_STOP)
    return rows.groupBy(w1.alias("w1"), "w2").agg(
        F.count_if(~_is_end(F.col("next"))).alias("n_on"), F.count_if(F.col("next").endswith("\n")).alias("n_line"), F.count_if(last).alias("n_text")
    )


def begun(counts: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """How the asked words (w2, within ``key``) and the words they begin go on: n_on, n_end, n_longer."""
    lengths = asked.groupBy(*key).agg(F.collect_set(F.length("w2")).alias("lengths"))
    wanted = counts.withColumnRenamed("w2", "x").join(lengths, key) if key else counts.withColumnRenamed("w2", "x").crossJoin(F.broadcast(lengths))
    n = F.explode(F.expr("filter(lengths, n -> n <= length(x))")).alias("n")
    parts = wanted.select(*key, "x", "n_on", "n_line", "n_text", n).withColumn("w2", F.expr("left(x, n)"))
    exact, stops = F.col("x") == F.col("w2"), F.col("n_line") + F.col("n_text")
    return parts.join(asked.select(*key, "w2").distinct(), [*key, "w2"], "left_semi").groupBy(*key, "w2").agg(
        F.sum(F.when(exact, F.col("n_on")).otherwise(0)).alias("n_on"), F.sum(F.when(exact, stops).otherwise(0)).alias("n_end"),
        F.sum(F.when(~exact, F.col("n_on") + stops).otherwise(0)).alias("n_longer"),
        F.sum(F.when(exact, F.col("n_on") + F.col("n_line")).otherwise(0)).alias("n_inside"),
    )


def verdicts(docs: DataFrame, doc_id: str, text: str, source: str | None = None) -> DataFrame:
    """(doc_id, truncated) for each text."""
    docs = parallel(docs)
    folder = scratch_dir(docs.sparkSession, "truncation")
    ends = written(endings(docs, doc_id, text, source), f"{folder}/endings")
    first = ends.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = ends.join(first, "digest").where("doc_id <> first").select(F.col("doc_id").alias(doc_id)).distinct()
    copies = written(copies, f"{folder}/copies")  # of known size: few copies don't move the texts
    once = ends.groupBy("digest", "source").agg(*[F.first(c).alias(c) for c in ("kind", "n_long", "n_long_ended", "n_short", "n_short_ended")])
    base = baselines(once)
    open_ends = ends.where(F.col("kind").isin("listlike", "unknown"))
    others = docs.join(copies, doc_id, "left_anti")
    asked = open_ends.select("w1", "w2").distinct()
    pairs = written(continuations(others, text), f"{folder}/pairs")
    seen = begun(pairs, asked, ["w1"]).drop("n_inside")
    words = pairs.groupBy("w2").agg(*[F.sum(c).alias(c) for c in ("n_on", "n_line", "n_text")])
    alone = begun(words, asked.select("w2").distinct(), []).select("w2", *[F.col(c).alias(f"{c}_1") for c in ("n_on", "n_end", "n_longer")], "n_inside")
    judged = open_ends.join(seen, ["w1", "w2"], "left").join(alone, "w2", "left").na.fill(0).join(base, "source")
    baseline = F.when(F.col("long"), F.col("long_ended")).otherwise(F.col("short_ended"))

    def vote(on: Column, end: Column) -> Column:
        return on + PRIOR * baseline > end + PRIOR * (1 - baseline)

    on, end = F.col("n_on") + F.col("n_longer"), F.greatest(F.col("n_end") - 1, F.lit(0))  # without its own end
    by_word = vote(F.col("n_on_1") + F.col("n_longer_1"), F.greatest(F.col("n_end_1") - 1, F.lit(0)))
    broken_word = (F.col("n_inside") == 0) & (on > 0)
    truncated = F.when(F.col("kind") == "listlike", broken_word).when(on + end > 0, vote(on, end)).otherwise(by_word)
    sure = ends.where(F.col("kind").isin("cut", "complete", "open")).join(base.select("source", "closes"), "source")
    sure = sure.select("doc_id", ((F.col("kind") == "cut") | ((F.col("kind") == "open") & F.col("closes"))).alias("truncated"))
    return sure.unionByName(judged.select("doc_id", truncated.alias("truncated")))


def truncation_rates(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Per source: texts, truncated texts, their rate, and the length at which most of the truncated ones end (null without any)."""
    v = verdicts(docs, doc_id, text, source).groupBy("doc_id").agg(F.max("truncated").alias("truncated"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.length(text).alias("n_chars"))
    rows = rows.join(v, "doc_id", "left").na.fill(False, ["truncated"])
    sizes = rows.groupBy("source", "n_chars").agg(F.count("*").alias("n"), F.count_if("truncated").alias("cut"))
    return sizes.groupBy("source").agg(
        F.sum("n").alias("n_texts"), F.sum("cut").alias("n_truncated"), F.round(F.sum("cut") / F.sum("n"), 4).alias("rate"),
        F.max_by(F.when(F.col("cut") > 0, F.col("n_chars")), F.struct("cut", "n_chars")).alias("usual_cut_length"), F.max("cut").alias("n_at_that_length"),
    )
