"""Noise in text from scanned pages: found row by row, and repaired into continuous paragraphs.

Words: one pass counts every word of the corpus and the contexts around it; Spark sums them, and skip-gram vectors follow from
the sums, for rare words too. A rare word is linked to more frequent words that differ by plausible glyph edits: words that
any edits could make equal share a key, the pairs of a key are joined and the edits verified. Every link is ranked by
frequency and by the likeness of the contexts; a frequent pair without common contexts is no link. Where several links are
left, each occurrence is corrected to the one whose vector suits the words around it.

Furniture: the first and last lines of blocks are folded to a skeleton in which confusable glyphs are equal. A line
whose skeleton comes back on many pages of its file is a running title; a number that follows the page count of its
file in the same style is a page number. What is learned for a file from its blocks also holds for its chunks.

Divided words: a hyphen at the end of a line or row, unless the part before it is one that hangs before a blank elsewhere
('тепло- и массообмен') and the joined word stands nowhere undivided. The repaired text joins words over empty lines and
over rows too: the row with the first half gets the whole word and what is written on to it, the next row of running text
of the file begins after it. Where chunks overlap the later chunk holds the whole word anyway and keeps it. Which row comes
next is found within ranges of RANGE places, so that a large file is no single task. A word over three rows is joined once.

The vocabulary and its vectors never pass through the driver. The list of misread words is broadcast only up to ``BROADCAST`` entries;
beyond that the distinct words of each row are joined with it.

Defined results: null and blank texts have no noise; rows of formats that aren't scanned are left out; repeated rows give
one result; an unknown page gives no page number and doesn't count for running titles; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import parallel, scratch_dir, spread, written

# Glyphs as printed and as misread.
GLYPHS = (
    ("о", "0"), ("т", "г"), ("н", "п"), ("в", "8"), ("e", "c"), ("ы", "ьi"), ("з", "3"), ("ч", "4"), ("t", "f"), ("б", "6"), ("ж", ">к"), ("i", "l"), ("i", "|"),
    ("o", "0"), ("п", "л"), ("s", "5"), ("l", "1"), ("ц", "и"), ("d", "cl"), ("ю", "10"), ("ш", "щ"), ("m", "rn"), ("h", "b"), ("g", "9"), ("z", "2"), ("l", "|"),
    ("i", "1"), ("э", "3"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("vv", "w"),
)
SCANNED = ("pdf", "tif", "tiff", "djvu", "jpg", "jpeg", "png")
RATIO, LEAST, BROADCAST, PAGE_SHARE, RANGE = 8, 3, 300_000, 0.15, 1000
BUCKETS, WINDOW, HELD, UNLIKE = 256, 2, 100_000, 0.02
_TOKEN = re.compile(r"[\w>|]+")
JAVA_TOKEN = r"[\p{L}\p{N}_>|]+"
_HYPHENS = "-\u00ad\u00ac\u2010\u2011"
_BREAK = re.compile(rf"([{_HYPHENS}])[ \t]*(?:\r?\n\s*|$)([^\W\d_]*)")
_JOIN = re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_INLINE = re.compile(r"-(?= )")
_LAST = re.compile(r"[^\W\d_]+$")
_HEAD = re.compile(rf"([\w>|]*[^\W\d_])([{_HYPHENS}])$")
_TAIL = re.compile(r"([^\W\d_][\w>|]*)(\S*)")
_WITH_PAGE = re.compile(r"^(?:(\d{1,4})\s*\|\s*(\S.*)|(\S.*?)\s{2,}(\d{1,4}))$")
STYLES = {
    "plain": re.compile(r"(\d{1,4})"), "brackets": re.compile(r"\[(\d{1,4})\]"), "parens": re.compile(r"\((\d{1,4})\)"),
    "dashes": re.compile(r"[-–—]\s*(\d{1,4})\s*[-–—]"), "slash": re.compile(r"(\d{1,4})\s*/\s*\d{1,4}"),
    "of": re.compile(r"[^\W\d_]+\.?\s+(\d{1,4})\s+[^\W\d_]{2}\s+\d{1,4}"), "word": re.compile(r"(?:стр\.|страница|page|p\.|с\.|лист)\s*(\d{1,4})", re.I),
    "roman": re.compile(r"([ivxlc]{1,8})"),
}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _folds() -> dict[int, str]:
    """Letters to what they share with all they are confused with: glyphs read as two stand for the two."""
    cls: dict[str, str] = {}

    def top(c: str) -> str:
        while cls.get(c, c) != c:
            c = cls[c]
        return c

    for true, read in GLYPHS:
        if len(true) == len(read) == 1:
            a, b = sorted((top(true), top(read)))
            cls[b] = a
            cls.setdefault(a, a)
    out = {ord(c): top(c) for c in cls}
    two = {one: pair for x in GLYPHS for one, pair in (x, x[::-1]) if len(one) < len(pair)}
    return out | {ord(one): "".join(top(c) for c in pair) for one, pair in two.items()}


_FOLD = _folds()


def skeleton(line: str) -> str:
    """A line in which confusable glyphs are equal; blanks and punctuation don't count."""
    return re.sub(r"[^\w|]", "", line.lower().translate(_FOLD))


def shape_key(word: Column) -> Column:
    """Equal for words that differ by any number of misread glyphs."""
    t = word
    for c, to in _FOLD.items():
        if len(to) > 1:
            t = F.replace(t, F.lit(chr(c)), F.lit(to))
    single = {chr(c): to for c, to in _FOLD.items() if len(to) == 1}
    return F.translate(t, "".join(single), "".join(single.values()))


def misread_glyphs(word: str, near: str) -> int | None:
    """The least number of misread glyphs that make ``word`` of ``near``; None if none do."""
    costs = {(0, 0): 0}
    for i in range(len(near) + 1):
        for j in range(len(word) + 1):
            here = costs.get((i, j))
            if here is None or (i, j) == (len(near), len(word)):
                continue
            steps = [(1, 1, 0)] if near[i : i + 1] == word[j : j + 1] != "" else []
            steps += [(len(t), len(r), 1) for t, r in GLYPHS if near.startswith(t, i) and word.startswith(r, j)]
            for x, y, c in steps:
                to = (i + x, j + y)
                costs[to] = min(costs.get(to, here + c), here + c)
    return costs.get((len(near), len(word)))


def roman_value(text: str) -> int:
    v = [_ROMAN[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


@lru_cache(65536)
def page_style(line: str) -> tuple[str, int] | None:
    """Style and number of a line that may be a page number."""
    if len(line.split(None, 4)) > 4:  # no style has more parts
        return None
    for style, pattern in STYLES.items():
        m = pattern.fullmatch(line)
        if m:
            return style, roman_value(m[1]) if style == "roman" else int(m[1])
    return None


def titled(line: str) -> tuple[str, int | None]:
    """A line without the page number at its side, and that number."""
    m = _WITH_PAGE.match(line)
    return (m[2] or m[3], int(m[1] or m[4])) if m else (line, None)


def title_like(line: str) -> bool:
    """Whether a line may be a running title: begins like a title, ends without punctuation. Repetition over pages decides."""
    return len(line) >= 5 and not line[0].islower() and line[0] not in "#|[(-–—«" and line[-1] not in ".,;:!?-¬­‐"


def edge_lines(text: str, every: bool, strict: bool = False) -> list[str]:
    """First and last line of a text; with ``every``, of each of its paragraphs. ``strict``: none that runs on below."""
    out: dict[str, None] = {}
    for p in re.split(r"\n\s*\n", text) if every else [text]:
        lines = [x.strip() for x in p.strip().splitlines()]
        if lines:
            runs_on = strict and len(lines) > 1 and lines[1][:1].islower()
            for line in [*([] if runs_on else lines[:1]), lines[-1]]:
                out[line] = None
    return list(out)


def before(text: str, end: int) -> str:
    """The letters right before a place in a text."""
    size = 60
    while (m := _LAST.search(text[max(0, end - size) : end])) and len(m[0]) == size:
        size *= 2
    return m[0] if m else ""


def breaks(text: str) -> list[tuple[str, str, str]]:
    """(letters before, hyphen, letters after) of the hyphens at line ends and at the end."""
    found = [(before(text, m.start()), m[1], m[2]) for m in _BREAK.finditer(text)]
    return [x for x in found if x[0]]


def joined(text: str) -> str:
    return _JOIN.sub("", text)


def tokens(text: str) -> list[str]:
    """Lower-case words of a text whose divided words are joined."""
    return _TOKEN.findall(joined(text).lower())


@lru_cache(262144)
def bucket(word: str) -> int:
    """The context bucket of a word; all numbers share one."""
    return crc32(b"9" if word.isdigit() else word.encode("utf-8", "surrogatepass")) % BUCKETS


class Contexts:
    """Counts of words and of the context buckets within ``WINDOW`` words around them, held for up to ``HELD`` words."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.buckets: list[int] = []
        self.held: list[np.ndarray] = []

    def add(self, texts: list[list[str]]) -> None:
        flat: list[int] = []
        for words in texts:
            for w in words:
                k = self.ids.get(w)
                if k is None:
                    k = self.ids[w] = len(self.buckets)
                    self.buckets.append(bucket(w))
                flat.append(k)
            flat += [-1] * WINDOW
        at = np.array(flat, dtype=np.int64)
        of = np.array([*self.buckets, 0], dtype=np.int64)  # the last for no word
        keys = [at[at >= 0] * (BUCKETS + 1) + BUCKETS]
        for k in range(1, WINDOW + 1):
            a, b = at[:-k], at[k:]
            both = (a >= 0) & (b >= 0)
            keys += [(a * (BUCKETS + 1) + of[b])[both], (b * (BUCKETS + 1) + of[a])[both]]
        self.held.append(np.stack(np.unique(np.concatenate(keys), return_counts=True)))

    def full(self) -> bool:
        return len(self.ids) > HELD or sum(h.shape[1] for h in self.held) > 16 * HELD

    def taken(self) -> Iterator[tuple[str, int, list[int], list[int]]]:
        """(word, n, buckets, counts) of all words held; nothing is held afterwards."""
        names = list(self.ids)
        if names:
            keys, counts = np.concatenate(self.held, axis=1)
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, weights=counts).astype(np.int64)
            word, slot = np.divmod(keys, BUCKETS + 1)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
            for a, b in zip(starts, [*starts[1:], len(word)], strict=True):
                yield names[word[a]], int(counts[b - 1]), slot[a : b - 1].tolist(), counts[a : b - 1].tolist()
        self.__init__()


_FACTS = "what string, file string, x string, shape string, unit int, n bigint, buckets array<int>, counts array<bigint>"


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass over the blocks: words with their contexts, words that keep a hyphen, and edge lines of scanned blocks."""
    columns = [c.split()[0] for c in _FACTS.split(", ")]
    held = Contexts()

    def words() -> pd.DataFrame:
        return pd.DataFrame([("word", None, w, None, None, n, b, c) for w, n, b, c in held.taken()], columns=columns)

    for rows in batches:
        hyphens, mended, lines, texts = Counter(), Counter(), [], []
        for r in rows.itertuples(index=False):
            mended.update((a + b).lower() for a, _, b in breaks(r.text) if b)
            text = joined(r.text)
            texts.append(_TOKEN.findall(text.lower()))
            hyphens.update(before(text, m.start()).lower() for m in _INLINE.finditer(text))
            if r.scanned and r.kind == "text" and r.unit == r.unit and r.unit is not None:
                unit = int(r.unit)
                for line in edge_lines(r.text, False, strict=True):
                    style = page_style(line)
                    if style:
                        lines.append(("page", r.file, style[0], None, unit, int(style[1] == unit)))
                    elif title_like(line):
                        title, number = titled(line)
                        shape = skeleton(re.sub(r"\d+", "#", title))
                        lines.append(("title", r.file, skeleton(title), shape, unit, int(number is None or number == unit)))
        held.add(texts)
        found = [("mended", None, w, None, None, n) for w, n in mended.items()] + [("hyphen", None, w, None, None, n) for w, n in hyphens.items() if len(w) > 1] + lines
        yield pd.DataFrame([(*x, None, None) for x in found], columns=columns)
        if held.full():
            yield words()
    yield words()


def rows_of(spark_rows: DataFrame, table_name: str, key: str, file: str, text: str, kind, unit, place=None, overlap=None) -> DataFrame:
    """Rows in the operator's columns; with ``place``, their order in the file and the characters they share with the row before."""
    order = [] if place is None else [place.cast("long").alias("place"), F.coalesce(overlap, F.lit(0)).cast("int").alias("overlap")]
    ext = F.lower(F.regexp_extract(F.col(file), r"\.([A-Za-z]+)$", 1))
    return spark_rows.where(F.col(text).rlike(r"(?U)\S")).select(
        F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.coalesce(file, F.lit("")).alias("file"),
        F.col(text).alias("text"), kind.alias("kind"), unit.cast("int").alias("unit"), ext.isin(*SCANNED).alias("scanned"), *order,
    )


class Learned:
    """What the blocks teach: vocabulary, words that keep a hyphen, misread words, running titles and page styles."""

    def __init__(self, blocks: DataFrame) -> None:
        spark = blocks.sparkSession
        folder = scratch_dir(spark, "scans")
        facts = written(parallel(blocks).mapInPandas(_learn, _FACTS), f"{folder}/facts")
        counted = facts.where("what in ('word', 'hyphen', 'mended')").groupBy("what", "x").agg(F.sum("n").alias("n"))
        counted = written(counted, f"{folder}/counted")
        self.vocabulary = counted.where("what = 'word'").select(F.col("x").alias("word"), "n")
        mended = counted.where("what = 'mended'").select(F.col("x").alias("word"), F.col("n").alias("n_mended"))
        whole = self.vocabulary.join(mended, "word", "left").where(F.col("n") > F.coalesce("n_mended", F.lit(0)))
        self.whole_words = whole.select("word")  # words that also stand undivided somewhere
        self.hyphens = counted.where("what = 'hyphen' and n > 1").select(F.col("x").alias("a"))
        contexts = facts.where("what = 'word'").select(F.col("x").alias("word"), F.inline(F.arrays_zip("buckets", "counts"))).toDF("word", "bucket", "n")
        contexts = written(contexts.groupBy("word", "bucket").agg(F.sum("n").alias("n")), f"{folder}/contexts")
        self.links = written(_links(self.vocabulary, contexts, folder), f"{folder}/links")
        best = self.links.groupBy("word").agg(F.max_by("near", F.struct("score", "near")).alias("near"))
        self.misread = written(best, f"{folder}/misread")
        pages = blocks.where("unit is not null").select("file", "unit").distinct().groupBy("file").agg(F.count("*").alias("n_pages"))
        lines = facts.where("what = 'title'").groupBy("file", "x", "shape", "unit").count().groupBy("file", "x", "shape").agg(F.count("*").alias("n_units"))
        sure = (F.col("n_units") >= 2) & (F.col("n_units") >= PAGE_SHARE * F.col("n_pages"))
        lines = lines.join(pages, "file").withColumn("sure", sure)
        shapes = lines.groupBy("shape").agg(F.count_if("sure").alias("n_sure"), F.count("*").alias("n_lines"))
        usual = shapes.where("n_sure >= 0.3 * n_lines").select("shape", (F.col("n_sure") >= 3).alias("usual"))
        accepted = lines.join(usual, "shape").where("sure or usual").select("file", "x").distinct()
        self.titles = written(accepted, f"{folder}/titles")
        styles = facts.where("what = 'page'").groupBy("file", "x").agg(F.sum("n").alias("hits"), F.count("*").alias("n"))
        self.styles = written(styles.where("hits >= 0.5 * n and (x <> 'parens' or hits > 1)").select("file", F.col("x").alias("style")), f"{folder}/styles")


def skip_grams(contexts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, vector): the skip-gram vector of each of the words.

    The objective of skip-grams with negative sampling is met by the pointwise mutual information of words and contexts;
    here contexts are hashed into ``BUCKETS`` places, so the vectors come from counts alone, for rare words as for frequent
    ones, and no table of the vocabulary is held anywhere. A vector maps the places with positive information to it.
    """
    n_bucket = contexts.groupBy("bucket").agg(F.sum("n").alias("n_bucket"))
    total = n_bucket.agg(F.sum("n_bucket").alias("total"))
    own = contexts.join(words, "word", "left_semi")
    n_word = own.groupBy("word").agg(F.sum("n").alias("n_word"))
    info = F.log(F.col("n") * F.col("total") / (F.col("n_word") * F.col("n_bucket")))
    scored = own.join(n_word, "word").join(F.broadcast(n_bucket), "bucket").crossJoin(F.broadcast(total)).withColumn("info", info).where("info > 0")
    return scored.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("info").cast("float")))).alias("vector"))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        n = [misread_glyphs(w, x) for w, x in zip(pairs["word"], pairs["near"], strict=True)]
        yield pairs[[k is not None and 0 < k <= (3 if len(w) > 5 else 2) for k, w in zip(n, pairs["word"], strict=True)]]


def _links(vocabulary: DataFrame, contexts: DataFrame, folder: str) -> DataFrame:
    """(word, near, score, vector): misread words, what each may stand for, and that word's vector where there are several."""
    words = vocabulary.where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).withColumn("shape", shape_key(F.col("word")))
    frequent = words.where(F.col("n") >= LEAST).select("shape", F.col("word").alias("near"), F.col("n").alias("n_near"))
    pairs = words.join(frequent, "shape").where(F.col("n_near") >= RATIO * F.col("n")).select("word", "n", "near", "n_near")
    pairs = written(spread(pairs).mapInPandas(_verified, "word string, n bigint, near string, n_near bigint"), f"{folder}/pairs")
    asked = pairs.select("word").unionByName(pairs.select(F.col("near").alias("word"))).distinct()
    v = written(skip_grams(contexts, asked), f"{folder}/vectors")
    both = pairs.join(v.withColumnRenamed("vector", "v"), "word", "left").join(v.toDF("near", "vector"), "near", "left")
    dot = "aggregate(map_keys(v), 0d, (s, b) -> s + v[b] * coalesce(vector[b], 0d))"
    norm = "sqrt(aggregate(map_values({0}), 0d, (s, x) -> s + x * x))"
    cosine = F.coalesce(F.expr(f"{dot} / nullif({norm.format('v')} * {norm.format('vector')}, 0d)"), F.lit(0.0))
    scored = both.withColumn("cosine", cosine).where(~((F.col("cosine") < UNLIKE) & (F.col("n") >= 20)))
    scored = scored.withColumn("score", F.log("n_near") + 4 * F.col("cosine"))
    several = scored.groupBy("word").agg(F.count("*").alias("n_links"))
    return scored.join(several, "word").select("word", "near", "score", F.when(F.col("n_links") > 1, F.col("vector")).alias("vector"), "cosine", "n", "n_near")


def _findings(misread: dict[str, str] | None):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(misread) if misread is not None else None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                t, k, text = r.table_name, r.row_key, r.text
                for a, hyphen, b in set(breaks(text)):
                    if hyphen == "-":
                        out.append((t, k, "break?", r.file, a.lower(), (a + b).lower() if b else ""))
                    else:
                        out.append((t, k, "broken_word", r.file, None, None))
                words = set(tokens(text))
                if known is None:
                    out.extend((t, k, "word?", r.file, w, None) for w in words)
                elif not known.isdisjoint(words):
                    out.append((t, k, "misread", r.file, None, None))
                if r.kind == "text":
                    for line in edge_lines(text, t == "chunks"):
                        style = page_style(line)
                        if style:
                            if r.unit is None or r.unit != r.unit or int(r.unit) == style[1]:
                                out.append((t, k, "page?", r.file, style[0], None))
                        elif title_like(line):
                            title, number = titled(line)
                            out.append((t, k, "title?", r.file, skeleton(title), None if number is None else str(number)))
            yield pd.DataFrame(out, columns=["table_name", "row_key", "what", "file", "x", "y"]).drop_duplicates()

    return scan


def misread_list(learned: Learned) -> dict[str, str] | None:
    """The misread words as a dictionary while they are few enough to broadcast."""
    if learned.misread.count() > BROADCAST:
        return None
    return {r.word: r.near for r in learned.misread.collect()}


def noise(rows: DataFrame, learned: Learned) -> DataFrame:
    """(table_name, row_key, noise): the kinds of noise in each row."""
    scan = _findings(misread_list(learned))
    schema = "table_name string, row_key string, what string, file string, x string, y string"
    found = written(parallel(rows.where("scanned")).mapInPandas(scan, schema), scratch_dir(rows.sparkSession, "noise"))
    key = ["table_name", "row_key"]
    named = lambda df, what: df.select(*key, F.lit(what).alias("noise"))
    sure = found.where("what in ('broken_word', 'misread')").select(*key, F.col("what").alias("noise"))
    breaks = found.where("what = 'break?'").withColumnRenamed("x", "a")
    kept = breaks.join(learned.hyphens, "a", "left_semi").join(learned.whole_words.withColumnRenamed("word", "y"), "y", "left_anti")
    broken = breaks.join(learned.hyphens, "a", "left_anti").select(*key).unionByName(
        breaks.join(learned.hyphens, "a", "left_semi").select(*key, "y").join(kept.select(*key, "y").distinct(), [*key, "y"], "left_anti").select(*key)
    )
    words = found.where("what = 'word?'").join(learned.misread.select(F.col("word").alias("x")), "x", "left_semi")
    titles = found.where("what = 'title?'").join(learned.titles, ["file", "x"], "left_semi")
    pages = found.where("what = 'page?'").withColumnRenamed("x", "style").join(learned.styles, ["file", "style"], "left_semi")
    every = [sure, named(broken, "broken_word"), named(words, "misread"), named(titles, "header"), named(titles.where("y is not null"), "page_no"), named(pages, "page_no")]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.distinct()


def reflowed(text: str, titles: frozenset[str], styles: frozenset[str], keeps: frozenset[str]) -> str:
    """One text without furniture, its words joined, its lines reflowed into paragraphs."""
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in p.strip().splitlines()]
        body = []
        for line in lines:
            style = page_style(line)
            if (style and style[0] in styles) or (title_like(line) and skeleton(titled(line)[0]) in titles):
                continue
            body.append(line)
        flat = "\n".join(body)
        flat = re.sub(
            rf"([^\W\d_]+)([{_HYPHENS}])[ \t]*\n\s*(?=[^\W\d_])",
            lambda m: m[1] + ("-" if m[2] == "-" and m[1].lower() in keeps else ""), flat,
        )
        flat = re.sub(r"\s*\n\s*", " " if not flat.lstrip().startswith("|") else "\n", flat).strip()
        head, tail = _HEAD.search(out[-1]) if out else None, _TAIL.match(flat)
        if head and tail and goes_on(head[1], tail[1]) and not (head[2] == "-" and head[1].lower() in keeps):
            out[-1] = out[-1][:-1] + flat
        elif flat:
            out.append(flat)
    return "\n\n".join(out)


def goes_on(head: str, tail: str) -> bool:
    """Whether the letters before and after a break may be of one word: small ones after it, or capitals on both sides."""
    return tail[0].islower() or (len(head) > 1 and head.isupper() and tail.isupper())


Links = dict[str, list[tuple[str, float, dict[int, float] | None]]]


def corrected(text: str, fixes: Links) -> str:
    """A text whose misread words are replaced, each by the neighbour that suits the words around it best."""
    found = list(_TOKEN.finditer(text))
    words = [m[0].lower() for m in found]
    out, at = [], 0
    for k, (m, w) in enumerate(zip(found, words, strict=True)):
        if w in fixes:
            near = [bucket(x) for i in range(max(0, k - WINDOW), min(len(words), k + WINDOW + 1)) if i != k for x in (words[i],)]
            fits = lambda link: (link[1] + sum((link[2] or {}).get(b, 0.0) for b in near), link[0])  # noqa: B023, E731
            out += [text[at : m.start()], _cased(m[0], max(fixes[w], key=fits)[0])]
            at = m.end()
    return "".join(out) + text[at:]


def _cased(was: str, word: str) -> str:
    return word.upper() if was.isupper() and len(was) > 1 else word[:1].upper() + word[1:] if was[:1].isupper() else word


def _title_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = {(r.table_name, r.row_key, r.file, skeleton(titled(line)[0])) for r in rows.itertuples(index=False) for x in r.text.splitlines() if title_like(line := x.strip())}
        yield pd.DataFrame(list(out), columns=["table_name", "row_key", "file", "x"])


def paragraphs(rows: DataFrame, learned: Learned) -> DataFrame:
    """(table_name, row_key, text): the readable text of each scanned row.

    The titles and kept hyphens that a row holds, its file's page styles and the links of its misread words travel with it, so
    nothing of unknown size is broadcast and no row gets more than concerns it.
    """
    own, key = rows.where("scanned").select("table_name", "row_key", "file", "text"), ["table_name", "row_key"]
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("text", rf"[{_HYPHENS}][ \t]*\r?\n[ \t]*", "")), F.lit(JAVA_TOKEN), F.lit(0))))
    fixes = own.select(*key, word.alias("word")).join(learned.links, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "near", "score", "vector")).alias("fixes"))
    part = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)-[ \t]*\r?\n"), F.lit(1))))
    keeps = own.select(*key, part.alias("a")).join(learned.hyphens, "a").groupBy(*key).agg(F.collect_set("a").alias("keeps"))
    lines = own.mapInPandas(_title_lines, "table_name string, row_key string, file string, x string")
    titles = lines.join(learned.titles, ["file", "x"], "left_semi").groupBy(*key).agg(F.collect_set("x").alias("titles"))
    styles = learned.styles.groupBy("file").agg(F.collect_set("style").alias("styles"))
    full = own.join(fixes, key, "left").join(keeps, key, "left").join(titles, key, "left").join(styles, "file", "left")

    placed = "place" in rows.columns

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: frozenset() if x is None else frozenset(x)

        def linked(found) -> Links:
            out: Links = {}
            for f in found if found is not None else ():
                out.setdefault(f["word"], []).append((f["near"], f["score"], dict(f["vector"]) if f["vector"] is not None else None))
            return out

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                fixes, known = linked(r.fixes), (some(r.titles), some(r.styles), some(r.keeps))
                plain = reflowed(r.text, *known)
                text = corrected(plain, fixes)
                if not placed or r.kind != "text" or r.place != r.place or not plain:
                    out.append((r.table_name, r.row_key, text, None, None, None, None, None, None, None, None))
                    continue
                head, tail = _HEAD.search(plain), _TAIL.match(reflowed(r.text[int(r.overlap) :], *known) if r.overlap else plain)
                if tail and (not r.overlap and tail.end() == len(plain) and head):
                    tail = None
                first = (tail[1], corrected(tail[2], fixes), 0 if r.overlap else len(corrected(tail[0], fixes))) if tail else (None, None, None)
                last = (head[1], head[2], len(corrected(head[1], fixes)) + 1) if head else (None, None, None)
                out.append((r.table_name, r.row_key, text, r.file, int(r.place), *first, *last))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")], dtype=object)

    schema = "table_name string, row_key string, text string, file string, place bigint, first string, after string, n_first int, last string, hyphen string, n_last int"
    if placed:
        full = full.join(rows.select("table_name", "row_key", "kind", "place", "overlap").groupBy("table_name", "row_key").agg(
            *[F.min(c).alias(c) for c in ("kind", "place", "overlap")]), ["table_name", "row_key"])
    done = spread(full).mapInPandas(repair, schema)
    if not placed:
        return done.select("table_name", "row_key", "text")
    done = written(done, scratch_dir(rows.sparkSession, "paragraphs"))
    pairs = written(_over_rows(done, learned), scratch_dir(rows.sparkSession, "divided"))
    out = done.join(pairs.select("table_name", "row_key", "last", "word"), ["table_name", "row_key", "last"], "left")
    taken = pairs.where("n_first > 0").select("table_name", F.col("next_key").alias("row_key"), "first", F.lit(True).alias("taken")).distinct()
    out = out.join(taken, ["table_name", "row_key", "first"], "left")
    whole = F.when(F.col("word").isNull(), F.col("text")).otherwise(F.concat(F.expr("left(text, length(text) - n_last)"), "word"))
    rest = F.when(F.col("taken"), F.regexp_replace(F.expr("substring(whole, n_first + 1)"), r"^\s+", "")).otherwise(F.col("whole"))
    return out.withColumn("whole", whole).select("table_name", "row_key", rest.alias("text"))


def _over_rows(done: DataFrame, learned: Learned) -> DataFrame:
    """(table_name, row_key, last, word, next_key, first, n_first): rows whose last word goes on in the file's next row, and that word."""
    nxt = F.struct(F.col("row_key").alias("next_key"), "first", "after", "n_first")
    one = done.where("place is not null").groupBy("table_name", "file", "place").agg(
        F.min(F.struct("row_key", "first", "after", "n_first", "last", "hyphen")).alias("r")
    ).select("table_name", "file", "place", "r.*").withColumn("part", F.floor(F.col("place") / RANGE))
    within = Window.partitionBy("table_name", "file", "part").orderBy("place")
    over = Window.partitionBy("table_name", "file").orderBy("part")
    parts = one.groupBy("table_name", "file", "part").agg(F.min_by(nxt, "place").alias("begins"))
    parts = parts.withColumn("beyond", F.lead("begins").over(over)).drop("begins")
    near = one.withColumn("near", F.lead(nxt).over(within)).where("last is not null").join(parts, ["table_name", "file", "part"])
    near = near.withColumn("n", F.coalesce("near", "beyond")).select("table_name", "row_key", "last", "hyphen", "n.*").where("first is not null")
    capitals = (F.length("last") > 1) & (F.col("last") == F.upper("last")) & (F.col("first") == F.upper("first"))
    near = near.where(F.col("first").rlike(r"^\p{Ll}") | capitals)
    hangs = learned.hyphens.select(F.col("a").alias("x"), F.lit("-").alias("hyphen"))
    near = near.withColumn("x", F.lower("last")).join(hangs, ["x", "hyphen"], "left_anti")
    near = near.withColumn("x", F.lower(F.concat("last", "first"))).join(learned.misread.select(F.col("word").alias("x"), "near"), "x", "left")
    initial = F.substring("last", 1, 1)
    cased = F.when(capitals, F.upper("near")).when(initial != F.lower(initial), F.concat(F.upper(F.substring("near", 1, 1)), F.expr("substring(near, 2)"))).otherwise(F.col("near"))
    word = F.concat(F.coalesce(cased, F.concat("last", "first")), "after")
    return near.select("table_name", "row_key", "last", word.alias("word"), "next_key", "first", "n_first")


def both_tables(blocks: DataFrame, chunks: DataFrame, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The project's blocks and chunks as rows of this operator; ``placed``: with their order in the file."""
    at = lambda place, overlap: (F.col(place), overlap) if placed else ()
    b = rows_of(blocks, "parsed_blocks", "block_id", "source_file", "content", F.col("kind"), F.col("unit"), *at("block_no", F.lit(0)))
    c = rows_of(chunks.withColumn("__file", F.col("provenance.source_document")), "chunks", "chunk_id", "__file", "text", F.lit("text"), F.lit(None), *at("chunk_index", F.col("overlap_prefix_chars")))
    return b, c

