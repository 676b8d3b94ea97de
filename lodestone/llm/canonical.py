"""Freely entered values mapped to the closest entry of a reference list.

Every reference spelling is a key: look-alikes resolved, lower case, transliterated, words stemmed lightly. The keys
stand in a BK-tree under the Levenshtein metric, whose root is the empty text (its children are the key lengths). The
triangle inequality prunes the search and returns every key within the radius; swapped neighbours cost two there, so
the radius is twice the number of slips allowed, and the candidates are then held against the Damerau metric. Values
are first reduced to their distinct forms by Spark; a form is searched once, whatever the number of rows that share it,
and a block of forms walks down the tree together, so that a node is compared with all forms that reach it at once.

A reference list is split into shards of at most ``SHARD`` keys by a hash of the entry, the distinct values into blocks
of at most ``BLOCK``; every block meets every shard in a task of its own, and the winners of all shards merge: all entries
at the smallest distance stay, so the result doesn't depend on the number of shards. Neither list passes through the driver.

A word cut off by a full stop stands for every reference word that it begins (one slip is allowed beyond four letters).
Such a value is compared only with spellings that have as many words and a fitting word in each place of a cut one, so the
work is bounded by the spellings that hold a fitting word, however many words are cut.

Defined results: null, blank and placeholder values are unmatched; a value that is only a code is looked up by its
mentions, and by the code itself where exactly one entry has it; repeated aliases count once, blank ones never; a tie
between different entries is no match, in whichever shards they stand; empty tables give empty results; each row gets at
most one entry.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.lookalikes import bigram_scores, consistent
from lodestone.session import scratch_dir, written

SHARD, SLIPS, BLOCK, WIDTH, PAIRS = 20_000, 2, 200_000, 8192, 500_000
# Romanisation of Cyrillic, and word endings (romanised), longest first.
ROMAN = (
    "а a б b в v г g д d е e ё e ж zh з z и i й j к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch "
    "ъ - ы y ь - э e ю yu я ya і i"
)
ENDINGS = "ogo ego omu emu ymi imi aya yaya oye oe yj ij oj ej ym im om em ykh ikh uyu yuyu iya ii iyu iej ie ye iem yami ami akh ov ev ya yu a y i u e o"
# Marks of samples, lots and variants that may follow or precede a name; labels of pure codes.
MARK_WORDS = "проба пробы партия партии образец образца лот вариант вар серия серии опыт sample lot batch variant var no specimen"
CODE_LABELS = "прод поток поз позиция item проба образец партия лот продукт stream pos sample lot code код шифр"
PLAIN_MARKS = r"(?:исходн\w*|контрольн\w*|повторн\w*|initial|original)\s+(?:вар|вариант|проба|var|variant|sample)\w*\.?"

_ROMAN = {k: v.replace("-", "") for k, v in zip(ROMAN.split()[::2], ROMAN.split()[1::2], strict=True)}
_GROUPS = sorted(((r, c) for c, r in _ROMAN.items() if len(r) > 1), key=lambda x: -len(x[0]))
_ENDINGS = sorted(ENDINGS.split(), key=len, reverse=True)
_W = "|".join(MARK_WORDS.split())
_MARKS = re.compile(
    rf"\[\s*\d+\s*\]|\(\s*(?:{_W})\b\.?\s*(?:№|no\.?|#)?\s*[\w-]*\s*\)|[,;]?\s*\b(?:{_W})\b\.?\s*(?:№|no\.?|#)?\s*[a-zа-я]?-?\d[\w-]*"
    rf"|№\s*\d[\w-]*|#\s*\d+|{PLAIN_MARKS}", re.I
)
_CODE = re.compile(rf"^[\W_]*(?:{'|'.join(CODE_LABELS.split())})[\W_]*\d[\w-]*\W*$", re.I)


def roman(text: str) -> str:
    return "".join(_ROMAN.get(c, c) for c in text)


@lru_cache(65536)
def stem(word: str) -> str:
    """A romanised word without its ending; at least three letters stay."""
    for e in _ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            word = word[: -len(e)]
            break
    return word[:-2] + word[-1] if len(word) > 4 and word.endswith("ok") else word


def words(text: str) -> list[tuple[str, bool]]:
    """Romanised words of a consistent text without marks; True for a word cut off by a full stop."""
    t = _MARKS.sub(" ", text.lower().replace("ё", "е"))
    found = re.findall(r"([^\W_]+)('?)(\.?)", t)
    return [(roman(w), dot == "." and len(w) > 1) for w, _, dot in found]


def key(found: list[tuple[str, bool]], stems: bool = True) -> str:
    """Stems with each group of letters that romanises one Cyrillic letter as one character, so that a slip counts once.

    With ``stems`` False the words keep their endings.
    """
    t = " ".join(stem(w) if stems else w for w, _ in found)
    for many, one in _GROUPS:
        t = t.replace(many, one)
    return t


def is_code(text: str) -> bool:
    """A label with a number, or one short word in capitals (letters and digits)."""
    t = text.strip(" .,;:!\"'()[]«»")
    return bool(_CODE.match(text)) or (len(t) <= 6 and t.isalnum() and t == t.upper() and any(c.isalpha() for c in t))


def measure(a: str):
    """The edit distance to ``a`` as a function, bit-parallel; what depends on ``a`` alone is worked out once."""
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    n = len(a)
    last, full, get = (1 << n) >> 1, (1 << n) - 1, peq.get

    def distance(b: str) -> int:
        if not n:
            return len(b)
        pv, mv, score = full, 0, n
        for c in b:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph = ph << 1 | 1
            pv = (mh << 1 | ~(xv | ph)) & full
            mv = ph & xv & full
        return score

    return distance


def levenshtein(a: str, b: str) -> int:
    return measure(a)(b)


def damerau(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (unrestricted, a metric). What both begin or end with costs nothing."""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    seen: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, before = seen.get(y, 0), at
            if x == y:
                at = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][before] + (i - k - 1) + 1 + (j - before - 1)
            )
        seen[x] = i
    return d[-1][-1]


class BKTree:
    """Keys under the Levenshtein metric; gives every key within a radius.

    Searches go down level by level: all (text, node) pairs of a level have their distances worked out together, bit-parallel.
    """

    def __init__(self, keys: list[str]) -> None:
        self.keys, children = [""], [{}]
        for k in keys:
            at, to = 0, measure(k)
            while (d := to(self.keys[at])) in children[at]:
                at = children[at][d]
            if d:
                children[at][d] = len(self.keys)
                self.keys.append(k)
                children.append({})
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(keys))), 1)}
        self.sizes = np.array([len(k) for k in self.keys])
        self.peq = np.zeros((len(self.keys), len(self.alphabet) + 1), dtype=np.uint64)  # column 0: letters of no key
        for n, k in enumerate(self.keys):
            for i, c in enumerate(k[:64]):
                self.peq[n, self.alphabet[c]] |= np.uint64(1 << i)
        self.count = np.array([len(c) for c in children])
        self.first = np.cumsum(self.count) - self.count
        self.child = np.array([n for c in children for n in c.values()], dtype=np.int64)
        self.edge = np.array([d for c in children for d in c], dtype=np.int64)

    def _distances(self, texts: list[str], codes: np.ndarray, lengths: np.ndarray, text: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distances of the pairs; they come with the longest texts first."""
        size, n = self.sizes[node], len(text)
        score, own = size.astype(np.int64), lengths[text]
        one, shift = np.uint64(1), np.maximum(size - 1, 0).astype(np.uint64)
        pv, mv = np.full(n, 2**64 - 1, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for j in range(int(own[0]) if n else 0):
            n = int(np.searchsorted(-own, -j))  # pairs whose text has a letter here
            p, m, eq = pv[:n], mv[:n], self.peq[node[:n], codes[j, text[:n]]]
            xv, xh = eq | m, (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            score[:n] += ((ph >> shift[:n]) & one).astype(np.int64) - ((mh >> shift[:n]) & one).astype(np.int64)
            ph = ph << one | one
            pv[:n] = mh << one | ~(xv | ph)
            mv[:n] = ph & xv
        score = np.where(size == 0, own, score)
        for k in np.flatnonzero(size > 64):
            score[k] = levenshtein(self.keys[node[k]], texts[text[k]])
        return score

    def within_all(self, radius_of: dict[str, int]) -> Iterator[tuple[str, str]]:
        """(text, key) for every text and every key within the radius of the text."""
        texts = sorted(radius_of, key=len, reverse=True)
        radius, lengths = np.array([radius_of[t] for t in texts], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.zeros((len(texts[0]) if texts else 0, len(texts)), dtype=np.int32)
        for k, t in enumerate(texts):
            codes[: len(t), k] = [self.alphabet.get(c, 0) for c in t]
        todo = [(np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64))]
        while todo:
            text, node = todo.pop()
            if len(text) > PAIRS:
                todo.append((text[PAIRS:], node[PAIRS:]))
                text, node = text[:PAIRS], node[:PAIRS]
            d = self._distances(texts, codes, lengths, text, node)
            hit = (d <= radius[text]) & (node > 0)
            yield from ((texts[k], self.keys[n]) for k, n in zip(text[hit], node[hit], strict=True))
            count = self.count[node]
            at = np.repeat(np.arange(len(text)), count)
            edge = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[node], count)
            near = np.abs(self.edge[edge] - d[at]) <= radius[text[at]]
            if near.any():
                todo.append((text[at[near]], self.child[edge[near]]))


def slips_of(text: str) -> int:
    return SLIPS if len(text) >= 8 else len(text) // 5


Words = list[tuple[str, bool]]


class Matcher:
    """Search of one shard: spelling keys with their entry ids, and pure codes.

    Ranks order what is found: twice the slips, and one more where cut words were written out.
    """

    def __init__(self, spellings: tuple[tuple[str, str], ...]) -> None:
        self.ids: dict[str, set[str]] = {}
        self.full: dict[str, set[str]] = {}  # keys with their spellings, endings kept
        self.codes: dict[str, set[str]] = {}
        self.forms: list[tuple[str, Words]] = []  # entry and words; compounds once in parts and once as one word
        for entry, spelling in spellings:
            if is_code(spelling):
                self.codes.setdefault(spelling.strip().lower(), set()).add(entry)
                continue
            found = words(spelling)
            self.ids.setdefault(key(found), set()).add(entry)
            self.full.setdefault(key(found), set()).add(key(found, stems=False))
            whole = words(re.sub(r"(?<=[^\W_])-(?=[^\W_])", "", spelling))
            self.forms += [(entry, found)] + ([(entry, whole)] if whole != found else [])
        self.ids.pop("", None)
        self.longest = max(map(len, self.ids), default=0)
        self.tree = BKTree(list(self.ids))
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, form) in enumerate(self.forms):
            for i, (w, _) in enumerate(form):
                self.places.setdefault(w, []).append((k, i))
        self.sorted_words = sorted(self.places)
        self.beginnings: dict[int, tuple[BKTree, dict[str, list[str]]]] = {}
        self.begun = lru_cache(100_000)(self._begun)

    def code(self, text: str) -> set[str]:
        return self.codes.get(text.strip(" .,;:!\"'()[]«»").lower(), set())

    def best(self, texts: list[str]) -> list[tuple[bool, int | None, list[str]]]:
        """(code, rank, entries) of the closest entries of consistent texts; words may stand in any rotation."""
        out: list[tuple[bool, int | None, list[str]]] = []
        near: dict[int, list[tuple[int, str]]] = {}
        asked: dict[str, list[tuple[int, str]]] = {}  # key → (place, key with endings)
        for n, text in enumerate(texts):
            entries = self.code(text)
            code = bool(entries) or is_code(text)
            out.append((code, 0 if entries else None, sorted(entries)))
            found = [] if code else words(text)
            turns = [found[i:] + found[:i] for i in range(len(found))] if len(key(found)) <= self.longest + SLIPS else []
            keys = [key(t) for t in turns]
            near[n] = [(0, e) for k in keys for e in self.ids.get(k, ())]
            if any(cut for _, cut in found):
                near[n] += self._written_out(found)
            if not near[n]:
                for k, t in zip(keys, turns, strict=True):
                    asked.setdefault(k, []).append((n, key(t, stems=False)))
        for k, own in self.tree.within_all({k: 2 * slips_of(k) for k in asked}):
            stems = damerau(k, own)
            for n, full in asked[k]:
                d = stems if stems <= 1 else max(1, min(stems, *(damerau(full, f) for f in self.full[own])))
                if d <= slips_of(k):
                    near[n] += [(2 * d, e) for e in self.ids[own]]
        for n, hits in near.items():
            if hits:
                least = min(hits)[0]
                out[n] = (False, least, sorted({e for d, e in hits if d == least}))
        return out

    def _begun(self, cut: str) -> dict[str, int]:
        """Reference words that a cut word begins, with the slips."""
        out, at = {}, bisect_left(self.sorted_words, cut)
        while at < len(self.sorted_words) and self.sorted_words[at].startswith(cut):
            out[self.sorted_words[at]] = 0
            at += 1
        if len(cut) > 4:
            if len(cut) not in self.beginnings:
                short: dict[str, list[str]] = {}
                for w in self.sorted_words:
                    short.setdefault(w[: len(cut)], []).append(w)
                self.beginnings[len(cut)] = (BKTree(list(short)), short)
            tree, short = self.beginnings[len(cut)]
            for _, b in tree.within_all({cut: 1}):
                for w in short[b]:
                    out.setdefault(w, 1)
        return out

    def _written_out(self, found: Words) -> list[tuple[int, str]]:
        n, fitting = len(found), None
        for i, (w, cut) in enumerate(found):
            if cut:
                here: dict[tuple[int, int], int] = {}
                for x, d in self.begun(w).items():
                    for k, at in self.places[x]:
                        if len(self.forms[k][1]) == n:
                            here[k, (at - i) % n] = d
                fitting = here if fitting is None else {f: fitting[f] + d for f, d in here.items() if f in fitting}
        out = []
        for (k, shift), d in (fitting or {}).items():
            entry, form = self.forms[k]
            turned = [found[(i - shift) % n] for i in range(n)]
            mine = [form[i] if cut else (w, False) for i, (w, cut) in enumerate(turned)]
            own, theirs = key(mine), key(form)
            if own != theirs:
                d += max(1, min(damerau(own, theirs), damerau(key(mine, stems=False), key(form, stems=False))))
            if d <= slips_of(own):
                out.append((2 * d + 1, entry))
        return out


@lru_cache(2)
def _matcher(spellings: tuple[tuple[str, str], ...]) -> Matcher:
    return Matcher(spellings)


def reference_spellings(reference: DataFrame, entry_id: str, name: str, aliases: str) -> DataFrame:
    """(entry, spelling) of names and aliases, without blank ones."""
    every = F.explode(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    out = reference.select(F.col(entry_id).alias("entry"), every.alias("spelling"))
    return out.where("entry is not null and trim(spelling) <> ''").distinct()


def _search(scores: dict):
    def search(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        matcher, out = _matcher(tuple(sorted(zip(shard["entry"], shard["spelling"], strict=True)))), []
        values = block["value"].tolist()
        for i in range(0, len(values), WIDTH):
            part = values[i : i + WIDTH]
            out += [(v, *found) for v, found in zip(part, matcher.best([consistent(v, scores) for v in part]), strict=True)]
        return pd.DataFrame(out, columns=["value", "code", "rank", "entries"])

    return search


def distinct_values(values: DataFrame) -> DataFrame:
    """(value, n): each value once, written."""
    return written(values.groupBy("value").agg(F.count("*").alias("n")), scratch_dir(values.sparkSession, "values"))


def matched_values(distinct: DataFrame, spellings: DataFrame, scores: dict) -> DataFrame:
    """(value, code, rank, entries) of distinct values: the closest entries over all shards, none where too far."""
    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parts, blocks = max(1, -(-spellings.count() // SHARD)), max(4 * tasks, -(-distinct.count() // BLOCK))
    key_of = ["shard", "block"]
    left = distinct.select("value", F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"))
    right = spellings.select("*", F.pmod(F.xxhash64("entry"), F.lit(parts)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    left, right = left.repartition(tasks, *key_of), right.repartition(tasks, *key_of)
    found = left.groupBy(*key_of).cogroup(right.groupBy(*key_of)).applyInPandas(_search(scores), "value string, code boolean, rank int, entries array<string>")
    if parts > 1:
        hit = F.when(F.size("entries") > 0, F.struct("code", "rank", "entries"))
        every = found.groupBy("value").agg(F.bool_or("code").alias("code"), F.collect_list(hit).alias("hits"))
        every = every.withColumn("hits", F.expr("filter(hits, x -> x.code = code)")).withColumn("rank", F.array_min("hits.rank"))
        found = every.select("value", "code", "rank", F.expr("array_distinct(flatten(transform(filter(hits, x -> x.rank = rank), x -> x.entries)))").alias("entries"))
    return written(found, scratch_dir(spark, "canonical"))


def mapped_rows(df: DataFrame, row_id: str, name: str, others: str, spellings: DataFrame) -> DataFrame:
    """(row_id, entry, distance) for each row: entry is null where nothing on the list is named."""
    spark = df.sparkSession
    every = df.select(F.col(row_id).alias("row_id"), F.col(name).alias("value"), F.col(others).alias("others"))
    rows, nameless = every.where("value is not null"), every.where("value is null")
    distinct = distinct_values(rows.select("value"))
    scores = bigram_scores(distinct, F.col("n"))
    one = F.when(F.size("entries") == 1, F.col("entries")[0])
    named = rows.join(matched_values(distinct, spellings, scores), "value")
    plain = named.where(~F.col("code")).select("row_id", one.alias("entry"), "rank")
    coded = named.where("code").select(F.monotonically_increasing_id().alias("uid"), "row_id", "others", one.alias("own"), "rank")
    coded = written(coded, scratch_dir(spark, "codes"))
    mentions = coded.select("uid", F.explode("others").alias("value")).where("value is not null")
    hits = mentions.join(matched_values(distinct_values(mentions.select("value")), spellings, scores).where(~F.col("code")), "value")
    by_mention = hits.groupBy("uid").agg(F.collect_set(one).alias("mentioned"), F.lit(True).alias("has_mentions"))
    coded = coded.join(by_mention, "uid", "left")
    mentioned = F.when(F.size("mentioned") == 1, F.col("mentioned")[0])
    entry = F.when(F.col("has_mentions"), mentioned).otherwise(F.col("own"))
    out = plain.unionByName(coded.select("row_id", entry.alias("entry"), "rank"))
    out = out.unionByName(nameless.select("row_id", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("int").alias("rank")))
    return out.select("row_id", "entry", F.floor(F.col("rank") / 2).alias("distance"))
