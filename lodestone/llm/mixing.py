"""Records of several sources mixed to target shares of the total size.

Each source gets a budget: its share of all tokens. A source that is smaller than its budget is used in whole epochs
first, at most ``max_repeats``; the rest of the budget is filled by Efraimidis-Spirakis sampling: each text draws an
exponential key divided by its quality weight, and texts are taken in the order of their keys until the budget is
reached. The order within a source is found without sorting the source: keys fall into ranges on a logarithmic scale
(``PER_OCTAVE`` to each doubling, so no range holds more than a small share of any source, whatever its weights), whose token
sums are prefix-summed, so that only the range in which the budget ends is ordered row by row. A source with a third of all
rows is spread over all tasks until then.

A text that no longer fits ends a pass; what is left of the budget is then filled with the next texts in key order that are
short enough, pass by pass until no unused text fits, and then with texts that may be used once more, until none of those fits.
From the second pass on only texts that are short enough for some rest are read.

A text counts once however often it was loaded: identical texts are represented by the smallest id, so no text is used
more than ``max_repeats`` times.

Defined results: texts without tokens and sources without a target are used 0 times; a target without texts reports its
whole budget as short; the draw depends on the seed and the text's id alone; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import scratch_dir, written

PER_OCTAVE, NEVER = 512, 1 << 30


def quality(text: Column) -> Column:
    """Weight in (0.1, 1]: the share of letters in what isn't white space."""
    solid = F.regexp_replace(text, r"\s", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * letters / F.nullif(F.length(solid), F.lit(0)), F.lit(0.1))


def sample_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key of a text: the smaller, the earlier it is taken; heavier texts tend to smaller keys."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 1) / F.lit(float(2**53 + 1))
    return -F.log(uniform) / weight


def selection(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, times) of the representative texts that are used.

    ``sizes`` has doc_id, source, tokens, weight and digest (equal for identical texts).
    """
    targets = targets.select("source", "target_share", "max_repeats")
    total = sizes.agg(F.sum("tokens").alias("total"))
    first = F.min(F.struct("doc_id", "source", "tokens", "weight")).alias("x")
    own = sizes.where("tokens > 0").groupBy("digest").agg(first).select("digest", "x.*")
    own = own.withColumn("key", sample_key(F.col("doc_id"), F.col("weight"), seed))
    own = own.withColumn("bucket", F.floor(F.log2("key") * PER_OCTAVE))
    available = own.groupBy("source").agg(F.sum("tokens").alias("available"))
    budget = F.col("target_share") * F.col("total")
    epochs = F.least(F.floor(budget / F.col("available")), F.col("max_repeats").cast("bigint"))
    rest = F.when(epochs < F.col("max_repeats"), budget - epochs * F.col("available")).otherwise(F.lit(0.0))
    plan = available.join(targets, "source").crossJoin(F.broadcast(total))
    folder = scratch_dir(sizes.sparkSession, "mix")
    plan = written(plan.select("source", "max_repeats", epochs.alias("epochs"), rest.alias("rest")), f"{folder}/plan")
    rows = written(own.join(plan.select("source", "epochs", "max_repeats"), "source"), f"{folder}/rows")
    left, passes, extra, again = plan.select("source", "rest"), 0, None, False
    open_rows = rows
    while True:
        taken = written(_prefix(open_rows, left), f"{folder}/taken{passes}")
        used = taken.groupBy("source").agg(F.sum("tokens").alias("used"))
        nothing = taken.isEmpty()
        if nothing and again:
            break
        again = again or nothing
        extra = taken if extra is None else extra.unionByName(taken)
        left = left.join(used, "source", "left").select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"))
        passes += 1
        left = written(left, f"{folder}/left{passes}")
        uses = extra.groupBy("digest").agg(F.count("*").alias("extra"))
        short = rows.join(left.where("rest > 0"), "source").where("tokens <= rest").drop("rest").join(uses, "digest", "left").na.fill(0, ["extra"])
        may = F.col("epochs") + F.col("extra") < F.col("max_repeats")
        open_rows = written(short.where(may & ((F.col("extra") == 0) | F.lit(again))).drop("extra"), f"{folder}/open{passes}")
    uses = extra.groupBy("digest").agg(F.count("*").alias("extra"))
    counted = rows.join(uses, "digest", "left").na.fill(0, ["extra"])
    times = (F.col("epochs") + F.col("extra")).cast("int")
    return counted.select("doc_id", "source", "tokens", times.alias("times")).where("times > 0")


def _prefix(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """(digest, source, tokens) of the texts that fit the rest of their source, in key order up to the first that doesn't."""
    fitting = rows.join(rests.where("rest > 0"), "source").where("tokens <= rest")
    by_bucket = fitting.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = by_bucket.withColumn("upto", upto).groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("last"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("before"),
    )
    ends = ends.select("source", F.coalesce("last", F.lit(NEVER)).alias("last"), F.coalesce("before", F.lit(0)).alias("before"))
    near = fitting.join(ends, "source").where("bucket <= last")
    edge = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    border = near.where("bucket = last").withColumn("upto", F.col("before") + F.sum("tokens").over(edge)).where("upto <= rest")
    return near.where("bucket < last").select("digest", "source", "tokens").unionByName(border.select("digest", "source", "tokens"))


def shares(chosen: DataFrame, targets: DataFrame, total_tokens: DataFrame) -> DataFrame:
    """Target and reached share of each source, the most repeats used, and the tokens short of its budget."""
    used = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("times")).alias("mix_tokens"), F.count("*").alias("n_texts"), F.max("times").alias("most_repeats")
    )
    all_used = used.agg(F.sum("mix_tokens").alias("all_mix"))
    targets = targets.select("source", "target_share", "max_repeats")
    out = targets.join(used, "source", "left").na.fill(0, ["mix_tokens", "n_texts", "most_repeats"])
    out = out.crossJoin(F.broadcast(all_used)).crossJoin(F.broadcast(total_tokens))
    return out.select(
        "source", "target_share", "max_repeats", "n_texts", "most_repeats", "mix_tokens",
        F.round(F.col("mix_tokens") / F.col("all_mix"), 4).alias("reached_share"),
        (F.col("target_share") * F.col("total") - F.col("mix_tokens")).cast("bigint").alias("tokens_short"),
    )
