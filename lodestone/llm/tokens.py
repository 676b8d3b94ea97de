"""Sizes of texts in tokens of a public tokenizer. Its file is read where the tasks run; the path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import parallel, scratch_dir, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of this kind of byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = TOKENIZER):
    """Arrow UDF: number of tokens of the whole text; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count


def sized(docs: DataFrame, doc_id: str, text: str, *columns, path: str = TOKENIZER) -> DataFrame:
    """A written table (uid, doc_id, tokens, further columns); uid is unique even where ids repeat."""
    rows = parallel(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *columns))
    counted = rows.withColumn("tokens", token_count(path)(F.col("__text"))).drop("__text")
    return written(counted.withColumn("uid", F.monotonically_increasing_id()), scratch_dir(docs.sparkSession, "tokens"))
