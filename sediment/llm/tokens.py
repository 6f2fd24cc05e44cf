"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; another one may be named in the environment or as a parameter.
TOKENIZERS = os.environ.get("SEDIMENT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# The pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(df: DataFrame, text: str = "text", out: str = "tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of its text, 0 for null and empty texts; whole texts are encoded."""

    @F.pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        enc = encoding(folder, name)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return df.withColumn(out, run(F.col(text)))
