"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of byte-level BPE and the pattern that goes with it; both are parameters of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a rank file; read once by each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with a column tokens: the size of the whole text. Null and empty texts have 0."""

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return documents.withColumn("tokens", size(F.col(text)))
