"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: Vocabulary used by the queries: ranks of a byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file; loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of the whole text; 0 for a null or empty one.

    Strings of special tokens in a text are ordinary text. Equal texts of a batch are measured once.
    """

    @F.pandas_udf("bigint")
    def call(texts: pd.Series) -> pd.Series:
        codec = encoding(vocabulary)
        codes, distinct = pd.factorize(texts)
        sizes = [len(codec.encode_ordinary(t)) for t in distinct] + [0]
        return pd.Series([sizes[c] for c in codes], dtype="int64")

    return call(text)
