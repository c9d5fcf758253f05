"""Counts of sub-word tokens, by a vocabulary file of ranks whose path is a parameter."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_encodings: dict = {}


def encoding(ranks_file: str, pattern: str):
    """The encoding of a file of ranks, loaded once in a worker."""
    import tiktoken

    if (ranks_file, pattern) not in _encodings:
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_file, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_file, pattern]


def token_count(text: Column, ranks_file: str, pattern: str) -> Column:
    """Tokens of a text, null for null; strings of special tokens are ordinary text."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(ranks_file, pattern)
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return count(text)
