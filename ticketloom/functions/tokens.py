"""Token counts by the vocabulary of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vocabulary file of ranks; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts are encoded in pieces of about so many characters, cut before a single space, where the pattern always parts them.
PIECE = 200_000
_SPACE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    # Fixed value: the public pattern of this vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    at = 0
    while m := _SPACE.search(text, at + PIECE):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counter(path: str = TOKENIZER):
    """A pandas UDF text -> number of tokens; null and empty texts have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in texts], dtype="int64")

    return count


def token_count(c: Column, path: str = TOKENIZER) -> Column:
    return token_counter(path)(c)
