"""Token counts by a public byte-level tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space around two blanks: where cutting at blanks would split a run that the pattern keeps whole.
_RUNS = re.compile(r" {2}\s|\s {2}")


class TokenCounter:
    """Counts tokens exactly, word by word, and remembers each word's count.

    The split pattern always starts a new piece at a blank before a character that is none, so counts of
    blank-separated words add up; texts with longer runs of white space are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remember: int = 400_000):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode, self.remember = encode, remember

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(encode(" " + word))
                return n

        self.known = Known()

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _RUNS.search(text):
            return len(self.encode(text))
        first, _, rest = text.partition(" ")
        if len(self.known) > self.remember:
            self.known.clear()
        return len(self.encode(first)) + (sum(map(self.known.__getitem__, rest.split(" "))) if _ else 0)


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> TokenCounter:
    """One counter a worker process and vocabulary."""
    return TokenCounter(vocabulary)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null or empty ones."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(counter(vocabulary), na_action=None).astype("int64")

    return count(text)
