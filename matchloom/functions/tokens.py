"""Token counters.

The counter of the published model needs its vocabulary file, which is a parameter
(``WordPieceCounter``). Without it ``PatternCounter`` counts words and single other
characters, plus the two special tokens: deterministic, the same in Python, Spark and SQL, but not
the model's numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


class PatternCounter:
    #: Counts of texts add up where they are joined by blanks or punctuation.
    adds_up = True
    PATTERN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"
    SPECIAL = 2

    def __init__(self):
        self._found = re.compile(self.PATTERN, re.ASCII)

    def count(self, text: str) -> int:
        return len(self._found.findall(text)) + self.SPECIAL

    @classmethod
    def column(cls, text: Column) -> Column:
        return F.regexp_count(text, F.lit(cls.PATTERN)) + cls.SPECIAL


class WordPieceCounter:
    """Exact counts with a WordPiece vocabulary file (one token a line), untruncated, with special tokens."""

    adds_up = True

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self._tokenizer = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "_tokenizer": None}

    def count(self, text: str) -> int:
        if self._tokenizer is None:
            from tokenizers import BertWordPieceTokenizer

            self._tokenizer = BertWordPieceTokenizer(self.vocabulary, lowercase=True)
        return len(self._tokenizer.encode(text, add_special_tokens=True).ids)


def remembered(counter: TokenCounter, most: int = 50_000):
    """The counter's count with a bounded memory."""
    return lru_cache(maxsize=most)(counter.count)


class Costs:
    """Counts of whole texts and, for a counter whose counts add up, of pieces of a text without the special tokens."""

    def __init__(self, counter: TokenCounter, most: int = 50_000):
        self.whole = remembered(counter, most)
        self.adds_up = getattr(counter, "adds_up", False)
        self.empty = counter.count("") if self.adds_up else 0

    def piece(self, text: str) -> int:
        return self.whole(text) - self.empty


def counted(counter: TokenCounter, text: Column) -> Column:
    """Token counts of a column of texts by any counter."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([counter.count(t) for t in texts], dtype="int32")

    return run(F.coalesce(text, F.lit("")))
