"""A keyword index: which streams hold which runs of characters, so a search reads no log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import KEYWORD_CHARS, keyword

LONGEST = 3


def grams(text: Column, sizes: range = range(1, LONGEST + 1)) -> Column:
    """Distinct runs of 1 to 3 characters of the text in small letters."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substr(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def index(texts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``gram, key``: a row for each key and run of characters that one of its columns
    holds. Store it sorted by ``gram``: a search then reads the few row groups of its own."""
    found = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))
    return texts.select(key, F.explode(found).alias("gram")).distinct()


def candidates(postings: DataFrame, key: str, word: str) -> DataFrame:
    """Keys that hold all of the word's runs of three characters; a shorter word is a run itself."""
    word = word.strip()[:KEYWORD_CHARS].lower()
    runs = [word] if len(word) <= LONGEST else sorted({word[i : i + LONGEST] for i in range(len(word) - LONGEST + 1)})
    return postings.where(F.col("gram").isin(runs)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(runs)).select(key)


def matches(texts_of: Callable[[DataFrame], DataFrame], postings: DataFrame, key: str, columns: list[str], word: str) -> DataFrame:
    """Keys one of whose ``columns`` holds the word as it stands: the texts of the
    candidates, which ``texts_of`` looks up, are checked, and no others."""
    return keyword(texts_of(candidates(postings, key, word)), columns, word).select(key).distinct()
