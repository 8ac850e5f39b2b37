"""Filters, pages and bounded counts. Parameters left empty add nothing to the plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE, MAX_OFFSET, COUNT_CAP, KEYWORD_CHARS = 50, 200, 100_000, 10_000, 128


def page_size(n: int) -> int:
    return n if 0 < n <= MAX_PAGE else DEFAULT_PAGE


def optional(df: DataFrame, **equals) -> DataFrame:
    """Equality on each parameter that is not empty; lists are allow-lists."""
    for name, value in equals.items():
        if value not in (None, "", 0, []):
            df = df.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def time_range(df: DataFrame, column: str, since: str = "", until: str = "") -> DataFrame:
    """``since <= t < until``; anything that is no RFC 3339 time is refused before planning."""
    for text, test in ((since, F.col(column).__ge__), (until, F.col(column).__lt__)):
        if text:
            if datetime.fromisoformat(text).tzinfo is None:
                raise ValueError(f"no time zone: {text}")
            df = df.where(test(F.lit(text).cast("timestamp")))
    return df


def keyword(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows where a column holds the word as it stands, letter case apart."""
    word = word.strip()[:KEYWORD_CHARS].lower()
    if not word:
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(word)), F.lit(False))
    return df.where(found)


def parse_cursor(token: str) -> tuple[str, int]:
    """Direction and seq of a page token; anything malformed is the head page."""
    way, _, number = token.rpartition(":")
    if number.isdigit() and int(number) > 0 and way in ("", "older", "newer"):
        return way or "older", int(number)
    return "older", 0


def keyset_page(df: DataFrame, token: str = "", n: int = 0, key: str = "seq") -> DataFrame:
    """A page by key, newest first, and one row more (``extra`` true) if there is a next one."""
    n, (way, at) = page_size(n), parse_cursor(token)
    if way == "newer":
        part = df.where(F.col(key) > at).orderBy(key).limit(n + 1)
    else:
        part = (df.where(F.col(key) < at) if at else df).orderBy(F.desc(key)).limit(n + 1)

    order = F.col(key) if way == "newer" else F.desc(key)
    return part.withColumn("extra", F.row_number().over(Window.orderBy(order)) > n).orderBy(F.desc(key))  # n + 1 rows


def page_tokens(keys: list[int], token: str, n: int) -> tuple[list[int], str, str]:
    """From the collected keys of a page (newest first): those to show, token of older and of newer rows."""
    n, (way, at) = page_size(n), parse_cursor(token)
    more = len(keys) > n
    shown = (keys[1:] if way == "newer" else keys[:n]) if more else keys
    if not shown:
        return [], "", ""
    older = f"older:{shown[-1]}" if way == "newer" or more else ""
    newer = f"newer:{shown[0]}" if (way == "newer" and more) or (way == "older" and at) else ""
    return shown, older, newer


def offset_page(df: DataFrame, order: list[Column], token: str = "", n: int = 0) -> DataFrame:
    """A page by offset with one row more; bad tokens start at 0."""
    at = int(token) if token.isdigit() and int(token) <= MAX_OFFSET else 0
    return df.orderBy(*order).offset(at).limit(page_size(n) + 1)


def bounded_count(df: DataFrame, cursor: int = 0, n: int = 0, key: str = "seq", cap: int = COUNT_CAP) -> DataFrame:
    """One row: rows up to the cap, how many of the newest are above the cursor, page number."""
    newest = df.select(key).orderBy(F.desc(key)).limit(cap)
    counted = newest.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(key) >= cursor if cursor else F.lit(False)).cast("long").alias("above"))
    return counted.withColumn("page", (F.floor(F.col("above") / page_size(n)) + 1).cast("long"))
