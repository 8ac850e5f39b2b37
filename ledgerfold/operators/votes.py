"""Recorded votes in speeches, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ROLES, name_key, number_token

# Numerals, what names a motion, what separates names in minutes.
_NUMERALS = "0-9０-９〇零一二三四五六七八九十百千万"
MOTION = r"([^。\s]{2,40}?)(?:案件?|の件)(?:について|の採決)"
SEPARATORS = r"[\s　、,，]+"


def is_recorded(text: Column) -> Column:
    return text.contains("記名投票") | (text.contains("投票総数") & text.contains("賛成") & text.contains("反対"))


def announced(text: Column, word: str) -> Column:
    """The first number after a word, in a text without spaces; null if it is none."""
    return number_token(F.regexp_extract(text, f"{word}[^{_NUMERALS}]*([{_NUMERALS}]+)", 1))


def roster(text: Column, side: str, other: str) -> Column:
    """Names after the last ``{side}者``, up to the next heading word. Runs of names
    are cut at separators and after each honorific; a 君 inside a name cuts as well."""
    mark = f"{side}者"
    tail = F.when(text.contains(mark), F.substring_index(text, mark, -1)).otherwise("")
    block = F.split(tail, f"{other}|投票総数|以上")[0]
    chunks = F.flatten(F.transform(F.split(block, SEPARATORS), lambda c: F.split(c, "君|さん")))
    return F.filter(F.transform(chunks, name_key), lambda n: (n != "") & ~n.isin(*ROLES))


def recorded_votes(speeches: DataFrame) -> DataFrame:
    """Vote events: issue_id, speech_id, vote_event_id, motion, counts, result,
    confidence, needs_review, yes_names, no_names. ``speeches``: issue_id,
    speech_id, speech_order, text. A tie is rejected; abstentions are not read
    from speeches (0). Events are numbered in order within their meeting."""
    text = F.col("text")
    bare = F.translate(text, " 　\n\t", "")
    found = speeches.where(is_recorded(text)).select(
        "issue_id",
        "speech_id",
        "speech_order",
        F.trim(F.regexp_extract(text, MOTION, 1)).alias("motion"),
        announced(bare, "投票総数").alias("total"),
        announced(bare, "賛成[者数]?").alias("yes"),
        announced(bare, "反対[者数]?").alias("no"),
        roster(text, "賛成", "反対").alias("yes_names"),
        roster(text, "反対", "賛成").alias("no_names"),
    )
    counted = F.col("yes").isNotNull() & F.col("no").isNotNull()
    adds_up = F.col("total").isNull() | (F.col("total") == F.col("yes") + F.col("no"))
    named = (F.size("yes_names") == F.col("yes")) & (F.size("no_names") == F.col("no"))
    confidence = F.when(~counted | ~adds_up, "low").when(named, "high").otherwise("medium")
    number = F.row_number().over(Window.partitionBy("issue_id").orderBy("speech_order", "speech_id"))
    return found.select(
        "issue_id",
        "speech_id",
        F.concat_ws("#", "issue_id", number.cast("string")).alias("vote_event_id"),
        "motion",
        F.coalesce("yes", F.lit(0)).alias("yes_count"),
        F.coalesce("no", F.lit(0)).alias("no_count"),
        F.lit(0).alias("abstain_count"),
        F.when(~counted, "unknown").when(F.col("yes") > F.col("no"), "passed").otherwise("rejected").alias("result"),
        confidence.alias("confidence"),
        (confidence != "high").alias("needs_review"),
        "yes_names",
        "no_names",
    )


def named_votes(events: DataFrame) -> DataFrame:
    """One row for each name: issue_id, vote_event_id, option, voter_name."""
    both = F.concat(_side("yes"), _side("no"))
    return events.select("issue_id", "vote_event_id", F.explode(both).alias("v")).select("issue_id", "vote_event_id", "v.option", "v.voter_name")


def _side(option: str) -> Column:
    return F.transform(f"{option}_names", lambda n: F.struct(F.lit(option).alias("option"), n.alias("voter_name")))


def review_queue(events: DataFrame) -> DataFrame:
    """Events that a person should look at, the least certain first."""
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return events.where("needs_review").orderBy(rank, "vote_event_id")


def tally(votes: DataFrame, seats: DataFrame, on: str = "name_key", by: tuple[str, ...] = ()) -> DataFrame:
    """District code and name with yes, no and abstain, from votes that meet a seat, for
    each value of ``by`` (vote_event_id, say). Namesakes in the seats fan out, as in the
    roster itself; codes stay text."""
    joined = votes.join(seats.where("not is_pr"), on)
    return joined.groupBy(*by, "district_code", "district_name").agg(*[F.count_if(F.col("option") == o).cast("long").alias(o) for o in ("yes", "no", "abstain")])


def category() -> Column:
    """What a tally row says: unanimous yes or no, split, or nothing."""
    yes, no = F.col("yes") > 0, F.col("no") > 0
    return F.when(yes & no, "split").when(yes, "yes").when(no, "no").otherwise("none")


def coverage(votes: DataFrame, seats: DataFrame, on: str = "name_key") -> DataFrame:
    """One row: joined rows, those that met a seat, and votes that did (equal votes each)."""
    met = votes.join(seats.groupBy(on).agg(F.count(F.lit(1)).alias("_seats")), on, "left")
    return met.agg(
        F.coalesce(F.sum(F.coalesce("_seats", F.lit(1))), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum("_seats"), F.lit(0)).cast("long").alias("matched"), F.count("_seats").alias("matched_votes")
    )


def map_codes(tally_rows: DataFrame) -> DataFrame:
    """A row for each single code of joint districts, with the category."""
    return tally_rows.withColumn("code", F.explode(F.split("district_code", ","))).withColumn("category", category())
