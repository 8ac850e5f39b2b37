"""Detail and list queries over the read models. Each returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import law_link, or_empty, stream_source
from ..operators import chain, paging, votes


def _id(value: str) -> str:
    if not 0 < len(value.encode()) <= 64:
        raise ValueError("ids have 1 to 64 bytes")
    return value


def attributed(rows: DataFrame, log: DataFrame, watch: DataFrame | None = None, was_ocr: bool = False) -> DataFrame:
    """Adds ``attribution`` (source, stream, seq, time, hashes, permalink, whether the
    text was read from images) from the row's own event. The permalink is the row's own
    ``url`` if it has one, else the watched address of its stream, else that of the law.
    ``was_ocr`` is the snapshot's own where the log has that column."""
    stream = F.col("stream_id")
    read = F.coalesce(F.col("was_ocr"), F.lit(was_ocr)) if "was_ocr" in log.columns else F.lit(was_ocr)
    facts = log.select(F.col("seq").alias("_seq"), "stream_id", "seq", F.col("observed_at").alias("fetched_at"), "content_hash", "log_hash", read.alias("_ocr"))
    address = F.lit(None).cast("string")
    if watch is not None:
        facts = facts.join(watch.select(F.col("stream_id").alias("_of"), F.col("url").alias("_watched")), stream == F.col("_of"), "left")
        address = F.col("_watched")
    law = F.when(stream_source(stream) == "egov-law", law_link(F.substring_index(stream, ":", -1)))
    known = facts.select("_seq", F.struct(stream_source(stream).alias("source"), "stream_id", "seq", "fetched_at", "content_hash", "log_hash", or_empty(F.coalesce(address, law)).alias("permalink"), F.col("_ocr").alias("was_ocr")).alias("attribution"))
    out = rows.join(known, F.col("seq") == F.col("_seq"), "left").drop("_seq")
    if "url" in rows.columns:
        own = F.when(or_empty(F.col("url")) != "", F.col("url")).otherwise(F.col("attribution.permalink"))
        out = out.withColumn("attribution", F.col("attribution").withField("permalink", own))
    return out


def newest_session(rows: DataFrame, session: int) -> DataFrame:
    """Rows of a session, of the newest one for 0."""
    if session:
        return rows.where(F.col("session") == session)
    newest = rows.agg(F.max("session").alias("_newest"))  # one row
    return rows.join(F.broadcast(newest), F.col("session") == F.col("_newest")).drop("_newest")


def get_meeting(meetings: DataFrame, speeches: DataFrame, issue_id: str) -> DataFrame:
    head = meetings.where(F.col("issue_id") == _id(issue_id)).select("issue_id", "name", "house", "date")
    return head.join(speeches.where(F.col("issue_id") == issue_id), "issue_id", "left").orderBy("speech_order")


def list_meetings(meetings: DataFrame, session: int = 0, house: str = "", n: int = 0, token: str = "") -> DataFrame:
    return paging.offset_page(paging.optional(meetings, session=session, house=house), [F.col("date").desc_nulls_last(), F.col("issue_id")], token, n)


def vote_event_rows(events: DataFrame, cast: DataFrame, meetings: DataFrame, seats: DataFrame) -> DataFrame:
    """Events with their meetings, a row for each vote with the voter's district."""
    own = events.join(meetings.select("issue_id", "name", "date"), "issue_id")
    bound = cast.drop("issue_id").join(seats.select("person_id", "district_code", "district_name", "is_pr"), "person_id", "left")
    return own.join(bound, "vote_event_id", "left")


def get_vote_event(events: DataFrame, cast: DataFrame, meetings: DataFrame, seats: DataFrame, vote_event_id: str) -> DataFrame:
    own = F.col("vote_event_id") == _id(vote_event_id)
    return vote_event_rows(events.where(own), cast.where(own), meetings, seats).orderBy("option", "voter_name")


def list_vote_events(events: DataFrame, cast: DataFrame, meetings: DataFrame, session: int = 0, house: str = "", mappable_only: bool = False, n: int = 0, token: str = "") -> DataFrame:
    named = cast.select("vote_event_id").distinct().withColumn("_named", F.lit(True))
    rows = events.join(newest_session(meetings, session).select("issue_id", "session", "house", "date"), "issue_id")
    rows = paging.optional(rows, house=house).join(named, "vote_event_id", "left").withColumn("has_named_votes", F.coalesce("_named", F.lit(False))).drop("_named")
    rows = rows.where("has_named_votes") if mappable_only else rows
    return paging.offset_page(rows, [F.col("date").desc_nulls_last(), F.col("vote_event_id")], token, n)


def get_law(laws: DataFrame, nodes: DataFrame, law_id: str) -> DataFrame:
    return laws.where(F.col("law_id") == _id(law_id)).select("law_id", "title", "law_num").join(nodes.where(F.col("law_id") == law_id), "law_id", "left").orderBy("ordinal")


def list_laws(laws: DataFrame, law_type: str = "", n: int = 0, token: str = "") -> DataFrame:
    return paging.offset_page(paging.optional(laws, law_type=law_type), [F.col("enforced_on").desc_nulls_last(), F.col("law_id")], token, n)


def get_law_changes(changes: DataFrame, log: DataFrame, law_id: str, n: int = 0, token: str = "") -> DataFrame:
    own = log.where(F.col("stream_id") == f"egov-law:{_id(law_id)}").select("seq", "observed_at")
    return paging.offset_page(own.join(changes, F.col("seq") == F.col("change_id")), [F.desc("seq")], token, n)


def legislator_records(persons: DataFrame, cast: DataFrame, events: DataFrame, meetings: DataFrame) -> DataFrame:
    """Every person, and their votes only if the identity is certain."""
    own = persons.select("person_id", "name", "identity_confidence")
    record = cast.drop("issue_id").join(events.select("vote_event_id", "issue_id", "motion", "result"), "vote_event_id").join(meetings.select("issue_id", "date", "house"), "issue_id")
    sure = record.withColumn("_c", F.lit("high")).withColumnRenamed("person_id", "_p")
    return own.join(sure, (F.col("person_id") == F.col("_p")) & (F.col("identity_confidence") == F.col("_c")), "left").drop("_p", "_c")


def list_legislator_votes(persons: DataFrame, cast: DataFrame, events: DataFrame, meetings: DataFrame, person_id: str, n: int = 0, token: str = "") -> DataFrame:
    """A page of one person's record."""
    own = F.col("person_id") == _id(person_id)
    rows = legislator_records(persons.where(own), cast.where(own), events, meetings)
    return paging.offset_page(rows, [F.col("date").desc_nulls_last(), F.col("vote_event_id"), F.col("option")], token, n)


def list_roll_calls(events: DataFrame, session: int = 0, n: int = 0, token: str = "") -> DataFrame:
    return paging.offset_page(newest_session(events, session), [F.col("vote_date").desc_nulls_last(), F.col("vote_event_id")], token, n)


def get_vote_map(cast: DataFrame, seats: DataFrame, vote_event_id: str, house: str = "councillors") -> dict[str, DataFrame]:
    """Tally by district (text order), coverage, and the panel of members without a district."""
    own = cast.where(F.col("vote_event_id") == _id(vote_event_id)).select("vote_event_id", "name_key", "option", "voter_name")
    here = seats.where(F.col("house") == house)
    panel = own.join(here.where("is_pr").select("name_key", "name", "pr_block", "parliamentary_group"), "name_key").orderBy("option", "name")
    return {"tally": votes.tally(own, here).withColumn("category", votes.category()).orderBy("district_code"), "coverage": votes.coverage(own, here), "panel": panel}


def get_stream_verification(events: DataFrame, checkpoints: DataFrame, stream: str) -> DataFrame:
    """Events of a stream in order, each with its own checks, the checkpoint that covers
    the stream's last one, and the verdict: whether every check holds."""
    own = chain.content_chain(chain.recomputed(events.where(F.col("stream_id") == stream)))
    whole = chain.covering(own.groupBy("stream_id").agg(F.max("seq").alias("max_seq"), F.bool_and(F.col("hash_ok") & F.coalesce("content_ok", F.lit(True))).alias("all_ok")), checkpoints)
    marked = own.join(F.broadcast(whole.select(F.col("stream_id").alias("_of"), "covered_by", "all_ok")), F.col("stream_id") == F.col("_of"))  # one row
    return marked.select("seq", "stream_seq", "type", "log_hash", "hash_ok", "content_ok", "covered_by", "all_ok").orderBy("stream_seq")
