"""The timeline: the log with what read models know of each event, filtered and paged.

Filters on the log's own columns, and the cursor, apply to the narrow log; a class
filter is a semi-join with the changes; a keyword is a semi-join with the streams that an index
finds, and needs titles before the page is cut only where there is no index. A page has
201 rows at most, so its rows are looked up in the read models by their keys, which
reach the scans, and a count joins nothing that no filter reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import or_empty, stream_source
from ..operators import keywords, paging
from ..operators.diff import op_count

SEARCHED = ["title", "subtitle", "category", "stream_id"]


@dataclass(frozen=True)
class Parts:
    """The log and the read models that its events are shown with (columns: see ``enriched``)."""

    log: DataFrame
    meetings: DataFrame
    laws: DataFrame
    changes: DataFrame
    votes: DataFrame
    #: Postings of the streams' texts (see ``postings``), for keywords.
    index: DataFrame | None = None


def enriched(log: DataFrame, meetings: DataFrame, laws: DataFrame, changes: DataFrame, votes: DataFrame) -> DataFrame:
    """The log joined to meetings and laws by stream, to changes and first votes by seq.

    ``meetings``: stream_id, name, issue; ``laws``: stream_id, title, law_num,
    category; ``changes``: observation_seq, classification, class_confidence,
    node_changes; ``votes``: observation_seq, vote_event_id. Left joins; only the
    ``op`` of each node change is read.
    """
    return _shown(_titled(log, meetings, laws), changes, votes)


def _titled(log: DataFrame, meetings: DataFrame, laws: DataFrame) -> DataFrame:
    m = meetings.select(F.col("stream_id").alias("m_stream"), F.col("name").alias("m_name"), F.col("issue").alias("m_issue"))
    w = laws.select(F.col("stream_id").alias("w_stream"), F.col("title").alias("w_title"), F.col("law_num").alias("w_num"), "category")
    rows = log.join(m, F.col("stream_id") == F.col("m_stream"), "left").join(w, F.col("stream_id") == F.col("w_stream"), "left")
    meeting, law = F.col("m_stream").isNotNull(), F.col("w_stream").isNotNull()
    return rows.select(
        "seq",
        "stream_id",
        stream_source(F.col("stream_id")).alias("source"),
        "type",
        "observed_at",
        "content_hash",
        F.when(meeting, or_empty(F.col("m_name"))).when(law, or_empty(F.col("w_title"))).otherwise("").alias("title"),
        F.when(meeting, or_empty(F.col("m_issue"))).when(law, or_empty(F.col("w_num"))).otherwise("").alias("subtitle"),
        or_empty(F.col("category")).alias("category"),
    )


def _shown(titled: DataFrame, changes: DataFrame, votes: DataFrame) -> DataFrame:
    counts = [op_count(F.col("node_changes"), op).alias(op) for op in ("added", "deleted", "modified")]
    c = changes.select(F.col("observation_seq").alias("c_seq"), "classification", "class_confidence", *counts)
    v = votes.groupBy(F.col("observation_seq").alias("v_seq")).agg(F.min("vote_event_id").alias("vote_event_id"))
    rows = titled.join(c, F.col("seq") == F.col("c_seq"), "left").join(v, F.col("seq") == F.col("v_seq"), "left")
    return rows.select(
        *titled.columns,
        or_empty(F.col("classification")).alias("classification"),
        or_empty(F.col("class_confidence")).alias("class_confidence"),
        *[F.coalesce(op, F.lit(0)).cast("long").alias(op) for op in ("added", "deleted", "modified")],
        or_empty(F.col("vote_event_id")).alias("vote_event_id"),
    )


def stream_texts(parts: Parts, streams: DataFrame) -> DataFrame:
    """What a keyword is looked for in: title, subtitle and category of each stream.
    ``streams``: their ids (all of them, to make an index)."""
    rows = streams.select("stream_id", F.lit(0).cast("long").alias("seq"), F.lit("").alias("type"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit("").alias("content_hash"))
    return _titled(rows, parts.meetings, parts.laws).select(*SEARCHED)


def postings(texts: DataFrame) -> DataFrame:
    """The keyword index of ``stream_texts``; write it sorted by ``gram``."""
    return keywords.index(texts, "stream_id", SEARCHED)


def filtered(parts: Parts, source: str = "", event_type: str = "", classification: str = "", since: str = "", until: str = "", word: str = "", sources: list[str] | None = None) -> DataFrame:
    """Events that pass, as rows of the log; with titles if a keyword asks for them."""
    rows = paging.optional(parts.log.withColumn("source", stream_source(F.col("stream_id"))), source=source, type=event_type)
    rows = paging.time_range(paging.optional(rows, source=sources or []), "observed_at", since, until)
    if classification:
        own = parts.changes.where(F.col("classification") == classification).select(F.col("observation_seq").alias("seq"))
        rows = rows.join(own, "seq", "left_semi")
    if word.strip() and parts.index is not None:
        # what a stream is called is the same for all its events: streams are found first, then the log is cut by them
        own = keywords.matches(lambda streams: stream_texts(parts, streams), parts.index, "stream_id", SEARCHED, word)
        rows = rows.join(own, "stream_id", "left_semi")
    elif word.strip():
        rows = paging.keyword(_titled(rows, parts.meetings, parts.laws), SEARCHED, word)
    return rows.select("seq", "stream_id", "type", "observed_at", "content_hash")


def page(parts: Parts, token: str = "", n: int = 0, **filters) -> DataFrame:
    """A page of the timeline, newest first. Its at most 201 rows come to the driver,
    and the read models are asked for their streams and seqs only."""
    cut = paging.keyset_page(filtered(parts, **filters), token, n)
    found = cut.collect()
    log = parts.log.sparkSession.createDataFrame(found, cut.schema)
    streams, seqs = sorted({r.stream_id for r in found}), [r.seq for r in found]
    of_stream, of_seq = F.col("stream_id").isin(streams), F.col("observation_seq").isin(seqs)
    shown = enriched(log.drop("extra"), parts.meetings.where(of_stream), parts.laws.where(of_stream), parts.changes.where(of_seq), parts.votes.where(of_seq))
    return shown.join(F.broadcast(log.select("seq", "extra")), "seq").orderBy(F.desc("seq"))  # a page


def count(parts: Parts, cursor: int = 0, n: int = 0, **filters) -> DataFrame:
    return paging.bounded_count(filtered(parts, **filters), cursor, n)
