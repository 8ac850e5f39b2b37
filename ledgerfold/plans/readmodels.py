"""Read models: one job each, from the log and its payloads, never from one another.

Each model is a function from events and snapshots to its tables, and ``heads``: the last
event of each stream, by which rows of earlier events go. The same function reads the
whole log or a batch of it; ``STREAMED`` tells how its tables take a batch. Payloads
are unpacked and decoded once for each distinct content, and what several tables are made
from is written once (``folder``: where).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diff, folds, observe, people, votes
from ..sources import lawtree, payloads
from ..sources.store import written
from ..streaming.models import ReadModels, Table


def log_scan(events: DataFrame, snapshots: DataFrame, after: int = 0, prefix: str = "", limit: int = 0) -> DataFrame:
    """Events with content after an offset, of one source, with their bytes; with
    ``limit``, the first so many by seq. Events are narrow; bytes are joined last, by
    content hash, and unpacked."""
    own = events.where((F.col("seq") > after) & F.col("content_hash").isNotNull())
    own = own.where(F.col("stream_id").startswith(prefix)) if prefix else own
    own = own.orderBy("seq").limit(limit) if limit else own
    return payloads.plain_payloads(own.join(snapshots.select("content_hash", "payload"), "content_hash"))


def _of_source(events: DataFrame, *prefixes: str) -> DataFrame:
    own = F.lit(False)
    for p in prefixes:
        own = own | F.col("stream_id").startswith(p)
    return events.where(F.col("content_hash").isNotNull() & own).select("stream_id", "seq", "content_hash")


def _contents(own: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``stream_id`` (the content hash), ``seq`` and unpacked bytes of each distinct content."""
    used = snapshots.join(own.select("content_hash").distinct(), "content_hash", "left_semi").dropDuplicates(["content_hash"])
    return payloads.plain_payloads(used.select(F.col("content_hash").alias("stream_id"), F.lit(0).cast("long").alias("seq"), "payload"))


def _by_event(own: DataFrame, by_content: DataFrame) -> DataFrame:
    """Rows of contents as rows of the events that have them."""
    rows = by_content.withColumnRenamed("stream_id", "_hash").drop("seq")
    return own.join(rows, F.col("content_hash") == F.col("_hash")).select("stream_id", "seq", *[c for c in rows.columns if c != "_hash"])


def minutes(events: DataFrame, snapshots: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Meetings, speeches, people, groups, memberships, vote events, votes. Meetings,
    speeches and votes follow the latest snapshot, also if that has no speech any more;
    people and groups keep all."""
    own = _of_source(events, "kokkai:")
    found = written(_by_event(own, payloads.meetings(_contents(own, snapshots))), folder)
    spoken, last = payloads.speeches(found), folds.heads(found, "stream_id")
    now = folds.latest_children(spoken, "stream_id", heads=last)
    vote_events = votes.recorded_votes(now)
    of = now.select("issue_id", "stream_id", "seq").distinct()
    return {
        "meeting": folds.latest(found.drop("speeches"), "issue_id"),
        "speech": now,
        "person": people.people(spoken),
        "organization": people.organizations(spoken),
        "membership": people.memberships(spoken),
        "vote_event": vote_events.drop("yes_names", "no_names").join(of, "issue_id"),
        "vote": people.resolved(votes.named_votes(vote_events), now).join(of, "issue_id"),
        "heads": last,
    }


def laws(events: DataFrame, snapshots: DataFrame, listing: DataFrame | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """Law headers and the nodes of each law's latest content; type, category and
    revision come from the landed listing."""
    last = folds.latest(_of_source(events, "egov-law:"), "stream_id")
    nodes = written(lawtree.law_nodes(snapshots.join(last.select("content_hash").distinct(), "content_hash", "left_semi")), folder)
    both = last.join(nodes, "content_hash").withColumn("law_id", F.substring_index("stream_id", ":", -1))
    head = both.groupBy("law_id").agg(F.max("stream_id").alias("stream_id"), F.max("seq").alias("seq"), F.max("law_num").alias("law_num"), F.max("title").alias("title"), F.max("title_kana").alias("title_kana"), F.max("degraded").alias("degraded"))
    head = head.withColumn("url", C.law_link(F.col("law_id")))
    if listing is not None:
        head = head.join(listing.select(F.col("local_key").alias("law_id"), "law_type", "category", "enforced_on"), "law_id", "left")
    return {"legislative_work": head, "law_node": both.where("eid is not null").drop("content_hash", "law_num", "title", "title_kana"), "heads": last.select("stream_id", "seq")}


def changes(events: DataFrame, snapshots: DataFrame, folder: str | None = None) -> DataFrame:
    """A change record for each event that changed a law's content."""
    pairs = observe.revisions(events.where(F.col("stream_id").startswith("egov-law:"))).select(F.col("seq").alias("change_id"), "stream_id", "earlier", "content_hash")
    used = pairs.select(F.col("earlier").alias("content_hash")).union(pairs.select("content_hash")).distinct()
    return changes_of(pairs, written(lawtree.law_nodes(snapshots.join(folds.dealt(used), "content_hash", "left_semi")), folder))


def changes_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Change records of ``pairs`` (change_id, stream_id, earlier, content_hash) from the
    parsed trees of their contents."""
    sides = {}
    for side, digest in (("prev", "earlier"), ("curr", "content_hash")):
        ids = pairs.select("change_id", F.col(digest).alias("_hash"))
        sides[side] = ids.join(folds.dealt(nodes), F.col("_hash") == nodes["content_hash"]).drop("_hash")
    bad = sides["prev"].select("change_id", "degraded").union(sides["curr"].select("change_id", "degraded")).groupBy("change_id").agg(F.bool_or("degraded").alias("degraded"))
    found = diff.node_changes(sides["prev"].where("eid is not null"), sides["curr"].where("eid is not null"))
    return diff.change_records(pairs.select("change_id", "stream_id").join(folds.dealt(bad), "change_id", "left"), found)


def seats(events: DataFrame, snapshots: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Every seat that any page of either house gave a person, the last one of each
    person, and the last event of each page."""
    found = []
    for prefix, decode in (("giin-roster:", payloads.lower_house_roster), ("sangiin-roster:", payloads.upper_house_roster)):
        own = _of_source(events, prefix)
        found.append(_by_event(own, decode(_contents(own, snapshots))))
    return {"seat": folds.latest(found[0].unionByName(found[1]), "person_id"), "heads": folds.heads(_of_source(events, "giin-roster:", "sangiin-roster:"), "stream_id")}


def rosters(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Seats of both houses after all pages in order (see ``folds.last_writer``): a person
    whom a page took over and then dropped is gone."""
    found = seats(events, snapshots)
    return folds.latest_children(found["seat"], "stream_id", heads=found["heads"])


def roll_calls(events: DataFrame, snapshots: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Vote events and votes of each roll-call page's latest content."""
    own = _of_source(events, "sangiin-vote:")
    parts = written(payloads.page_parts(_contents(own, snapshots)), folder)
    found, cast = payloads.roll_calls_of(parts)
    slug = F.substring_index("stream_id", ":", -1).alias("vote_event_id")
    last = folds.heads(own, "stream_id")
    event = folds.latest_children(_by_event(own, found), "stream_id", heads=last).select(slug, "*")
    vote = folds.latest_children(_by_event(own, cast), "stream_id", heads=last).select(slug, "*")
    return {"event": event.withColumn("url", C.roll_call_link(F.col("session"), F.col("vote_event_id"))), "vote": vote, "heads": last}


_PERSON, _SPAN = ("name", "yomi", "identity_confidence"), "spans"
#: Tables of the models that follow the log, and how each takes a batch.
STREAMED: dict[str, dict[str, Table]] = {
    "minutes": {
        "meeting": Table("rows", ("issue_id",)), "speech": Table("children", ("stream_id",)), "person": Table(_SPAN, ("person_id",), attributes=_PERSON),
        "organization": Table(_SPAN, ("org_id",), attributes=("name", "classification")), "membership": Table(_SPAN, ("person_id", "org_id"), attributes=("role",)),
        "vote_event": Table("children", ("stream_id",)), "vote": Table("children", ("stream_id",)),
    },
    "laws": {"legislative_work": Table("rows", ("law_id",)), "law_node": Table("children", ("stream_id",))},
    "rosters": {"seat": Table("rows", ("person_id",), while_listed="stream_id")},
    "roll_calls": {"event": Table("children", ("stream_id",)), "vote": Table("children", ("stream_id",))},
}
_MODELS: dict[str, Callable] = {"minutes": minutes, "laws": laws, "rosters": seats, "roll_calls": roll_calls}


def streamed(spark: SparkSession, path: str, name: str, snapshots: Callable[[], DataFrame], buckets: int = 64, **options) -> ReadModels:
    """A model of ``STREAMED`` that follows the log under ``path``. ``snapshots`` is asked
    anew for each batch; events of other sources only move the offset."""

    def derive(batch: DataFrame, folder: str) -> dict[str, DataFrame]:
        return _MODELS[name](batch, snapshots(), folder=folder, **options)

    return ReadModels(spark, path, STREAMED[name], derive, "stream_id", buckets=buckets)


@dataclass(frozen=True)
class Changes:
    """Change records that follow the log: a batch of new contents meets the stored last
    content of its streams, and each content is parsed once in its life, its tree kept by
    its hash in buckets. What a batch reads: the buckets of its streams and contents."""

    spark: SparkSession
    path: str
    snapshots: Callable[[], DataFrame]
    buckets: int = 64
    prefix: str = "egov-law:"

    @property
    def models(self) -> ReadModels:
        tables = {"tail": Table("rows", ("stream_id",)), "node": Table("children", ("content_hash",)), "change": Table("rows", ("change_id",), "change_id")}
        return ReadModels(self.spark, self.path, tables, lambda batch, folder: {}, "content_hash", buckets=self.buckets)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: ``batch`` has stream_id, seq, stream_seq, content_hash."""
        models = self.models
        folder = f"{self.path}/scratch-{batch_id}"
        try:
            own = batch.where(F.col("stream_id").startswith(self.prefix))
            with_content = own.where("content_hash is not null")
            tail = models.near("tail", own, batch_id)
            pairs = written(observe.revisions(own, tail=tail).select(F.col("seq").alias("change_id"), "stream_id", "earlier", "content_hash"), folder)
            # the first content of a stream will be the earlier side of a change to come
            needed = with_content.select("content_hash").union(pairs.select(F.col("earlier").alias("content_hash"))).distinct()
            stored = models.near("node", needed, batch_id)
            new = observe.new_only(needed, "content_hash", stored)
            parsed = written(lawtree.law_nodes(self.snapshots().join(folds.dealt(new), "content_hash", "left_semi")).withColumn("seq", F.lit(0).cast("long")), folder)
            nodes = parsed if stored is None else parsed.unionByName(stored.drop("_bucket"))
            last = folds.latest(with_content.select("stream_id", "seq", F.col("content_hash").alias("last_content")), "stream_id")
            heads = parsed.select("content_hash", "seq").distinct()
            models.put({"tail": last, "node": parsed, "heads": heads, "change": changes_of(pairs, nodes.drop("seq"))}, batch_id, batch.agg(F.max("seq")).first()[0])
        finally:
            fs, p = models._fs(folder)
            fs.delete(p, True)

    def read(self) -> DataFrame | None:
        found = self.models.read("change")
        return None if found is None else found.drop("_bucket")
