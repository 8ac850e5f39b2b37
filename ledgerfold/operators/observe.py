"""From observations to events: what changed, in which order, stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import dealt


def usable(fetches: DataFrame, registry: DataFrame, key: str = "local_key") -> DataFrame:
    """Adds ``status`` to fetch results: present, pending (no payload, but the
    registry still lists it), absent (neither), error (the outcome is unknown)."""
    listed = registry.select(F.col(key).alias("listed")).distinct()
    joined = fetches.join(listed, fetches[key] == F.col("listed"), "left")
    status = (
        F.when(F.col("present").isNull(), "error")
        .when(F.col("present") & ~F.coalesce("content_unavailable", F.lit(False)), "present")
        .when(F.col("listed").isNotNull(), "pending")
        .otherwise("absent")
    )
    return joined.withColumn("status", status).drop("listed")


def transitions(observations: DataFrame, stream: str, order: list[str], content: str, tail: DataFrame | None = None) -> DataFrame:
    """Observations that are events, with ``type``, ``prev_content_hash``, ``stream_seq``.

    ``content`` is null for an absence. One window over each stream: the raw value
    before and the last value that was not null decide, so no row needs the rows
    before it one by one. A stream's observations are sorted together in a task.
    ``tail`` (see ``tail_state``) is what a stored log knows of the streams: they go
    on from their last content and sequence, and content that came already gives nothing.
    """
    w = Window.partitionBy(stream).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    now, raw, last = F.col(content), F.lag(content).over(w), F.last(content, ignorenulls=True).over(before)
    counted = F.lit(0).cast("long")
    if tail is not None:
        known = tail.select(F.col("stream_id").alias("_of"), F.when(F.col("last_type") != "vanished", F.col("last_content")).alias("_there"), F.col("last_content").alias("_last"), (F.col("next_seq") - 1).alias("_count"))
        observations = observations.join(dealt(known), F.col(stream) == F.col("_of"), "left")
        raw = F.when(F.row_number().over(w) == 1, F.col("_there")).otherwise(raw)
        last = F.coalesce(last, F.col("_last"))
        counted = F.coalesce("_count", counted)
    marked = observations.select("*", raw.alias("_raw"), last.alias("prev_content_hash"), counted.alias("_counted"))
    kind = (
        F.when(now.isNull() & F.col("_raw").isNotNull(), "vanished")
        .when(now.isNull(), None)
        .when(F.col("prev_content_hash").isNull(), "observed")
        .when(F.col("_raw").isNull(), "restored")
        .when(now != F.col("prev_content_hash"), "changed")
    )
    events = marked.withColumn("type", kind).where("type is not null")
    return events.withColumn("stream_seq", (F.row_number().over(w) + F.col("_counted")).cast("long")).drop("_raw", "_counted", "_of", "_there", "_last", "_count")


def tail_state(events: DataFrame, content: str = "content_hash") -> DataFrame:
    """Last type, last content (absences skipped) and next sequence of each stream."""
    return events.groupBy("stream_id").agg(
        F.max_by("type", "stream_seq").alias("last_type"),
        F.max_by(content, F.when(F.col(content).isNotNull(), F.col("stream_seq"))).alias("last_content"),
        (F.max("stream_seq") + 1).cast("long").alias("next_seq"),
    )


def global_sequence(rows: DataFrame, order: list[str], bucket: Column, start: int = 0) -> DataFrame:
    """Adds ``seq``, counted over all rows in order of (``bucket``, ``order``).

    ``bucket`` is a coarse prefix of the order (a day of a timestamp). Rows are
    counted per bucket, the few bucket totals are summed up, and rows are numbered
    inside their bucket: no task sees all rows.
    """
    cut = rows.withColumn("_bucket", bucket)
    totals = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = cut.withColumn("_i", inside).join(starts, F.col("_bucket").eqNullSafe(F.col("_of")))
    return numbered.withColumn("seq", (F.col("_start") + F.col("_i") + start).cast("long")).drop("_bucket", "_n", "_of", "_start", "_i")


def new_only(rows: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """One row for each key that is not stored yet (snapshots by content, streams by id)."""
    once = rows.dropDuplicates([key])
    return once if stored is None else once.join(dealt(stored.select(key)), key, "left_anti")


def watch_upsert(stored: DataFrame, refs: DataFrame) -> DataFrame:
    """The watch list with the streams of ``refs`` (stream_id, url): new ones enabled,
    stored ones with the new address and their own switch."""
    new = refs.groupBy("stream_id").agg(F.max("url").alias("new_url"))
    both = stored.select("stream_id", "url", "enabled").join(new, "stream_id", "full_outer")
    return both.select("stream_id", F.coalesce("new_url", "url").alias("url"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def revisions(events: DataFrame, content: str = "content_hash", tail: DataFrame | None = None) -> DataFrame:
    """Pairs of consecutive contents: each event with the content before it. ``tail``
    (stream_id, last_content): of streams that a stored log knows, what came before the
    first of ``events``."""
    before = Window.partitionBy("stream_id").orderBy("stream_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last(content, ignorenulls=True).over(before)
    if tail is not None:
        events = events.join(dealt(tail.select(F.col("stream_id").alias("_of"), F.col("last_content").alias("_known"))), F.col("stream_id") == F.col("_of"), "left")
        earlier = F.coalesce(earlier, F.col("_known"))
    found = events.withColumn("earlier", earlier).drop("_of", "_known")
    return found.where(F.col(content).isNotNull() & F.col("earlier").isNotNull() & (F.col(content) != F.col("earlier")))


def poll_health(polls: DataFrame, period: str = "INTERVAL 1 DAY", back_off: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Per stream: failures since the last success, next due time, end of the back-off.

    ``polls``: stream_id, at, outcome (ok, pending, failed). Pending clears the
    back-off and keeps the failures. Counted by aggregates: failures after the
    last success, and the outcome of the last poll.
    """
    good = polls.where("outcome = 'ok'").groupBy("stream_id").agg(F.max("at").alias("last_ok"))
    joined = polls.join(good, "stream_id", "left")
    failed = (F.col("outcome") == "failed") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))
    out = joined.groupBy("stream_id").agg(
        F.count_if(failed).cast("long").alias("failures"), F.max("at").alias("last_at"), F.max_by("outcome", "at").alias("last_outcome")
    )
    return out.select(
        "stream_id", "failures", "last_at", (F.col("last_at") + F.expr(period)).alias("next_due"), F.when(F.col("last_outcome") == "failed", F.col("last_at") + F.expr(back_off)).alias("backoff_until")
    )


def stalest(watch: DataFrame, polls: DataFrame, now: Column, n: int) -> DataFrame:
    """The ``n`` watched streams that have waited longest: never polled first."""
    due = watch.join(polls, "stream_id", "left").where(
        F.col("enabled") & (F.col("next_due").isNull() | (F.col("next_due") <= now)) & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= now))
    )
    return due.orderBy(F.col("next_due").asc_nulls_first(), "stream_id").limit(n)
