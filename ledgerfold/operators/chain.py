"""Hash chains over the log: append, check, checkpoints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import checkpoint_body
from ..functions.wire import GENESIS, chained, facts_prefix, log_hash, verdict_prefix

ALGORITHM = "proto-linked-v1"


def append(facts: DataFrame, chain_key: str = "source", heads: DataFrame | None = None, prefix: Column | None = None) -> DataFrame:
    """Adds ``log_prev_hash`` and ``log_hash`` in ``seq`` order within each chain.

    All bytes but the previous hash are made beforehand, in parallel. Rows are sorted
    by chain and seq and pass in Arrow batches; what is left in order is one sha-256 a
    row, and the last hash is all that is kept. ``heads``: chain_key, log_hash of what
    is stored. One constant chain key gives a single chain for the whole log; large
    logs take a chain for each source or stream. ``prefix``: hex of the facts, those of
    observations unless others are given.
    """
    rows = facts.withColumn("_k", F.col(chain_key)).withColumn("_prefix", F.unhex(facts_prefix() if prefix is None else prefix))
    if heads is not None:
        rows = rows.join(heads.select(F.col(chain_key).alias("_of"), F.col("log_hash").alias("_head")), F.col("_k") == F.col("_of"), "left").drop("_of")
    names, known = facts.columns, heads is not None

    def link(batches):
        chain, last, begun = None, GENESIS, False
        for b in batches:
            before, own = [], []
            for i, (key, prefix) in enumerate(zip(b.column("_k").to_pylist(), b.column("_prefix").to_pylist(), strict=True)):
                if not begun or key != chain:
                    chain, last, begun = key, known and b.column("_head")[i].as_py() or GENESIS, True
                before.append(last)
                last = hashlib.sha256(prefix + b"\x5a\x40" + last.encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(before, pa.string()), pa.array(own, pa.string())], [*names, "log_prev_hash", "log_hash"])

    schema = facts.select("*", F.lit("").alias("log_prev_hash"), F.lit("").alias("log_hash")).schema
    return rows.repartition("_k").sortWithinPartitions("_k", "seq").mapInArrow(link, schema)


def recomputed(events: DataFrame) -> DataFrame:
    """Adds ``hash_ok``; every row on its own, no shuffle."""
    return events.withColumn("hash_ok", F.col("log_hash") == log_hash())


def linkage(events: DataFrame) -> DataFrame:
    """Violations of a single chain: ``seq, problem`` (gap, broken link, bad genesis).
    A self-join on ``seq - 1``, not a window over the whole log."""
    before = events.select((F.col("seq") + 1).alias("of"), F.col("log_hash").alias("due"))
    first = events.agg(F.min("seq").alias("first"))
    joined = events.select("seq", "log_prev_hash").join(before, F.col("seq") == F.col("of"), "left").join(F.broadcast(first))  # one row
    problem = (
        F.when((F.col("seq") == F.col("first")) & (F.col("log_prev_hash") != GENESIS), "genesis")
        .when((F.col("seq") != F.col("first")) & F.col("due").isNull(), "gap")
        .when(F.col("due") != F.col("log_prev_hash"), "link")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("seq", "problem")


def content_chain(events: DataFrame) -> DataFrame:
    """Adds ``content_ok``: the stored previous content is the last one before; null
    for events without content."""
    before = Window.partitionBy("stream_id").orderBy("stream_seq").rowsBetween(Window.unboundedPreceding, -1)
    due = F.last("content_hash", ignorenulls=True).over(before)
    return events.withColumn("content_ok", F.when(F.col("content_hash").isNotNull(), F.coalesce("prev_content_hash", F.lit("")) == F.coalesce(due, F.lit(""))))


def covering(spans: DataFrame, checkpoints: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Adds ``covered_by`` to rows with ``max_seq``: the first checkpoint at or after
    it, null if there is none.

    Seq is cut in slots of ``width``. Within its slot, a row and the checkpoints
    meet in one ordered window; else it takes the first checkpoint of a later slot,
    which a prefix over the slots (a row for each) gives. No range join. Both windows
    run from high to low, so that their frames grow row by row: a frame that reaches
    on to the end is summed up anew for each row, which is quadratic in the slot.
    """
    named = spans.withColumn("_row", F.struct("*")).select("_row", F.col("max_seq").alias("_at"), F.lit(None).cast("long").alias("_mark"))
    marks = checkpoints.select(F.lit(None).cast(named.schema["_row"].dataType).alias("_row"), F.col("through_seq").alias("_at"), F.col("through_seq").alias("_mark"))
    laid = named.union(marks).withColumn("_slot", F.floor(F.col("_at") / width))
    onward = Window.partitionBy("_slot").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    slots = laid.groupBy("_slot").agg(F.min("_mark").alias("_low"))
    later = slots.select(F.col("_slot").alias("_s"), F.min("_low").over(Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    found = laid.withColumn("_own", F.min("_mark").over(onward)).where("_row is not null").join(later, F.col("_slot") == F.col("_s"))
    return found.select("_row.*", F.coalesce("_own", "_later").alias("covered_by"))


def stream_report(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per stream: all hashes hold, the content chain holds, the covering checkpoint."""
    checked = content_chain(recomputed(events))
    per = checked.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("events"), F.bool_and("hash_ok").alias("hashes_ok"), F.coalesce(F.bool_and("content_ok"), F.lit(True)).alias("content_ok"), F.max("seq").alias("max_seq")
    )
    return covering(per, checkpoints)


def next_checkpoint(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The checkpoint to write, or no row: none on an empty log or where the head is covered."""
    head = events.agg(F.max("seq").alias("through_seq"), F.count(F.lit(1)).alias("tree_size"), F.max_by("log_hash", "seq").alias("root_hash"))
    done = checkpoints.agg(F.max("through_seq").alias("done"))
    new = head.join(F.broadcast(done)).where("through_seq is not null and (done is null or through_seq > done)").drop("done")  # one row each
    return new.withColumn("alg_version", F.lit(ALGORITHM))


def segment_audit(events: DataFrame, through_seq: int) -> DataFrame:
    """Violations after a checkpoint only: hashes and links of the segment, whose
    first row must link to the checkpoint's own event."""
    part = events.where(F.col("seq") >= through_seq)
    bad = recomputed(part.where(F.col("seq") > through_seq)).where(~F.col("hash_ok")).select("seq", F.lit("hash").alias("problem"))
    return bad.union(linkage(part).where((F.col("problem") != "genesis") & (F.col("seq") > through_seq)))


def segment_verdicts(events: DataFrame, checkpoints: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """A row for each segment between checkpoints (through_seq; null for what no
    checkpoint covers yet): n, bad_hashes, bad_links, root_ok (the log's hash at
    through_seq is the checkpoint's root), joins_ok (the segment's first row links to
    the root before it), ok.

    A segment's verdict needs its own rows and the two checkpoints around it, so all
    segments are checked side by side. ``audited`` (through_seq, ok): verdicts that are
    stored; only what follows the last of them, up to the first that is not ok, is read.
    """
    done = 0
    if audited is not None:
        bad = audited.where("not ok and through_seq is not null").agg(F.min("through_seq")).first()[0]
        good = audited.where("ok and through_seq is not null")
        done = (good if bad is None else good.where(F.col("through_seq") < bad)).agg(F.max("through_seq")).first()[0] or 0
    own = events.where(F.col("seq") >= done) if done else events
    rows = recomputed(own).select("seq", "log_prev_hash", "log_hash", "hash_ok")
    before = rows.select((F.col("seq") + 1).alias("of"), F.col("log_hash").alias("due"))
    first = events.agg(F.min("seq").alias("first"))  # one row, from the files' own statistics
    linked = rows.where(F.col("seq") > done).join(before, F.col("seq") == F.col("of"), "left").join(F.broadcast(first))
    link_ok = F.when(F.col("seq") == F.col("first"), F.col("log_prev_hash") == GENESIS).otherwise(F.coalesce(F.col("due") == F.col("log_prev_hash"), F.lit(False)))
    marks = checkpoints.where(F.col("through_seq") >= done)
    laid = covering(linked.select("seq", F.col("seq").alias("max_seq"), "log_prev_hash", "log_hash", "hash_ok", link_ok.alias("link_ok")), marks)
    per = laid.groupBy(F.col("covered_by").alias("through_seq")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("hash_ok")).alias("bad_hashes"), F.count_if(~F.col("link_ok")).alias("bad_links"),
        F.max("seq").alias("last"), F.max_by("log_hash", "seq").alias("root"), F.min_by("log_prev_hash", "seq").alias("joins"),
    )
    ordered = Window.orderBy("through_seq")
    due = marks.select("through_seq", F.col("root_hash"), F.lag("root_hash").over(ordered).alias("before"))  # a row a checkpoint
    newest = marks.agg(F.max_by("root_hash", "through_seq").alias("newest"))  # one row
    known = per.join(due.where(F.col("through_seq") > done), "through_seq", "full").join(F.broadcast(newest))
    root_ok = F.when(F.col("through_seq").isNull(), F.lit(True)).otherwise(F.coalesce((F.col("last") == F.col("through_seq")) & (F.col("root") == F.col("root_hash")), F.lit(False)))
    link_to = F.when(F.col("through_seq").isNull(), F.coalesce("newest", F.lit(GENESIS))).otherwise(F.coalesce("before", F.lit(GENESIS)))
    out = known.select("through_seq", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bad_hashes", "bad_links")], root_ok.alias("root_ok"), F.coalesce(F.col("joins") == link_to, F.lit(False)).alias("joins_ok"))
    return out.withColumn("ok", (F.col("bad_hashes") == 0) & (F.col("bad_links") == 0) & F.col("root_ok") & F.col("joins_ok"))


def exported(events: DataFrame, checkpoints: DataFrame, stream: str) -> DataFrame:
    """All events of a stream in order, with the checkpoint that covers its last."""
    own = events.where(F.col("stream_id") == stream)
    span = covering(own.groupBy("stream_id").agg(F.max("seq").alias("max_seq")), checkpoints).select(F.col("stream_id").alias("_of"), "covered_by")
    return own.join(span, F.col("stream_id") == F.col("_of")).drop("_of").orderBy("stream_seq")


def checkpoint_feed(checkpoints: DataFrame, limit: int = 0, origin: str = "ledgerfold/log") -> DataFrame:
    """The newest checkpoints (default and bound 100 and 500), with the text that is signed elsewhere."""
    n = limit if 0 < limit <= 500 else 100
    return checkpoints.orderBy(F.desc("through_seq")).limit(n).withColumn("body", checkpoint_body(F.lit(origin), F.col("tree_size"), F.col("root_hash")))


def verdict_audit(verdicts: DataFrame) -> DataFrame:
    """Violations of a log of review verdicts, a chain of its own by the same rules:
    ``seq, problem`` (hash, gap, link, genesis)."""
    bad = verdicts.where(F.col("log_hash") != chained(verdict_prefix())).select("seq", F.lit("hash").alias("problem"))
    return bad.union(linkage(verdicts))


def append_verdicts(verdicts: DataFrame, chain_key: str, heads: DataFrame | None = None) -> DataFrame:
    """Verdicts (event_id, type, observation_seq, actor, decided_at, payload as canonical
    JSON, seq) with their hashes."""
    return append(verdicts, chain_key, heads, verdict_prefix())


def masthead(watch: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row: watched resources and the newest checkpoint."""
    count = watch.agg(F.count_if("enabled").cast("long").alias("watched"))
    newest = checkpoints.agg(F.max("through_seq").alias("through_seq"), F.max_by("root_hash", "through_seq").alias("root_hash"))
    return count.crossJoin(newest)  # one row each
