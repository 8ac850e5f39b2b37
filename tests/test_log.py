import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.functions.wire import GENESIS
from ledgerfold.operators import chain, observe
from ledgerfold.streaming import folds as stream_folds


def sequential(contents):
    """The same decisions one by one."""
    there, last, out = False, None, []
    for i, c in enumerate(contents):
        kind = "vanished" if c is None and there else None if c is None else "observed" if last is None else "restored" if not there else "changed" if c != last else None
        if kind:
            out.append((i, kind, last))
        there, last = c is not None, c or last
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from([None, "A", "B"]), max_size=12), min_size=1, max_size=12))
def test_transitions_equal_the_sequential_rule(spark, streams):
    rows = [(f"s{k}", i, c) for k, s in enumerate(streams) for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "stream_id string, i int, c string")
    got = sorted((r.stream_id, r.i, r.type, r.prev_content_hash) for r in observe.transitions(df, "stream_id", ["i"], "c").collect())
    assert got == sorted((f"s{k}", *e) for k, s in enumerate(streams) for e in sequential(s))


def test_absence_resolution(spark):
    fetches = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, False), ("d", None, None), ("e", True, True)], "local_key string, present boolean, content_unavailable boolean")
    registry = spark.createDataFrame([("a",), ("b",), ("e",)], "local_key string")
    got = {r.local_key: r.status for r in observe.usable(fetches, registry).collect()}
    assert got == {"a": "present", "b": "pending", "c": "absent", "d": "error", "e": "pending"}


def facts(spark, n=60):
    return spark.range(1, n + 1).select(
        F.format_string("e%d", "id").alias("event_id"), F.concat(F.lit("s:"), (F.col("id") % 3).cast("string")).alias("stream_id"), (F.floor((F.col("id") - 1) / 3) + 1).alias("stream_seq"), F.col("id").alias("seq"),
        F.when(F.col("id") <= 3, "observed").otherwise("changed").alias("type"), F.lit("s").alias("source"), F.lit("v").alias("fetcher_version"), F.timestamp_seconds(F.col("id") * 60).alias("observed_at"), F.lit(None).cast("timestamp").alias("source_published_at"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.when(F.col("id") > 3, F.sha2((F.col("id") - 3).cast("string"), 256)).alias("prev_content_hash"),
    )


def test_chain_and_tampering(spark):
    log = chain.append(facts(spark)).cache()
    assert chain.recomputed(log).where("not hash_ok").count() == 0 and chain.linkage(log).count() == 0
    assert log.orderBy("seq").first().log_prev_hash == GENESIS
    fact = log.withColumn("fetcher_version", F.when(F.col("seq") == 7, "x").otherwise(F.col("fetcher_version")))
    assert [r.seq for r in chain.recomputed(fact).where("not hash_ok").collect()] == [7]
    stored = log.withColumn("log_hash", F.when(F.col("seq") == 7, "0").otherwise(F.col("log_hash")))
    assert [tuple(r) for r in chain.linkage(stored).collect()] == [(8, "link")]
    assert [tuple(r) for r in chain.linkage(log.where("seq <> 9")).collect()] == [(10, "gap")]
    bad = log.withColumn("log_prev_hash", F.when(F.col("seq") == 1, "0" * 63 + "1").otherwise(F.col("log_prev_hash")))
    assert [tuple(r) for r in chain.linkage(bad).collect()] == [(1, "genesis")]
    marks = spark.createDataFrame([(20, 20, "00"), (59, 59, "00")], "through_seq long, tree_size long, root_hash string")
    report = {r.stream_id: (r.hashes_ok, r.content_ok, r.covered_by) for r in chain.stream_report(log, marks).collect()}
    assert report == {"s:0": (True, True, None), "s:1": (True, True, 59), "s:2": (True, True, 59)}
    assert chain.segment_audit(fact, 20).count() == 0 and chain.segment_audit(fact, 5).select("seq").distinct().count() == 1
    new = chain.next_checkpoint(log, marks).collect()
    assert len(new) == 1 and new[0].through_seq == 60 and chain.next_checkpoint(log.where("seq <= 59"), marks).count() == 0
    assert chain.next_checkpoint(log.limit(0), marks.limit(0)).count() == 0
    assert chain.checkpoint_feed(marks, 1).first().body.startswith("ledgerfold/log\n59\n")
    assert [r.stream_seq for r in chain.exported(log, marks, "s:1").collect()] == list(range(1, 21))


def test_chain_continues_from_heads(spark):
    whole = chain.append(facts(spark))
    first = chain.append(facts(spark).where("seq <= 30"))
    heads = first.groupBy("source").agg(F.max_by("log_hash", "seq").alias("log_hash"))
    rest = chain.append(facts(spark).where("seq > 30"), heads=heads)
    a = {r.seq: r.log_hash for r in whole.select("seq", "log_hash").collect()}
    assert {r.seq: r.log_hash for r in first.union(rest).select("seq", "log_hash").collect()} == a


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{k}", i, i, rng.choice([None, "A", "B"])) for k in range(5) for i in range(30)]
    schema = "stream_id string, at long, event_id long, content_hash string"
    df = spark.createDataFrame(rows, schema)
    for part, low in enumerate((0, 15)):
        df.where((F.col("at") >= low) & (F.col("at") < low + 15)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        stream = stream_folds.transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(stream_folds.EVENT).parquet(str(tmp_path / "out")).select("stream_id", "event_id", "type").collect()))
    want = sorted(map(tuple, observe.transitions(df, "stream_id", ["at"], "content_hash").select("stream_id", "event_id", "type").collect()))
    assert got == want


def test_fold_is_idempotent_and_equals_replay(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    fold = stream_folds.Fold(spark, str(tmp_path / "model"), "k")
    assert fold.read() is None
    fold.apply(rows.where("seq < 50"), 0)
    fold.apply(rows.where("seq >= 50"), 1)
    fold.apply(rows.where("seq >= 50"), 1)
    rows.write.parquet(str(tmp_path / "log"))
    again = stream_folds.replay(spark, str(tmp_path / "log"), rows.schema, str(tmp_path / "model2"), "k", str(tmp_path / "cp"))
    assert sorted(map(tuple, fold.read().collect())) == sorted(map(tuple, again.collect())) and fold.version() == 1


def test_global_sequence_and_polls(spark):
    rows = spark.range(1, 51).select(F.timestamp_seconds(F.col("id") * 7000).alias("ts"), F.col("id").alias("i"))
    got = observe.global_sequence(rows, ["ts"], F.date_trunc("day", "ts"), 10).orderBy("i").collect()
    assert [r.seq for r in got] == list(range(11, 61))
    polls = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "failed"), ("b", 2, "pending")], "stream_id string, t long, outcome string")
    health = {r.stream_id: (r.failures, r.backoff_until is None) for r in observe.poll_health(polls.select("stream_id", F.timestamp_seconds("t").alias("at"), "outcome")).collect()}
    assert health == {"a": (2, False), "b": (1, True)}


def test_covering_checkpoints_of_long_logs(spark):
    """Slots with many rows: frames that are summed up anew for each row take minutes here."""
    n, every = 60_000, 7
    rows = spark.range(1, n + 1, numPartitions=4).select(F.col("id").alias("max_seq"))
    marks = spark.range(every, n + 1, every).select(F.col("id").alias("through_seq"))
    last = n // every * every
    due = F.when(F.col("max_seq") <= last, F.ceil(F.col("max_seq") / every) * every)
    for width in (1 << 20, 1 << 16, 1 << 4):
        began = time.time()
        found = chain.covering(rows, marks, width)
        assert found.count() == n and found.where(~F.col("covered_by").eqNullSafe(due)).count() == 0
        assert time.time() - began < 30
