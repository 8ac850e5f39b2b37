"""Logs as they are stored: fixed hashes, packed payloads, appending batch after batch."""

import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import wire
from ledgerfold.operators import chain, folds, observe
from ledgerfold.plans import driver_queries, fold_queries, lookups, readmodels
from ledgerfold.sources import lawtree, payloads
from ledgerfold.sources.store import LogStore

# Facts of six events and their hashes, as every reader of the log computes them.
STREAM, SOURCE, VERSION = "kokkai:100000000X00120260101", "kokkai", "kokkai-collector/0.1-test"
A, B, C, D = (
    "79c6d61344be00e74b64db50b5b9639bbfd2d845d2d686ec380526eb898a9d8a",
    "1303575f6f144a4c65bea20994202cce34ef994afdb2755c9311ebbda248f86d",
    "d5dacf9314bc32d497d7d163fe220a81a24fce8f5d5c1d55be55cf7e83d83262",
    "1b4b655e49ca4b03b08bacf0c6af83a5a315c32ee53c11abaebbc6ac281f41ea",
)
HASHES = [
    "419e928d483ff38dcef51a08d0a0241cad80f79fd060e7a0acbe82145a20d59d",
    "d2c426f0155c2a0496aeec358ad718946a263c4f13aee990af1f8007d2187a19",
    "c75283606fb4638306d9b6874dd105e50c0720213c147af3cacd1f43d05e35b5",
    "b2401269251cab13ed124e4f66903144d386a961cac5fe525a33759dac36a85e",
    "49d52327a3560dd544a842cf533f3a52026a5e72195bee13340568208e32a7e9",
    "ddb9b1b04c54f2c6902774c872fcf116caca875feca2ba078dfaaa9eda5defb4",
]
JANUARY = "2026-01-15T00:00:00Z"
FACTS = [
    (1, "observed", 9, JANUARY, A, None, wire.GENESIS),
    (2, "changed", 10, None, B, A, HASHES[0]),
    (3, "vanished", 11, None, None, B, HASHES[1]),
    (4, "restored", 12, JANUARY, C, B, HASHES[2]),
    (9007199254740993, "observed", 13, None, D, None, HASHES[2]),
    (0, None, 14, None, None, None, HASHES[2]),
]


def test_fixed_hashes(spark):
    rows = [(f"00000000-0000-7000-8000-10000000000{i}", STREAM, n, t, SOURCE, VERSION, f"2026-06-02T{h:02d}:00:00Z", p, c, b, last) for i, (n, t, h, p, c, b, last) in enumerate(FACTS)]
    names = "event_id string, stream_id string, stream_seq long, type string, source string, fetcher_version string, at string, published string, content_hash string, prev_content_hash string, log_prev_hash string"
    df = spark.createDataFrame(rows, names).withColumn("observed_at", F.col("at").cast("timestamp")).withColumn("source_published_at", F.col("published").cast("timestamp"))
    got = {r.event_id[-1]: r.h for r in df.select("event_id", wire.log_hash().alias("h")).collect()}
    assert [got[str(i)] for i in range(6)] == HASHES


def packed(text):
    return bytearray(gzip.compress(text.encode() if isinstance(text, str) else text))


LAW = '<Law><LawNum>1</LawNum><LawBody><LawTitle>法</LawTitle><MainProvision><Article Num="1"><Paragraph Num="1"><ParagraphSentence><Sentence>{0}</Sentence></ParagraphSentence></Paragraph></Article></MainProvision></LawBody></Law>'
MEETING = json.dumps({"meetingRecord": [{"issueID": "M", "session": 1, "date": "2021-11-09", "speechRecord": [{"speechID": "s", "speechOrder": 1, "speaker": "岸本君", "speech": "x"}]}]})
ROW = "<tr><td>岸本実君</td><td>きしもと</td><td>甲党</td><td>{0}</td><td>1</td></tr>"
PAGE = "<title>予算案：採決</title><h4>甲党（1名）</h4><tr><td>賛成</td><td></td><td>岸本</td></tr>"


@pytest.mark.parametrize("pack", [packed, lambda t: bytearray(t.encode())])
def test_models_read_what_is_stored(spark, pack):
    """All five models from UTF-8 payloads, gzip or plain, and one damaged payload among them."""
    contents = [("kokkai:M", MEETING), ("egov-law:L", LAW.format("旧")), ("egov-law:L", LAW.format("新")), ("giin-roster:1", ROW.format("栃木３")), ("sangiin-roster:1", ROW.format("東京").replace("岸本実", "佐藤花")), ("sangiin-vote:198-1109-v001", PAGE)]
    rows = [(i, s, i, f"h{i}", pack(t)) for i, (s, t) in enumerate(contents, 1)] + [(7, "kokkai:N", 1, "h7", bytearray(b"\x1f\x8b\x08broken")), (8, "sangiin-vote:x", 1, "h8", bytearray(b"\x1f\x8b"))]
    df = spark.createDataFrame(rows, "seq long, stream_id string, stream_seq long, content_hash string, payload binary")
    events, blobs = df.drop("payload"), df.select("content_hash", "payload")
    minutes = readmodels.minutes(events, blobs)
    assert minutes["meeting"].count() == 1 and minutes["speech"].first().text == "x" and minutes["person"].count() == 1
    assert [r.title for r in readmodels.laws(events, blobs)["legislative_work"].collect()] == ["法"]
    assert [(r.change_id, r.classification, r.class_confidence) for r in readmodels.changes(events, blobs).collect()] == [(3, "substantive", "high")]
    assert {(r.name_key, r.house, r.district_code) for r in readmodels.rosters(events, blobs).collect()} == {("岸本実", "representatives", "903"), ("佐藤花", "councillors", "13")}
    votes = readmodels.roll_calls(events, blobs)["vote"].collect()
    assert [(r.name_key, r.option, r.parliamentary_group) for r in votes] == [("岸本", "yes", "甲党")]


def test_text_of_payloads():
    assert payloads.decoded("栃木".encode("shift_jis"), "shift_jis") == payloads.decoded(gzip.compress("栃木".encode())) == "栃木"
    assert payloads.decoded(None) == payloads.decoded(b"\x1f\x8bx") == "" and payloads.unpacked(b"ab") == b"ab"


def test_law_texts_that_break_off():
    whole = LAW.format("x").encode()
    head, tree = lawtree.parse(whole)
    assert not tree.degraded and len(tree.rows) == 2
    for cut in (whole.replace(b"</MainProvision></LawBody></Law>", b""), whole[: whole.index(b"</Article>")], whole.replace(b"</Article>", b"</Artic>")):
        again, part = lawtree.parse(cut)
        assert part.degraded and again == head and [r[0] for r in part.rows] == ["art_1", "art_1__para_1"]
    outside = whole.replace(b"</Paragraph>", b'<Subitem1 Num="1"/></Paragraph>')
    assert lawtree.parse(outside)[1].degraded
    for none in (b"", b"no markup", b"<"):
        with pytest.raises(lawtree.ElementTree.ParseError):
            lawtree.parse(none)


def observations(spark, rows):
    df = spark.createDataFrame(rows, "stream_id string, minute long, content string")
    return df.select(
        F.concat_ws("-", F.lit("e"), "stream_id", F.col("minute").cast("string")).alias("event_id"), "stream_id", F.lit("s").alias("source"), F.lit("v").alias("fetcher_version"), F.timestamp_seconds(F.col("minute") * 60).alias("observed_at"),
        F.lit(None).cast("timestamp").alias("source_published_at"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("binary").alias("payload"),
    )


def test_log_store_appends_batches(spark, tmp_path):
    """Three batches equal one, a batch that comes again adds nothing, and the chain holds."""
    rows = [("a", 1, "x"), ("b", 2, "x"), ("a", 3, None), ("a", 5, "x"), ("b", 6, "y"), ("b", 7, "y"), ("c", 8, None), ("b", 71, None), ("c", 75, "z"), ("a", 76, "w"), ("b", 140, "y")]
    cuts = [(0, 4), (4, 70), (70, 200)]
    store, once = LogStore(spark, f"file://{tmp_path}/parts"), LogStore(spark, f"file://{tmp_path}/once")
    assert store.read("event") is None
    for i, (low, high) in enumerate(cuts):
        batch = observations(spark, [r for r in rows if low <= r[1] < high])
        for _ in range(2):
            store.append(batch, i)
    once.append(observations(spark, rows), 0)
    assert [sorted(map(str, s.read(t).collect())) for s in (store,) for t in ("event", "stream", "snapshot")] == [sorted(map(str, once.read(t).collect())) for t in ("event", "stream", "snapshot")]
    events = store.read("event")
    assert chain.recomputed(events).where("not hash_ok").count() == 0 and chain.linkage(events).count() == 0
    kinds = [(r.stream_id, r.stream_seq, r.type) for r in events.orderBy("seq").collect()]
    assert kinds == [("a", 1, "observed"), ("b", 1, "observed"), ("a", 2, "vanished"), ("a", 3, "restored"), ("b", 2, "changed"), ("b", 3, "vanished"), ("c", 1, "observed"), ("a", 4, "changed"), ("b", 4, "restored")]
    store.append(observations(spark, [("a", 300, "w"), ("c", 301, "z")]), 3)
    assert store.read("event").count() == len(kinds) and store.read("snapshot").count() == 4
    report = lookups.get_stream_verification(events, spark.createDataFrame([(9,)], "through_seq long"), "b").collect()
    assert len(report) == 4 and all(r.hash_ok and r.all_ok and r.covered_by == 9 for r in report)


def test_transitions_from_a_tail(spark):
    seen = spark.createDataFrame([("a", 1, None), ("b", 1, "A"), ("c", 1, None), ("d", 1, "A"), ("e", 1, "A")], "stream_id string, i int, c string")
    tail = spark.createDataFrame([("a", "changed", "A", 3), ("b", "vanished", "A", 4), ("c", "vanished", "A", 5), ("d", "observed", "A", 2)], "stream_id string, last_type string, last_content string, next_seq long")
    got = {r.stream_id: (r.type, r.prev_content_hash, r.stream_seq) for r in observe.transitions(seen, "stream_id", ["i"], "c", tail).collect()}
    assert got == {"a": ("vanished", "A", 3), "b": ("restored", "A", 4), "e": ("observed", None, 1)}


def test_verdicts_and_scopes(spark):
    rows = spark.range(1, 30).select(F.col("id").cast("string").alias("event_id"), F.lit("Correction").alias("type"), F.col("id").alias("observation_seq"), F.lit("x").alias("actor"), F.timestamp_seconds("id").alias("decided_at"), F.lit("{}").alias("payload"), F.col("id").alias("seq"), F.lit("v").alias("log"))
    log = chain.append_verdicts(rows, "log").cache()
    assert chain.verdict_audit(log).count() == 0
    bad = log.withColumn("payload", F.when(F.col("seq") == 4, "[]").otherwise(F.col("payload")))
    assert [tuple(r) for r in chain.verdict_audit(bad).collect()] == [(4, "hash")]
    stored = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3)], "producer string, v int")
    assert {tuple(r) for r in folds.replaced_scope(stored, spark.createDataFrame([("q", 9)], stored.schema), "producer").collect()} == {("p", 1), ("q", 9)}


def test_fold_of_children_rewrites_touched_buckets_only(spark, tmp_path):
    from ledgerfold.streaming import folds as stream_folds

    rows = spark.createDataFrame([(p, s, c) for s in range(1, 5) for p in range(40) if p % s == 0 for c in range(s)], "parent long, seq long, c int")
    fold = stream_folds.Fold(spark, f"file://{tmp_path}/m", "parent", children=True, buckets=16)
    for s in range(1, 5):
        fold.apply(rows.where(F.col("seq") == s), s)
    fold.apply(rows.where(F.col("seq") == 4), 4)
    want = folds.latest_children(rows, "parent")
    assert sorted(map(tuple, fold.read().collect())) == sorted(map(tuple, want.collect()))
    before = fold._folders(4)
    fold.apply(rows.where("parent = 3").withColumn("seq", F.lit(9).cast("long")), 5)
    after = fold._folders(5)
    assert sum(before[b] != after[b] for b in after) == 1 and fold.versions() == [4, 5]
    assert {r.seq for r in fold.read().where("parent = 3").collect()} == {9}
    fold.apply(rows.limit(0), 6)
    assert fold._folders(6) == after


def test_a_changed_root_is_not_a_changed_hash(spark, tmp_path):
    """The hash at a checkpoint is changed in the log, and its root as well: still two values."""
    rows = spark.range(1, 1601).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    names = ["through_seq", "n", "bad_hashes", "bad_links", "root_ok", "joins_ok", "ok"]
    got = fold_queries.audited_segments(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(driver_queries.ORACLES["audited_segments"]).project(", ".join(names)).fetchall())


def test_changes_send_nothing_whole_through_the_driver(spark):
    """Both sides of these joins grow with the log, however small the tables look."""
    rows = [(i, "egov-law:L", i, f"h{i}", packed(LAW.format(i))) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "seq long, stream_id string, stream_seq long, content_hash string, payload binary")
    found = readmodels.changes(df.drop("payload"), df.select("content_hash", "payload"))
    assert sorted(r.change_id for r in found.collect()) == [2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    tail = df.select("stream_id", F.col("content_hash").alias("last_content")).limit(1)
    for made in (observe.revisions(df, tail=tail), observe.new_only(df, "content_hash", df), folds.latest_children(df, "stream_id"), folds.overtaken(df, df, "stream_id")):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
