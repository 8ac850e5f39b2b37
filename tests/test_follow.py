"""What follows a log: replacement by heads, several tables at once, generations, the log's state."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import wire
from ledgerfold.operators import chain, folds, keywords, observe, people
from ledgerfold.plans import readmodels
from ledgerfold.sources.store import LogStore
from ledgerfold.streaming import folds as stream_folds
from ledgerfold.streaming.models import Generations, ReadModels, Table


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def meeting(issue, speeches):
    told = [{"speechID": f"{issue}-{i}", "speechOrder": i, "speaker": s, "speakerYomi": y, "speakerGroup": g, "speakerPosition": p, "speech": x} for i, (s, y, g, p, x) in enumerate(speeches)]
    return json.dumps({"meetingRecord": [{"issueID": issue, "session": 3, "date": "2024-02-03", "speechRecord": told}]})


def log_of(spark, contents):
    made = [(s, n, t) for n, (s, t) in enumerate(contents, 1)]
    df = spark.createDataFrame(made, "stream_id string, seq long, text string").withColumn("content_hash", F.sha2("text", 256)).withColumn("stream_seq", F.col("seq"))
    return df.select("stream_id", "seq", "stream_seq", "content_hash"), df.where("text is not null").select("content_hash", F.col("text").cast("binary").alias("payload")).dropDuplicates(["content_hash"])


VOTE = "記名投票を行います。投票総数三、賛成二、反対一。賛成者 木村君、森君 反対者 林君 以上"
MEETINGS = [
    ("kokkai:A", meeting("A", [("木村　一", "きむら", "新緑", "委員長", "開会"), ("木村 一", "きむら", "新緑", "", VOTE)])),
    ("kokkai:B", meeting("B", [("森", "もり", "青空", "理事", "x")])),
    ("other:1", "ignored"),
    ("kokkai:A", meeting("A", [])),
    ("kokkai:B", meeting("B", [("森", "もり", "青空", "", "x"), ("森君", "もり", "青空", "幹事", "y")])),
    ("kokkai:B", None),
    ("kokkai:C", meeting("C", [("木村一君", "きむら", "", "", VOTE)])),
]


def test_a_meeting_without_speeches_any_more_has_none(spark):
    events, blobs = log_of(spark, MEETINGS)
    first = readmodels.minutes(events.where("seq <= 3"), blobs)
    assert rows(first["speech"], "speech_id") == [("A-0",), ("A-1",), ("B-0",)] and first["vote"].count() == 3
    now = readmodels.minutes(events, blobs)
    assert rows(now["speech"], "speech_id") == [("B-0",), ("B-1",), ("C-0",)]
    assert rows(now["meeting"], "issue_id", "seq") == [("A", 4), ("B", 5), ("C", 7)]
    assert rows(now["vote_event"], "vote_event_id") == [("C#1",)] and now["vote"].where("stream_id = 'kokkai:A'").count() == 0
    people_now = {r.name: (r.first_seq, r.last_seq) for r in now["person"].collect()}
    assert people_now == {"木村一君": (1, 7), "森": (2, 5)}  # the first spelling of the latest meeting
    members = {r.person_id: (r.role, r.first_seq, r.last_seq) for r in now["membership"].collect()}
    assert sorted(members.values(), key=str) == [("委員長", 1, 1), (None, 2, 5)]
    assert {r.classification for r in now["organization"].collect()} == {people.PARLIAMENTARY_GROUP}


@pytest.mark.parametrize("cuts", [[(1, 7)], [(1, 2), (3, 3), (4, 5), (6, 7)], [(1, 3), (4, 7), (2, 4)]])
def test_streamed_minutes_equal_the_batch_model(spark, tmp_path, cuts):
    """Batches in order, a batch of another source, and one that comes again late."""
    events, blobs = log_of(spark, MEETINGS)
    models = readmodels.streamed(spark, f"file://{tmp_path}/m", "minutes", lambda: blobs, buckets=4)
    assert models.read("speech") is None and models.offset() == 0
    for n, (low, high) in enumerate(cuts):
        models.apply(events.where(F.col("seq").between(low, high)), n)
        assert models.offset() == max(h for _, h in cuts[: n + 1])
    whole = readmodels.minutes(events, blobs)
    for name in readmodels.STREAMED["minutes"]:
        columns = whole[name].columns
        assert rows(models.read(name), *columns) == rows(whole[name], *columns), name
    assert not list(tmp_path.glob("m/scratch-*"))


def test_tables_become_visible_together(spark, tmp_path):
    """A batch that fails after it wrote a table shows nothing; it can come again."""
    log = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "seq long, k string, v long")
    broken = []

    def derive(batch, folder):
        bad = F.raise_error(F.lit("no")) if broken else F.col("v")
        return {"one": batch, "two": batch.select("seq", "k", bad.cast("long").alias("w"))}

    make = lambda: ReadModels(spark, f"file://{tmp_path}/m", {"one": Table("rows", ("k",)), "two": Table("rows", ("k",))}, derive, buckets=4)
    models = make()
    models.apply(log.where("seq = 1"), 0)
    broken.append(1)
    with pytest.raises(Exception, match="no"):
        models.apply(log.where("seq > 1"), 1)
    assert models.version() == 0 and rows(models.read("one"), "k", "v") == [("a", 1)]
    broken.clear()
    make().apply(log.where("seq > 1"), 1)
    assert rows(models.read("one"), "k", "v") == [("a", 2), ("b", 3)] == rows(models.read("two"), "k", "w")
    assert rows(models.read("one", 0), "k", "v") == [("a", 1)]


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    log = spark.createDataFrame([(i, f"k{i}") for i in range(40)], "seq long, k string")
    stream_folds.Fold(spark, f"file://{tmp_path}/m", "k", buckets=4).apply(log, 0)
    other = stream_folds.Fold(spark, f"file://{tmp_path}/m", "k", buckets=8)
    for act in (lambda: other.apply(log, 1), other.read):
        with pytest.raises(ValueError, match="4 buckets"):
            act()


def test_an_emptied_parent_has_no_children(spark, tmp_path):
    events = spark.createDataFrame([(1, "p", ["x", "y"]), (2, "q", ["z"]), (3, "p", []), (4, "q", ["z", "w"]), (5, "r", [])], "seq long, parent string, own array<string>")
    derive = lambda b: b.select("parent", "seq", F.explode("own").alias("c"))
    for cuts in ([1, 2, 3, 4, 5], [5], [2, 5]):
        fold = stream_folds.Fold(spark, f"file://{tmp_path}/m{len(cuts)}", "parent", derive=derive, children=True, buckets=4, heads=lambda b: b)
        low = 0
        for high in cuts:
            for _ in range(2):  # comes again
                fold.apply(events.where(F.col("seq").between(low + 1, high)), high)
            low = high
        fold.apply(events.where("seq = 2"), 9)  # late
        assert rows(fold.read(), "parent", "c") == [("q", "w"), ("q", "z")]


def test_pages_one_after_the_other(spark):
    """A page takes a person over and drops them: they are gone, though an older page lists them."""
    pages = [("p1", ["a", "b"]), ("p2", ["b", "c"]), ("p3", ["c"]), ("p2", ["d"]), ("p3", []), ("p1", ["a", "d"])]
    seats, log = {}, []
    for seq, (page, people_of) in enumerate(pages, 1):
        seats = {k: v for k, v in seats.items() if v[0] != page} | {k: (page, seq) for k in people_of}
        log += [(seq, page, k) for k in people_of]
    listed = spark.createDataFrame(log, "seq long, page string, k string")
    heads = folds.heads(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages, 1)], "seq long, page string"), "page")
    assert rows(folds.last_writer(listed, "page", "k", heads), "k", "page", "seq") == sorted((k, *v) for k, v in seats.items())
    assert {r.k for r in folds.by_page(listed, "page", "k", heads=heads).collect()} == {"a", "d"}


def test_scopes_that_are_empty_now(spark):
    stored = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "producer string, v int")
    scope = spark.createDataFrame([("p",), ("q",)], "producer string")
    assert rows(folds.replaced_scope(stored, stored.limit(0), "producer", scope)) == [("r", 3)]
    assert rows(folds.replaced_scope(stored, spark.createDataFrame([("q", 9)], stored.schema), F.col("producer") < "r")) == [("q", 9), ("r", 3)]


def test_ordered_fingerprint(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", None if i % 5 == 0 else i) for i in range(700)], "a long, b string, c long")
    mark = folds.ordered_fingerprint(df, ["a"], 64)
    assert mark == folds.ordered_fingerprint(df.repartition(7).select("c", "b", "a"), ["a"], 64) and len(mark) == 64
    others = [df.where("a <> 5"), df.withColumn("c", F.coalesce("c", F.lit(0))), df.union(df.where("a = 3")), df.withColumn("a", -F.col("a"))]
    assert len({mark, *[folds.ordered_fingerprint(x, ["a"], 64) for x in others]}) == 5
    assert folds.ordered_fingerprint(df.limit(0), ["a"]) == ""


def test_readers_of_the_old_generation_are_not_disturbed(spark, tmp_path):
    log = spark.createDataFrame([(i, f"k{i % 9}", i * i) for i in range(1, 60)], "seq long, k string, v long")
    log.where("seq < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    make = lambda at: ReadModels(spark, at, {"t": Table("rows", ("k",))}, lambda b, _: {"t": b}, buckets=4)
    models = Generations(spark, f"file://{tmp_path}/g", make)
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    models.current().start(stream(), f"{tmp_path}/c0").awaitTermination()
    reader = models.current()
    held, seen, done = reader.read("t"), [], threading.Event()

    def watch():
        while not done.is_set():
            seen.append(rows(Generations(spark, f"file://{tmp_path}/g", make).current().read("t"), "k", "v"))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert models.replay(stream(), f"{tmp_path}/c1", {"t": ["k"]}) == {"t": True}
    finally:
        done.set()
        watcher.join()
    want = rows(folds.latest(log.where("seq < 30"), "k"), "k", "v")
    assert seen and all(s == want for s in seen) and rows(held, "k", "v") == want
    log.where("seq >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert models.replay(stream(), f"{tmp_path}/c2", {"t": ["k"]}) == {"t": False}  # the live one had not seen the rest
    assert rows(models.current().read("t"), "k", "v") == rows(folds.latest(log, "k"), "k", "v")
    assert rows(reader.read("t"), "k", "v") == want if reader.version() is not None else True


def observations(spark, made):
    df = spark.createDataFrame(made, "stream_id string, minute long, content string")
    return df.select(
        F.format_string("e-%s-%05d", "stream_id", "minute").alias("event_id"), "stream_id", F.lit("s").alias("source"), F.lit("v").alias("fetcher_version"), F.timestamp_seconds(F.col("minute") * 60).alias("observed_at"),
        F.lit(None).cast("timestamp").alias("source_published_at"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("binary").alias("payload"),
    )


def test_a_batch_reads_state_and_no_events(spark, tmp_path):
    """What a batch reads of the log does not grow with it; pages and single streams read few files."""
    store = LogStore(spark, f"file://{tmp_path}/log", buckets=4)
    files = lambda df: 0 if df is None else len({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    size = lambda name: sum(f.stat().st_size for f in tmp_path.glob(f"log/state/v*/{name}/**/*.parquet"))
    sizes, n = [], 8
    for i in range(n):
        batch = observations(spark, [(f"s{k}", 10 * i + k, f"{k} {i}") for k in range(3)] + ([("once", 10 * i + 5, "y")] if i == 2 else []))
        store.append(batch, i)
        assert files(store.state.near("tail", batch)) <= 4
        sizes.append(size("tail"))
    assert sizes[-1] < 1.5 * sizes[3]  # two versions of one row a stream
    events = store.read("event")
    assert events.count() == 3 * n + 1 and files(events) == n
    newest = store.recent(4)
    assert [r.seq for r in newest.collect()] == [3 * n + 1 - i for i in range(4)] and files(newest) == 2
    older = store.recent(3, before=8)
    assert [r.seq for r in older.collect()] == [7, 6, 5] and files(older) <= 3
    assert [r.stream_id for r in store.recent(5, where=F.col("stream_id") == "once").collect()] == ["once"]
    assert store.recent(5, before=1).count() == 0
    one = store.stream_events("once")
    assert [r.stream_id for r in one.collect()] == ["once"] and files(one) == 1
    assert store.stream_events("s1").count() == n and store.stream_events("none") is None
    assert LogStore(spark, f"file://{tmp_path}/none").recent(3) is None


LAW = '<Law><LawBody><LawTitle>t</LawTitle><MainProvision><Article Num="1"><Paragraph Num="1"><ParagraphSentence><Sentence>{0}</Sentence></ParagraphSentence></Paragraph></Article></MainProvision></LawBody></Law>'


def test_changes_batch_by_batch_equal_the_full_run(spark, tmp_path):
    """A text is parsed once in its life; a law that goes and comes back differs from its last content."""
    texts = [("L", "a"), ("M", "a"), ("L", "b"), ("L", None), ("M", "c"), ("L", "a"), ("N", "b"), ("L", "a"), ("N", "a")]
    events, blobs = log_of(spark, [(f"egov-law:{s}", t and LAW.format(t)) for s, t in texts])
    follow = readmodels.Changes(spark, f"file://{tmp_path}/c", lambda: blobs, buckets=4)
    asked = []
    inner = follow.snapshots
    follow = readmodels.Changes(spark, follow.path, lambda: (asked.append(1), inner())[1], buckets=4)
    for n, (low, high) in enumerate([(1, 2), (3, 3), (4, 6), (4, 6), (7, 9)]):
        follow.apply(events.where(F.col("seq").between(low, high)), n)
    want = readmodels.changes(events, blobs)
    columns = ["change_id", "stream_id", "classification", "class_confidence", "node_changes"]
    assert rows(follow.read(), *columns) == rows(want, *columns) and want.count() == 4
    nodes = follow.models.read("node")
    assert nodes.select("content_hash").distinct().count() == 3 and nodes.count() == nodes.dropDuplicates(["content_hash", "eid"]).count()


def test_revisions_with_a_stored_tail(spark):
    events, _ = log_of(spark, [("s", "1"), ("s", "2"), ("t", "1"), ("s", None), ("s", "2"), ("s", "3"), ("t", "4")])
    whole = rows(observe.revisions(events), "seq", "earlier")
    for cut in range(1, 7):
        old = events.where(F.col("seq") <= cut)
        tail = folds.latest(old.where("content_hash is not null").select("stream_id", "seq", F.col("content_hash").alias("last_content")), "stream_id")
        later = observe.revisions(events.where(F.col("seq") > cut), tail=tail)
        assert rows(observe.revisions(old).select("seq", "earlier").union(later.select("seq", "earlier"))) == whole


def test_log_scan_in_batches(spark):
    events, blobs = log_of(spark, [(f"a:{i}", str(i)) for i in range(6)])
    got = readmodels.log_scan(events, blobs, after=2, prefix="a:", limit=3)
    assert rows(got, "seq") == [(3,), (4,), (5,)] and got.columns[-1] == "payload"


def test_payloads_are_unpacked_once(spark):
    events, blobs = log_of(spark, MEETINGS)
    for name in ("meeting", "speech", "vote"):
        plan = readmodels.minutes(events, blobs)[name]._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan, name  # read from what was decoded


def test_verdicts_of_segments(spark):
    """A wrong root, a changed row, a row that is gone; a later audit reads new segments only."""
    facts = [(f"e{i}", f"s{i % 3}", i, i, "observed", "x", "v", f"2024-01-01 00:00:{i % 60:02d}", f"h{i}") for i in range(1, 41)]
    df = spark.createDataFrame(facts, "event_id string, stream_id string, stream_seq long, seq long, type string, source string, fetcher_version string, at string, content_hash string")
    log = chain.append(df.select("event_id", "stream_id", "stream_seq", "seq", "type", "source", "fetcher_version", F.to_timestamp("at").alias("observed_at"), F.lit(None).cast("timestamp").alias("source_published_at"), "content_hash", F.lit(None).cast("string").alias("prev_content_hash"), F.lit("all").alias("all")), "all").cache()
    marks = log.where("seq % 10 = 0 and seq < 40").select(F.col("seq").alias("through_seq"), F.col("log_hash").alias("root_hash"))
    shown = lambda x: {r.through_seq: (r.n, r.bad_hashes, r.bad_links, r.root_ok, r.joins_ok, r.ok) for r in x.collect()}
    good = (10, 0, 0, True, True, True)
    first = chain.segment_verdicts(log, marks)
    assert shown(first) == {10: good, 20: good, 30: good, None: good}
    wrong = marks.withColumn("root_hash", F.when(F.col("through_seq") == 20, F.sha2("root_hash", 256)).otherwise(F.col("root_hash")))
    assert shown(chain.segment_verdicts(log, wrong)) == {10: good, 20: (10, 0, 0, False, True, False), 30: (10, 0, 0, True, False, False), None: good}
    old = log.withColumn("content_hash", F.when(F.col("seq") == 5, "other").otherwise(F.col("content_hash")))
    assert shown(chain.segment_verdicts(old, marks))[10] == (10, 1, 0, True, True, False)
    gone = shown(chain.segment_verdicts(log.where("seq <> 20"), marks))
    assert gone[20] == (9, 0, 0, False, True, False) and gone[30] == (10, 0, 1, True, True, False)
    stored = first.where("through_seq <= 20")
    again = chain.segment_verdicts(old, marks, stored)  # what is audited is not read again
    assert shown(again) == {30: good, None: good}
    assert shown(chain.segment_verdicts(log, wrong, chain.segment_verdicts(log, wrong).where("through_seq <= 20")))[20] == (10, 0, 0, False, True, False)
    assert chain.segment_verdicts(log.limit(0), marks.limit(0)).count() == 0


def test_keyword_index_against_every_row(spark):
    texts = [(f"s{i}", t, c) for i, (t, c) in enumerate([("Ärzte 100%", None), ("100 percent", "x"), ("", ""), (None, "法律_改正"), ("aaab", "baaa"), ("AAB", "日本"), ("x" * 50, "é")])]
    df = spark.createDataFrame(texts, "key string, title string, category string")
    postings = keywords.index(df, "key", ["title", "category"]).cache()
    for word in ("100%", "100", "a", "AA", "aaa", "aaab", "abab", "ärz", "律_", "日本", "_", "x" * 20, "zz", " 100 ", "é"):
        want = {k for k, *own in texts if any(word.strip().lower() in (x or "").lower() for x in own)}
        got = keywords.matches(lambda streams: df.join(streams, "key", "left_semi"), postings, "key", ["title", "category"], word)
        assert {r.key for r in got.collect()} == want, word
