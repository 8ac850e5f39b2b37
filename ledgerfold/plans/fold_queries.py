"""Registered queries over what follows a log: replacement by heads, models as streams,
the stored log and its pages, differences batch by batch, replays."""

from __future__ import annotations

import gzip
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chain, diff, folds, observe
from ..sources import payloads
from ..sources.store import LogStore, shared_folder, written
from ..streaming import folds as stream_folds
from ..streaming.models import Generations, ReadModels, Table
from . import lookups, readmodels, timeline
from .driver_queries import _SHOWN, _TL, EVERY, _facts, _log, _observations, _sql, _t, _timeline, query
from .log_queries import _changed
from .text_queries import _bindings, _customers, _law_text, _log_of, _text

_LAST = "last as (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1)"


def _returned(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines with their customer: many orders have none."""
    return _t(spark, sf, "orders").join(_t(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query(f"with {_LAST} select o_custkey, o_orderkey, l_linenumber, l_partkey from last join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'")
def children_of_heads(spark, sf):
    """Returned lines of each customer's last order, in two batches; none where it has none."""
    lines, orders = _returned(spark, sf), _t(spark, sf, "orders")
    early = F.col("o_orderkey") % 3 != 0
    first = folds.heads(orders.where(early), "o_custkey", "o_orderkey")
    stored = folds.replaced_children(None, lines.where(early), "o_custkey", "o_orderkey", first)
    second = folds.heads(orders.where(~early), "o_custkey", "o_orderkey")
    whole = folds.merged(first, second, "o_custkey", "o_orderkey")
    return folds.replaced_children(folds.overtaken(stored, second, "o_custkey", "o_orderkey"), lines.where(~early), "o_custkey", "o_orderkey", whole)


@query("select o_custkey, o_orderkey, o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') union all select o_custkey, o_orderkey, o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0")
def scope_emptied(spark, sf):
    """Two producers write anew; the second one has nothing left."""
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    new = orders.where("o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0")
    producers = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return folds.replaced_scope(orders, new, "o_orderpriority", producers)


@query("select c_name, c_custkey from customer where c_name not like 'Customer#00000000%' union all select c_name || '+', c_custkey from customer where c_custkey % 5 = 0 and c_name like 'Customer#00000000%'")
def scope_of_prefix(spark, sf):
    """One producer's rows, known by the prefix of their streams, give way to what it found now."""
    rows = _t(spark, sf, "customer").select("c_name", "c_custkey")
    own = F.col("c_name").startswith("Customer#00000000")
    return folds.replaced_scope(rows, rows.where(own & (F.col("c_custkey") % 5 == 0)).withColumn("c_name", F.concat("c_name", F.lit("+"))), own)


_SEATS = """orders_of as (select o_orderkey, o_custkey % 40 as page from orders), last as (select page, max(o_orderkey) as seq from orders_of group by 1),
 rows_of as (select page, l_suppkey as k, o_orderkey as seq from orders_of join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R')"""


def _seats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages of seats as orders come, and each page's last order, with seats or without."""
    pages = _t(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("page"), F.col("o_orderkey").alias("seq"))
    rows = pages.join(_t(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("seq") == F.col("l_orderkey")).select("page", F.col("l_suppkey").alias("k"), "seq")
    return rows, folds.heads(pages, "page")


@query(f"with {_SEATS} select k, max(seq)::bigint as seq from rows_of join last using (page, seq) group by k")
def roster_emptied(spark, sf):
    """Seats on the pages as they are now; a page whose last version lists nobody has none."""
    rows, heads = _seats(spark, sf)
    return folds.by_page(rows, "page", "k", heads=heads).select("k", "seq")


@query(f"with {_SEATS}, own as (select k, max(seq) as seq from rows_of group by k) select k, own.seq::bigint as seq from own join rows_of r using (k, seq) join last on last.page = r.page and last.seq = own.seq group by 1, 2")
def roster_taken_over(spark, sf):
    """Pages one after the other: who was taken over by a page that dropped them is gone."""
    rows, heads = _seats(spark, sf)
    return folds.last_writer(rows, "page", "k", heads).select("k", "seq")


def _in_parts(spark: SparkSession, rows: DataFrame, path: str, parts: int) -> DataFrame:
    """A stream of ``rows`` in batches by seq, one file each."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):
        own = F.col("seq").between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1)
        rows.where(own).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _followed(spark: SparkSession, name: str, rows: DataFrame, parts: int = 3) -> ReadModels:
    """A read model after its log came in ``parts`` and the last one came twice.
    ``rows``: stream_id, seq, payload."""
    path = shared_folder(spark, name)
    events, snapshots = _log_of(rows)
    snapshots.write.parquet(f"{path}/snapshot")
    models = readmodels.streamed(spark, f"{path}/model", name, lambda: spark.read.parquet(f"{path}/snapshot"), buckets=8)
    models.start(_in_parts(spark, events, path, parts), f"{path}/checkpoint").awaitTermination()
    models.apply(spark.read.schema(events.schema).parquet(f"{path}/in").where(F.col("seq") > models.offset() - 50), models.version() + 1)
    return models


def _versions(rows: DataFrame, stream: Column, first: Column, second: Column) -> DataFrame:
    """Two snapshots of each row's stream; a null one was not taken."""
    k = F.col("k").cast("long")
    both = F.explode(F.array(F.struct((2 * k + 1).alias("seq"), first.alias("payload")), F.struct((2 * k + 1_000_001).alias("seq"), second.alias("payload"))))
    return rows.select(stream.alias("stream_id"), both.alias("v")).select("stream_id", "v.seq", "v.payload").where("payload is not null")


@query("""with c as (select conv_id, turn, coalesce(role, '') as role, case conv_id % 3 when 2 then 2 * conv_id + 1 else 2 * conv_id + 1000001 end::bigint as seq from conversations),
 s as (select * from c where conv_id % 3 = 2 or conv_id % 3 = 1 and turn % 2 = 0),
 p as (select 'p:' || substr(sha256(regexp_replace(role, '\\s+', '', 'g') || chr(10)), 1, 16) as id, conv_id, turn, 2 * conv_id + 1 as first, case when conv_id % 3 = 1 and turn % 2 = 0 then 2 * conv_id + 1000001 else 2 * conv_id + 1 end as last from c where trim(role) <> '')
 select 'speech' as kind, conv_id || '-' || turn as id, seq, seq as last_seq from s union all
 select 'person', id, min(first)::bigint, max(last)::bigint from p group by id union all
 select 'member', id || ' ' || (conv_id % 4), min(first)::bigint, max(last)::bigint from p group by id, conv_id % 4 union all
 select 'meeting', conv_id::varchar, seq, seq from (select conv_id, max(seq) as seq from c group by 1)""")
def stream_minutes(spark, sf):
    """Minutes as a stream: meetings whose second snapshot has fewer speeches, or none."""
    talk = _t(spark, sf, "conversations").withColumn("k", F.col("conv_id"))

    def held(rows: DataFrame, name: str) -> DataFrame:
        speech = F.struct(_text("=conv_id", "-", "=turn").alias("speechID"), F.col("turn").cast("int").alias("speechOrder"), F.col("role").alias("speaker"), F.lit("").alias("speakerYomi"), _text("g", F.col("conv_id") % 4).alias("speakerGroup"), F.lit("x").alias("speech"))
        return rows.groupBy("k").agg(F.collect_list(speech).alias(name))

    both = held(talk, "all").join(held(talk.where("conv_id % 3 = 1 and turn % 2 = 0"), "some"), "k", "left").withColumn("none", F.filter("all", lambda x: F.lit(False)))
    payload = lambda speeches: F.to_json(F.struct(F.array(F.struct(F.col("k").cast("string").alias("issueID"), speeches.alias("speechRecord"))).alias("meetingRecord")))
    second = F.when(F.col("k") % 3 == 2, None).otherwise(payload(F.coalesce("some", "none")))
    models = _followed(spark, "minutes", _versions(both, _text("kokkai:", "=k"), payload(F.col("all")), second))
    group = {f"o:{d}": str(i) for i, d in enumerate(spark.range(4).select(F.substring(F.sha2(F.concat(F.lit("g"), F.col("id").cast("string")), 256), 1, 16)).toPandas().iloc[:, 0])}
    named = F.create_map(*[F.lit(x) for pair in group.items() for x in pair])
    seq = F.col("seq")
    rows = [
        models.read("speech").select(F.lit("speech").alias("kind"), F.col("speech_id").alias("id"), seq, seq.alias("last_seq")),
        models.read("person").select(F.lit("person"), "person_id", "first_seq", "last_seq"),
        models.read("membership").select(F.lit("member"), F.concat_ws(" ", "person_id", named[F.col("org_id")]), "first_seq", "last_seq"),
        models.read("meeting").select(F.lit("meeting"), "issue_id", seq, seq),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("""select p_partkey::varchar as law_id, e.eid, case when p_partkey % 3 = 0 then 2 * p_partkey + 1 else 2 * p_partkey + 1000001 end::bigint as seq from part,
 lateral (select unnest(case p_partkey % 3 when 0 then ['art_1', 'art_2'] when 1 then ['art_1'] else []::varchar[] end) as eid) e""")
def stream_laws(spark, sf):
    """Laws as a stream: an article goes, or all of them."""
    article = lambda n: f'<Article Num="{n}"><ArticleTitle>{n}</ArticleTitle></Article>'
    law = lambda body: _text("<Law><LawNum>", "=k", "</LawNum><LawBody><LawTitle>", "=p_name", "</LawTitle><MainProvision>", body, "</MainProvision></LawBody></Law>")
    rows = _t(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    second = F.when(F.col("k") % 3 == 1, law(article(1))).when(F.col("k") % 3 == 2, law(""))
    models = _followed(spark, "laws", _versions(rows, _text("egov-law:", "=k"), law(article(1) + article(2)), second))
    return models.read("law_node").select("law_id", "eid", "seq")


@query("""select '議員' || c_custkey as name_key, ((c_custkey % 47 + 1) * 100 + 2)::varchar as district_code, case when c_custkey % 4 = 0 then 2 * c_custkey + 1 else 2 * (c_custkey + 1) + 1000001 end::bigint as seq from customer
 where c_custkey % 4 = 0 or c_custkey % 4 = 1 and exists (select 1 from customer n where n.c_custkey = customer.c_custkey + 1)""")
def stream_rosters(spark, sf):
    """Rosters as a stream. Of four pages in a row, the first stays as it is; the second
    one's person goes over to the third page; the third and the fourth have nobody left."""
    k = F.col("k").cast("long")
    name = lambda n: F.element_at(F.array(*map(F.lit, C.PREFECTURES)), (n % 47 + 1).cast("int"))
    seat = lambda n: F.concat(F.lit("<table><tr><td>議員"), n.cast("string"), F.lit("君</td><td></td><td>無所属</td><td>"), name(n), F.lit("2</td><td>1</td></tr></table>"))
    rows = _t(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    second = F.when(k % 4 == 2, seat(k - 1)).when(k % 4 == 1, F.lit("<p>その他</p>")).when(k % 4 == 3, F.lit("<table></table>"))
    models = _followed(spark, "rosters", _versions(rows, _text("giin-roster:", "=k"), seat(k), second))
    return models.read("seat").select("name_key", "district_code", "seq")


@query("""with v as (select c_custkey, c_custkey || '-0310-v002' as id from customer)
 select id as vote_event_id, 'https://www.sangiin.go.jp/japanese/touhyoulist/' || (c_custkey % 90 + 1) || '/' || id || '.htm' as url, case c_custkey % 3 when 0 then 2 when 1 then 1 else 0 end::bigint as n from v""")
def stream_roll_calls(spark, sf):
    """Roll calls as a stream, with their links: pages that come again with one vote, or none."""
    head = F.concat(F.lit("<title>決議案：投票</title><h2>第"), (F.col("k") % 90 + 1).cast("string"), F.lit("回国会</h2>"))
    row = "<tr><td>賛成</td><td></td><td>議員{0}</td></tr>"
    rows = _t(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    second = F.when(F.col("k") % 3 == 1, F.concat(head, F.lit(row.format("甲")))).when(F.col("k") % 3 == 2, head)
    models = _followed(spark, "roll_calls", _versions(rows, _text("sangiin-vote:", "=k", "-0310-v002"), F.concat(head, F.lit(row.format("甲") + row.format("乙"))), second))
    n = models.read("vote").groupBy("vote_event_id").count()
    return models.read("event").join(n, "vote_event_id", "left").select("vote_event_id", "url", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("select l_suppkey, l_partkey, min(l_orderkey)::bigint as first_seq, max(l_orderkey)::bigint as last_seq, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) as l_returnflag from lineitem group by 1, 2")
def stream_spans(spark, sf):
    """Spans that merge as a stream, batches late and twice."""
    path, key = shared_folder(spark, "spans"), ["l_suppkey", "l_partkey"]
    lines = _t(spark, sf, "lineitem").select(*key, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag")
    models = ReadModels(spark, path, {"span": Table("spans", tuple(key), attributes=("l_returnflag",))}, lambda batch, _: {"span": folds.spans(batch, key, ["l_returnflag"])}, buckets=8)
    for n, part in enumerate((2, 0, 1, 0)):
        models.apply(lines.where(F.col("seq") % 3 == part), n)
    found = models.read("span")
    return found.select(*key, *[F.floor(F.col(c) / 10).cast("long").alias(c) for c in ("first_seq", "last_seq")], "l_returnflag")


def _stored(spark: SparkSession, sf: str, batches: int) -> LogStore:
    """The log of ``events``, appended in batches of time, the last one twice."""
    seen = _observations(spark, sf)
    own = seen.select(
        F.format_string("e-%09d", "event_id").alias("event_id"), "stream_id", F.lit("user").alias("source"), F.lit("v1").alias("fetcher_version"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.lit(None).cast("timestamp").alias("source_published_at"), "content_hash", F.col("event_type").cast("binary").alias("payload"),
    )
    low, high = own.agg(F.min("observed_at"), F.max("observed_at")).first()
    later = [F.col("observed_at") >= F.lit(low + (high - low) * i / batches) for i in range(1, batches)]
    path, landed = shared_folder(spark, "landed"), own.withColumn("part", sum((x.cast("int") for x in later), F.lit(0)))
    landed.write.partitionBy("part").parquet(path)  # a folder for each batch, so a batch does not read the others
    rows = spark.read.schema(landed.schema).parquet(path)
    store = LogStore(spark, shared_folder(spark, "log"), buckets=8)
    for i in [*range(batches), batches - 1]:
        store.append(rows.where(F.col("part") == i).drop("part"), i)
    return store


@query(_sql("select 'e-' || lpad(event_id::varchar, 9, '0') as event_id, stream_id, stream_seq, seq, type, content_hash, prev_content_hash from tr"))
def log_store_batches(spark, sf):
    """The stored log after ten batches."""
    return _stored(spark, sf, 10).read("event").select("event_id", "stream_id", "stream_seq", "seq", "type", "content_hash", "prev_content_hash")


@query(_sql("""select * from (select 'newest' as page, seq, stream_id, type from tr order by seq desc limit 30) union all select * from (select 'older', seq, stream_id, type from tr where seq < 900 and type = 'restored' order by seq desc limit 20) union all
 select 'stream', seq, stream_id, type from tr where stream_id = 'user:7'"""))
def log_store_pages(spark, sf):
    """Pages of the stored log, which read its last batches, and one stream's events."""
    store = _stored(spark, sf, 4)
    pages = {"newest": store.recent(30), "older": store.recent(20, before=900, where=F.col("type") == "restored"), "stream": store.stream_events("user:7")}
    rows = [p.select(F.lit(name).alias("page"), "seq", "stream_id", "type") for name, p in pages.items() if p is not None]
    return rows[0].union(rows[1]).union(rows[2]) if len(rows) == 3 else rows[0]


@query("""select 3 * p_partkey + v as change_id, case when v = 1 and p_partkey % 3 = 0 or v = 2 then 'substantive' else 'administrative' end as classification, (v = 1 and p_partkey % 3 = 0 or v = 2)::bigint as modified
 from part, (select unnest([1, 2]) as v) where v = 1 and p_partkey % 3 < 2 or v = 2 and p_partkey % 2 = 0""")
def changes_followed(spark, sf):
    """Changes of laws batch by batch: each batch reads its own pairs, each text is parsed once."""
    law = lambda caption, sentence: _text('<Law><LawBody><MainProvision><Article Num="1"><ArticleCaption>', caption, "</ArticleCaption><Paragraph><ParagraphSentence><Sentence>", sentence, "=k", "</Sentence></ParagraphSentence></Paragraph></Article></MainProvision></LawBody></Law>")
    k = F.col("k").cast("long")
    texts = [law("総則", "甲"), F.when(k % 3 == 0, law("総則", "乙")).when(k % 3 == 1, law("通則", "甲")), F.when(k % 2 == 0, law("総則", "丙"))]
    each = F.explode(F.array(*[F.struct((3 * k + v).alias("seq"), t.alias("payload"), F.lit(v).alias("v")) for v, t in enumerate(texts)]))
    rows = _t(spark, sf, "part").withColumn("k", F.col("p_partkey")).select(_text("egov-law:", "=k").alias("stream_id"), each.alias("x")).select("stream_id", "x.*").where("payload is not null")
    path = shared_folder(spark, "changes")
    events, snapshots = _log_of(rows)
    snapshots.write.parquet(f"{path}/snapshot")
    events.join(rows.select("stream_id", "seq", "v"), ["stream_id", "seq"]).write.parquet(f"{path}/event")
    follow = readmodels.Changes(spark, f"{path}/model", lambda: spark.read.parquet(f"{path}/snapshot"), buckets=8)
    for n, v in enumerate((0, 1, 2, 2)):
        follow.apply(spark.read.parquet(f"{path}/event").where(F.col("v") == v).drop("v"), n)
    return follow.read().select("change_id", "classification", "modified")


@query(_sql("select stream_id, event_id, type, content_hash, prev_content_hash, stream_seq from tr"))
def stream_transitions_continued(spark, sf):
    """The first half of the log in a batch, the rest as a stream that goes on from its tail."""
    rows = _observations(spark, sf).select("stream_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "content_hash")
    half = rows.agg(F.percentile_approx("at", 0.5)).first()[0] or 0
    first = observe.transitions(rows.where(F.col("at") <= half), "stream_id", ["at", "event_id"], "content_hash")
    path = shared_folder(spark, "continued")
    rows.where(F.col("at") > half).coalesce(1).write.parquet(f"{path}/in")
    observe.tail_state(first).write.parquet(f"{path}/tail")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = stream_folds.transitions(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), spark.read.parquet(f"{path}/tail"))
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    names = ["stream_id", "event_id", "type", "content_hash", "prev_content_hash", "stream_seq"]
    return first.select(names).union(spark.read.schema(stream_folds.EVENT).parquet(f"{path}/out").select(names))


@query(f"with {_LAST} select o_custkey, o_orderkey, l_linenumber, true as same, 1 as generation from last join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'")
def replay_generation(spark, sf):
    """A model with children is replayed in other batches beside the live one, found equal
    by an ordered fingerprint, and takes its place."""
    path = shared_folder(spark, "replay")
    lines = _returned(spark, sf).groupBy("o_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    log = _t(spark, sf, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").withColumn("seq", F.col("o_orderkey"))

    def derive(batch: DataFrame, _: str) -> dict[str, DataFrame]:
        own = batch.select("o_custkey", "o_orderkey", F.explode("lines").alias("l_linenumber"))
        return {"line": own, "heads": folds.heads(batch, "o_custkey", "o_orderkey")}

    make = lambda at: ReadModels(spark, at, {"line": Table("children", ("o_custkey",), "o_orderkey")}, derive, "o_custkey", "o_orderkey", buckets=8)
    models = Generations(spark, path, make)
    stream = _in_parts(spark, log, path, 3)
    live = models.current()
    live.apply(spark.read.schema(log.schema).parquet(f"{path}/in"), 0)
    same = models.replay(stream, f"{path}/checkpoint", {"line": ["o_custkey", "o_orderkey", "l_linenumber"]})
    found = models.current()
    return found.read("line").select("o_custkey", "o_orderkey", "l_linenumber", F.lit(same["line"]).alias("same"), F.lit(max(models._numbers())).alias("generation"))


@query(_sql(f"""{_TL} select 'a' as page, {', '.join(_SHOWN)} from (select * from tl where contains(lower(title), 'azure') or contains(lower(subtitle), 'azure') or contains(lower(category), 'azure') or contains(lower(stream_id), 'azure') order by seq desc limit 201)
 union all select 'b', {', '.join(_SHOWN)} from (select * from tl where contains(lower(title), 'er') or contains(lower(subtitle), 'er') or contains(lower(category), 'er') or contains(lower(stream_id), 'er') order by seq desc limit 31)
 union all select 'c', {', '.join(_SHOWN)} from (select * from tl where contains(lower(title), 'user:12') or contains(lower(subtitle), 'user:12') or contains(lower(category), 'user:12') or contains(lower(stream_id), 'user:12') order by seq desc limit 31)"""))
def timeline_keyword_indexed(spark, sf):
    """Keyword pages by the index of the streams' texts: a word, a short one, part of an id."""
    parts = _timeline(spark, sf)
    texts = timeline.stream_texts(parts, parts.log.select("stream_id").distinct())
    path = shared_folder(spark, "postings")
    timeline.postings(texts).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(path)
    parts = replace(parts, index=spark.read.parquet(path))
    pages = [timeline.page(parts, n=n, word=word).select(F.lit(name).alias("page"), *_SHOWN) for name, word, n in (("a", "Azure", 200), ("b", "ER", 30), ("c", "user:12", 30))]
    return pages[0].union(pages[1]).union(pages[2])


_SEGMENT = f"(case when seq <= (select max(seq) from tr where seq % {EVERY} = 0) then ((seq + {EVERY - 1}) // {EVERY}) * {EVERY} end)"
_AUDIT = f"""seg as (select {_SEGMENT} as s, tr.*, lag(event_id) over (order by seq) as pe from tr),
 sv as (select s, count(*) as n, count(*) filter (event_id % 50 = 0 or event_id % 70 = 0) as bad_hashes, count(*) filter (pe % 50 = 0) as bad_links, max_by(event_id, seq) % 50 <> 0 and coalesce(s % {3 * EVERY} <> 0, true) as root_ok_,
   min(seq) as low from seg group by s),
 sw as (select s, n, bad_hashes, bad_links, s is null or root_ok_ as root_ok, (low - 1) % {3 * EVERY} <> 0 or low = 1 as joins_ok from sv)"""


@query(_sql(f", {_AUDIT} select coalesce(s, -1)::bigint as through_seq, n, bad_hashes, bad_links, root_ok, joins_ok, bad_hashes = 0 and bad_links = 0 and root_ok and joins_ok as ok from sw"))
def audited_segments(spark, sf):
    """Verdicts of all segments between checkpoints of a log whose rows and hashes were
    changed here and there, every third checkpoint with another root."""
    whole = written(chain.append(_untouched(spark, sf), "all"))
    log, roots = _changed(whole), whole.where(F.col("seq") % EVERY == 0)
    # of the root's own text, so that it is not what _changed made of the same hash
    wrong = F.when(F.col("seq") % (3 * EVERY) == 0, F.sha2(F.concat(F.lit("root"), "log_hash"), 256)).otherwise(F.col("log_hash"))
    found = chain.segment_verdicts(log, roots.select(F.col("seq").alias("through_seq"), wrong.alias("root_hash")))
    return found.withColumn("through_seq", F.coalesce("through_seq", F.lit(-1).cast("long")))


def _untouched(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(_log(spark, sf)).withColumn("all", F.lit("log"))


@query("select doc_id, text, text is not null as there from documents")
def packed_payloads(spark, sf):
    """Documents stored as gzip, as they stand, or not at all, read back."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode()) if len(t) % 2 else t.encode())

    rows = _t(spark, sf, "documents").select("doc_id", pack("text").alias("payload"))
    return payloads.plain_payloads(rows).select("doc_id", F.col("payload").cast("string").alias("text"), F.col("payload").isNotNull().alias("there"))


@query("""select p_partkey::bigint as change_id, x.place::bigint as place, x.eid, x.op from part, lateral (select unnest(case p_partkey % 2 when 0 then
 [{'place': 1, 'eid': 'b', 'op': 'moved'}, {'place': 2, 'eid': 'd', 'op': 'added'}, {'place': 3, 'eid': 'c', 'op': 'deleted'}, {'place': 4, 'eid': 'a', 'op': 'modified'}] else
 [{'place': 1, 'eid': 'a', 'op': 'modified'}, {'place': 2, 'eid': 'b', 'op': 'moved'}, {'place': 3, 'eid': 'd', 'op': 'added'}, {'place': 4, 'eid': 'c', 'op': 'deleted'}] end) as x) y""")
def diff_order(spark, sf):
    """Node changes stand by ordinal and id: the new ordinal, of what is gone the old one."""
    k = F.col("p_partkey")
    node = lambda eid, parent, text, n: F.struct(F.lit(eid).alias("eid"), F.lit(parent).alias("parent_eid"), F.lit("article").alias("node_type"), F.lit("1").alias("num"), F.lit("").alias("caption"), F.lit(text).alias("sentence_text"), (n if hasattr(n, "cast") else F.lit(n)).cast("long").alias("ordinal"))
    side = lambda *nodes: _t(spark, sf, "part").select(k.alias("change_id"), F.inline(F.array(*nodes)))
    prev = side(node("a", "", "x", 3), node("b", "", "y", 7), node("c", "", "z", 2), node("e", "", "same", 9))
    curr = side(node("a", "", "w", F.when(k % 2 == 0, 5).otherwise(0)), node("b", "q", "y", 1), node("d", "", "v", 1), node("e", "", "same", 4))
    events = _t(spark, sf, "part").select(k.alias("change_id"), F.lit(False).alias("degraded"))
    found = diff.change_records(events, diff.node_changes(prev, curr))
    return found.select("change_id", F.posexplode("node_changes").alias("i", "c")).select("change_id", (F.col("i") + 1).cast("long").alias("place"), "c.eid", "c.op")


@query("select c_custkey, case when c_custkey % 4 = 0 then null else '<a k=\"' || c_custkey || '\" x=\"1\"><b></b> é</a>' end as canonical from customer")
def canonical_documents(spark, sf):
    """The same document in other spellings, and one that does not parse."""
    c = F.col("c_custkey") % 4
    text = F.when(c == 0, "<a><b></a>").when(c == 1, _text('<a x="1"  k="', "=k", '"><b/> é</a>')).when(c == 2, _text("<?xml version='1.0'?><a k='", "=k", "' x='1' ><b></b> &#233;</a>")).otherwise(_text('<a k="', "=k", '" x="&#49;"><b />\u0020é</a>'))
    rows = _customers(spark, sf).select("c_custkey", payloads.canonical_xml(text.cast("binary")).alias("canonical"))
    return rows.withColumn("canonical", F.col("canonical").cast("string"))


@query("""select p_partkey::varchar as law_id, '第' || p_partkey || '号' as law_num, p_name as title, p_partkey % 4 <> 0 as degraded, p_brand as category, 'https://laws.e-gov.go.jp/law/' || p_partkey as url, case p_partkey % 4 when 2 then 3 else 4 end::bigint as nodes from part""")
def law_read_model(spark, sf):
    """Law headers with what the landed listing says of them, and their nodes."""
    laws = _law_text(spark, sf).select(_text("egov-law:", "=p_partkey").alias("stream_id"), (F.col("p_partkey") + 1).alias("seq"), "payload")
    listing = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("local_key"), F.col("p_type").alias("law_type"), F.col("p_brand").alias("category"), F.lit(None).cast("date").alias("enforced_on"))
    found = readmodels.laws(*_log_of(laws), listing)
    n = found["law_node"].groupBy("law_id").agg(F.count(F.lit(1)).alias("nodes"))
    return found["legislative_work"].join(n, "law_id").select("law_id", "law_num", "title", "degraded", "category", "url", "nodes")


@query("select c_custkey, c_custkey % 3 = 0 as was_ocr, 'kokkai' as source from customer")
def attribution_ocr(spark, sf):
    """Whether a row's text was read from images is its snapshot's own fact; unknown is no."""
    rows = _customers(spark, sf)
    ocr = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    log = rows.select(F.col("c_custkey").alias("seq"), _text("kokkai:", "=k").alias("stream_id"), F.lit("2026-01-01").cast("timestamp").alias("observed_at"), F.sha2("c_name", 256).alias("content_hash"), F.lit("").alias("log_hash"), ocr.alias("was_ocr"))
    found = lookups.attributed(rows.select("c_custkey", F.col("c_custkey").alias("seq")), log)
    return found.select("c_custkey", F.col("attribution.was_ocr").alias("was_ocr"), F.col("attribution.source").alias("source"))


@query("select event_id as seq, 'user:' || user_id as stream_id, event_type || '|' || coalesce(props, '') as text from events where event_id > 40 and 'user:' || user_id like 'user:1%' and event_type <> 'error' order by event_id limit 100")
def log_scan_batch(spark, sf):
    """The next hundred events of one source after an offset, with their contents."""
    own = F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))
    rows = _t(spark, sf, "events").withColumn("text", own).withColumn("content_hash", F.when(F.col("event_type") != "error", F.sha2("text", 256)))
    events = rows.select(F.col("event_id").alias("seq"), C.stream_id(F.lit("user"), F.col("user_id").cast("string")).alias("stream_id"), "content_hash")
    snapshots = rows.where("content_hash is not null").select("content_hash", F.col("text").cast("binary").alias("payload")).dropDuplicates(["content_hash"])
    return readmodels.log_scan(events, snapshots, after=40, prefix="user:1", limit=100).select("seq", "stream_id", F.col("payload").cast("string").alias("text"))


@query("""with p as (select l_suppkey from lineitem group by 1 order by count(*) desc, l_suppkey limit 1)
 select o_orderkey::varchar as vote_event_id, l_returnflag as option, o_orderdate::date::varchar as date from lineitem join p using (l_suppkey) join orders on l_orderkey = o_orderkey
 order by o_orderdate::date desc nulls last, o_orderkey::varchar, l_returnflag limit 41 offset 5""")
def legislator_page(spark, sf):
    """A page of the record of the member with most votes."""
    events, cast, meetings, _ = _bindings(spark, sf)
    who = cast.groupBy("person_id").count().orderBy(F.desc("count"), F.col("person_id").cast("long")).first()[0]
    persons = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("person_id"), F.col("s_name").alias("name"), F.lit("high").alias("identity_confidence"))
    events, meetings = events.withColumn("result", F.lit("")), meetings.withColumn("house", F.lit(""))
    return lookups.list_legislator_votes(persons, cast, events, meetings, who, n=40, token="5").select("vote_event_id", "option", F.col("date").cast("string").alias("date"))
