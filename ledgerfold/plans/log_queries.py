"""Registered queries over the log: appending, verification, checkpoints, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import wire
from ..operators import chain, folds, observe
from ..sources.store import shared_folder
from ..streaming import folds as stream_folds
from . import lookups, timeline
from .driver_queries import _ORDER, _SHOWN, _TL, EVERY, _checkpoints, _events, _facts, _log, _observations, _sql, _t, _timeline, query


@query(_sql("select stream_id, event_id, type, content_hash, prev_content_hash, stream_seq, seq from tr"))
def append_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The log in two batches: the second goes on from the tail of the first."""
    seen = _observations(spark, sf)
    half = seen.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("half"))
    cut = seen.join(F.broadcast(half)).withColumn("late", F.unix_micros(F.col("ts").cast("timestamp")) > F.col("half")).drop("half")  # one row
    hour = F.date_trunc("hour", "ts")
    first = observe.global_sequence(observe.transitions(cut.where("not late"), "stream_id", _ORDER, "content_hash"), _ORDER, hour)
    again = observe.transitions(cut.where("late"), "stream_id", _ORDER, "content_hash", observe.tail_state(first))
    last = first.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    second = observe.global_sequence(again, _ORDER, hour).join(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last"))  # one row
    names = ["stream_id", "event_id", "type", "content_hash", "prev_content_hash", "stream_seq", "seq"]
    return first.select(names).union(second.select(names))


@query(_sql("select event_id, seq from tr where false"))
def append_again(spark, sf):
    """What a batch that was appended already adds once more, by its last contents: nothing."""
    events = _events(spark, sf)
    last = observe.tail_state(events)
    same = last.where("last_type <> 'vanished'").select("stream_id", F.col("last_content").alias("content_hash"), F.lit(0).cast("long").alias("event_id"), F.current_timestamp().alias("ts"))
    return observe.transitions(same, "stream_id", _ORDER, "content_hash", last).select("event_id", F.lit(0).cast("long").alias("seq"))


def _tampered(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """The log with the facts of some rows and the hashes of others changed after the fact."""
    return _changed(chain.append(_facts(_log(spark, sf)).withColumn("all", F.lit("log")), key))


def _changed(log: DataFrame) -> DataFrame:
    n = F.substring_index("event_id", "-", -1).cast("long")
    other = F.when(n % 70 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("prev_content_hash"))
    return log.withColumn("prev_content_hash", other).withColumn("log_hash", F.when(n % 50 == 0, F.sha2("log_hash", 256)).otherwise(F.col("log_hash")))


_OK = "not (event_id % 50 = 0 or event_id % 70 = 0)"
_CONTENT_OK = "case when content_hash is not null then event_id % 70 <> 0 end"
_COVER = f"coalesce((select min(c.seq)::bigint from tr c where c.seq % {EVERY} = 0 and c.seq >= {{0}}), -1)"


@query(_sql(f"""select stream_id, count(*)::bigint as events, bool_and({_OK}) as hashes_ok, coalesce(bool_and({_CONTENT_OK}), true) as content_ok, max(seq)::bigint as max_seq,
  {_COVER.format("max(tr.seq)")} as covered_by from tr group by stream_id"""))
def chain_tamper_report(spark, sf):
    report = chain.stream_report(_tampered(spark, sf, "stream_id"), _checkpoints(spark, sf))
    return report.withColumn("covered_by", F.coalesce("covered_by", F.lit(-1).cast("long")))


@query(_sql(f"""select seq, stream_seq, type, {_OK} as hash_ok, {_CONTENT_OK} as content_ok, {_COVER.format("(select max(m.seq) from tr m where m.stream_id = 'user:7')")} as covered_by,
  (select bool_and({_OK} and coalesce({_CONTENT_OK}, true)) from tr where stream_id = 'user:7') as all_ok from tr where stream_id = 'user:7' order by stream_seq"""))
def stream_verification(spark, sf):
    found = lookups.get_stream_verification(_tampered(spark, sf, "stream_id"), _checkpoints(spark, sf), "user:7")
    return found.drop("log_hash").withColumn("covered_by", F.coalesce("covered_by", F.lit(-1).cast("long")))


@query(_sql(f"""select seq, 'hash' as problem from tr where seq > {EVERY} and ({_OK.replace("not ", "")}) union all
 select b.seq, 'link' from tr a join tr b on b.seq = a.seq + 1 where b.seq > {EVERY} and a.event_id % 50 = 0"""))
def segment_audit(spark, sf):
    return chain.segment_audit(_tampered(spark, sf, "all"), EVERY)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    orders = observe.global_sequence(_t(spark, sf, "orders"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 10_000))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.lit("ReviewVerdict").alias("type"), F.col("o_custkey").alias("observation_seq"), F.col("o_orderpriority").alias("actor"), F.col("o_orderdate").cast("timestamp").alias("decided_at"),
        C.canonical_json(F.concat(F.lit('{"v": "'), "o_orderstatus", F.lit('"}'))).alias("payload"), "seq", F.lit("verdicts").alias("log"),
    )


@query("""with v as (select o_orderkey, row_number() over (order by o_orderkey)::bigint as seq from orders)
 select seq, 'hash' as problem from v where o_orderkey % 91 = 0 union all
 select seq + 1, 'link' from v where o_orderkey % 91 = 0 and seq < (select max(seq) from v)""")
def verdict_audit(spark, sf):
    """A chain of review verdicts, some of whose hashes were changed."""
    log = chain.append_verdicts(_verdicts(spark, sf), "log")
    changed = F.when(F.col("event_id").cast("long") % 91 == 0, F.sha2("log_hash", 256)).otherwise(F.col("log_hash"))
    return chain.verdict_audit(log.withColumn("log_hash", changed))


@query(_sql(f"""select (select count(*) from customer where c_acctbal > 0)::bigint as watched, max(seq)::bigint as through_seq, '{wire.GENESIS}' as root_hash from tr where seq % {EVERY} = 0"""))
def masthead(spark, sf):
    watch = _t(spark, sf, "customer").select(F.col("c_name").alias("stream_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    return chain.masthead(watch, _checkpoints(spark, sf))


@query(_sql(f"""select seq as through_seq, seq as tree_size, '{wire.GENESIS}' as root_hash, 'ledgerfold/log' || chr(10) || seq || chr(10) || to_base64(unhex('{wire.GENESIS}')) || chr(10) as body
 from tr where seq % {EVERY} = 0 order by seq desc limit 100"""))
def checkpoint_list(spark, sf):
    return chain.checkpoint_feed(_checkpoints(spark, sf))


_EVENTS = ["seq", "stream_id", "type", "stream_seq"]


@query(_sql(f"select seq, stream_id, type, stream_seq, coalesce((select min(c.seq)::bigint from tr c where c.seq % {EVERY} = 0 and c.seq >= (select max(m.seq) from tr m where m.stream_id = 'user:7')), -1) as covered_by from tr where stream_id = 'user:7'"))
def stream_export(spark, sf):
    return chain.exported(_log(spark, sf), _checkpoints(spark, sf), "user:7").select(*_EVENTS, F.coalesce("covered_by", F.lit(-1).cast("long")).alias("covered_by"))


@query(_sql(f"{_TL} select {', '.join(_SHOWN)} from tl where source in ('user', 'other') and observed_at >= timestamp '2024-01-02 00:00:00' and observed_at < timestamp '2024-01-09 12:00:00' order by seq desc limit 101"))
def timeline_sources(spark, sf):
    """An allow-list of sources and a half-open range of times."""
    found = timeline.page(_timeline(spark, sf), n=100, sources=["user", "other"], since="2024-01-02T00:00:00Z", until="2024-01-09T21:00:00+09:00")
    return found.select(*_SHOWN)


@query(_sql(f"{_TL}, n as (select seq from tl where classification = 'administrative' and contains(lower(title || '|' || subtitle || '|' || category || '|' || stream_id), 'brand') order by seq desc limit 10000) select count(*)::bigint as total, (count(*) filter (seq >= 900))::bigint as above, ((count(*) filter (seq >= 900)) // 20 + 1)::bigint as page from n"))
def timeline_count_filtered(spark, sf):
    return timeline.count(_timeline(spark, sf), cursor=900, n=20, classification="administrative", word="Brand")


@query("select l.* from (select l_partkey, l_orderkey, l_linenumber, l_suppkey from lineitem) l join (select l_partkey, max(l_orderkey) as m from lineitem group by 1) x on l.l_partkey = x.l_partkey and l.l_orderkey = x.m")
def children_replaced(spark, sf):
    """Children of each part's last order, folded in two batches."""
    lines = _t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    first = folds.replaced_children(None, lines.where("l_orderkey % 2 = 0"), "l_partkey", "l_orderkey")
    return folds.replaced_children(first, lines.where("l_orderkey % 2 = 1"), "l_partkey", "l_orderkey")


@query("""with last as (select l_suppkey as page, max(l_orderkey) as m from lineitem group by 1), r as (select l_suppkey as page, l_partkey as k, l_orderkey as seq from lineitem join last on l_suppkey = page and l_orderkey = m)
 select k, max(seq)::bigint as seq from r group by k""")
def roster_by_page(spark, sf):
    """Pages replace their rows; the last page that has a key wins."""
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("seq"))
    return folds.by_page(rows, "page", "k").select("k", "seq")


@query("select o_custkey, o_orderkey, o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') union all select o_custkey, o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey % 2 = 0")
def scope_replaced(spark, sf):
    """Two producers write anew in a table that five share."""
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    new = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey % 2 = 0")
    return folds.replaced_scope(orders, new, "o_orderpriority")


@query("select l_suppkey, l_partkey, min(l_orderkey)::bigint as first_seq, max(l_orderkey)::bigint as last_seq from lineitem group by 1, 2")
def spans_continued(spark, sf):
    """Spans of stored rows and of a batch that overlaps them."""
    lines, key = _t(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"]
    stored = folds.spans(lines.where("l_orderkey % 3 <> 0"), key, ["l_returnflag"], "l_orderkey")
    batch = folds.spans(lines.where("l_orderkey % 3 <> 1"), key, ["l_returnflag"], "l_orderkey")
    return folds.merged_spans(stored, batch, key, ["l_returnflag"]).drop("l_returnflag")


@query("select coalesce(s.stream_id, r.stream_id) as stream_id, coalesce(r.url, s.url) as url, coalesce(s.enabled, true) as enabled from (select 'user:' || c_custkey as stream_id, 'old' as url, c_acctbal > 0 as enabled from customer) s full join (select distinct 'user:' || user_id as stream_id, 'u/' || user_id as url from events) r on s.stream_id = r.stream_id")
def watch_upsert(spark, sf):
    stored = _t(spark, sf, "customer").select(C.stream_id(F.lit("user"), F.col("c_custkey").cast("string")).alias("stream_id"), F.lit("old").alias("url"), (F.col("c_acctbal") > 0).alias("enabled"))
    refs = _t(spark, sf, "events").select(C.stream_id(F.lit("user"), F.col("user_id").cast("string")).alias("stream_id"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"))
    return observe.watch_upsert(stored, refs)


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'error' when o_orderstatus = 'F' and o_orderkey % 7 <> 0 then 'present' when exists (select 1 from customer where c_custkey = o_orderkey) then 'pending' else 'absent' end as status from orders""")
def fetch_status(spark, sf):
    """Missing payloads of what is still registered are pending, others absent."""
    fetches = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("local_key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("present"), (F.col("o_orderkey") % 7 == 0).alias("content_unavailable"))
    return observe.usable(fetches, _t(spark, sf, "customer").select(F.col("c_custkey").alias("local_key"))).select("o_orderkey", "status")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def stream_fold(spark, sf):
    """A read model that a stream of files folds batch by batch, with one batch delivered twice."""
    path = shared_folder(spark, "fold")
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    fold = stream_folds.Fold(spark, f"{path}/model", "o_custkey", "o_orderkey", buckets=8)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    fold.start(stream, f"{path}/checkpoint").awaitTermination()
    fold.apply(orders.where("o_orderkey % 3 = 2"), fold.version())
    return fold.read()


@query("select l_partkey, l_orderkey, l_linenumber from lineitem qualify max(l_orderkey) over (partition by l_partkey) = l_orderkey")
def stream_children(spark, sf):
    """Children that a stream replaces by their parent's last event."""
    path = shared_folder(spark, "children")
    lines = _t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    for part in range(2):
        lines.where(F.col("l_orderkey") % 2 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    fold = stream_folds.Fold(spark, f"{path}/model", "l_partkey", "l_orderkey", children=True, buckets=8)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    fold.start(stream, f"{path}/checkpoint").awaitTermination()
    return fold.read()


@query(_sql("select (select count(*) from tr where type = 'vanished')::bigint as vanished, 0::bigint as bad_vanished, 0::bigint as unknown_type, 0::bigint as bad_seq"))
def event_rules(spark, sf):
    """The log's own rules hold on the log as it is made."""
    from ..operators import rules

    events = _events(spark, sf)
    found = rules.violations(events, rules.RULES["event"]).groupBy().pivot("rule", list(rules.RULES["event"])).agg(F.first("violations"))
    names = {"vanished_has_no_content": "bad_vanished", "known_type": "unknown_type", "positive_seq": "bad_seq"}
    n = events.agg(F.count_if(F.col("type") == "vanished").cast("long").alias("vanished"))
    return n.join(F.broadcast(found.select(*[F.col(a).alias(b) for a, b in names.items()])))  # one row each
