"""The operators over the given tables, each with the same result in SQL.

``events`` stands in for the log (a stream is a user, an error is an absence),
``customer`` and ``supplier`` for meetings and laws, ``orders`` for votes,
``documents`` for texts with lines, ``conversations`` for speeches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import wire
from ..operators import chain, diff, folds, observe, paging, people, rules, votes
from ..sources import payloads
from ..sources.store import shared_folder
from ..streaming import folds as stream_folds
from . import lookups, timeline

EVERY = 500  # events between checkpoints
_ORDER = ["ts", "event_id"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    content = F.when(F.col("event_type") != "error", F.sha2(F.concat_ws("|", "event_type", F.coalesce("props", F.lit(""))), 256))
    return _t(spark, sf, "events").select(C.stream_id(F.lit("user"), F.col("user_id").cast("string")).alias("stream_id"), "event_id", "ts", "event_type", "value", content.alias("content_hash"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return observe.transitions(_observations(spark, sf), "stream_id", _ORDER, "content_hash")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    found = observe.global_sequence(_events(spark, sf), _ORDER, F.date_trunc("hour", "ts"))
    return found.withColumn("observed_at", F.col("ts").cast("timestamp"))


_OBS = """
obs as (select concat('user:', user_id) as stream_id, event_id, ts, event_type, value,
  case when event_type <> 'error' then sha256(event_type || '|' || coalesce(props, '')) end as c from events),
w as (select *, lag(c) over (partition by stream_id order by ts, event_id) as pc,
  last_value(c ignore nulls) over (partition by stream_id order by ts, event_id rows between unbounded preceding and 1 preceding) as lc from obs),
ev as (select *, case when c is null and pc is not null then 'vanished' when c is null then null when lc is null then 'observed'
  when pc is null then 'restored' when c <> lc then 'changed' end as type from w),
tr as (select stream_id, event_id, ts, value, event_type, c as content_hash, lc as prev_content_hash, type,
  row_number() over (partition by stream_id order by ts, event_id)::bigint as stream_seq, row_number() over (order by ts, event_id)::bigint as seq
  from ev where type is not null)"""


def _sql(text: str) -> str:
    return f"with {_OBS.strip()} {text}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(_sql("select stream_id, event_id, type, content_hash, prev_content_hash, stream_seq from tr"))
def transition_events(spark, sf):
    return _events(spark, sf).select("stream_id", "event_id", "type", "content_hash", "prev_content_hash", "stream_seq")


@query(_sql("select stream_id, max_by(type, stream_seq) as last_type, max_by(content_hash, case when content_hash is not null then stream_seq end) as last_content, max(stream_seq)::bigint + 1 as next_seq from tr group by stream_id"))
def stream_tail_state(spark, sf):
    return observe.tail_state(_events(spark, sf))


@query(_sql("select stream_id, event_id, content_hash, seq from tr where content_hash is not null qualify row_number() over (partition by stream_id order by seq desc) = 1"))
def current_content(spark, sf):
    return folds.latest(_log(spark, sf).where("content_hash is not null"), "stream_id").select("stream_id", "event_id", "content_hash", "seq")


@query(_sql("select event_id, seq from tr"))
def global_seq(spark, sf):
    return _log(spark, sf).select("event_id", "seq")


@query("select distinct sha256(text) as content_hash, length(text)::bigint as n_chars from documents where text is not null")
def snapshot_dedup(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.length("text").cast("long").alias("n_chars"))
    return observe.new_only(docs, "content_hash")


@query("select distinct concat('user:', user_id) as stream_id from events where user_id not in (select c_custkey from customer where c_custkey % 2 = 1)")
def registry_insert_once(spark, sf):
    stored = _t(spark, sf, "customer").where("c_custkey % 2 = 1").select(C.stream_id(F.lit("user"), F.col("c_custkey").cast("string")).alias("stream_id"))
    return observe.new_only(_observations(spark, sf).select("stream_id"), "stream_id", stored)


@query(_sql("select e.seq, e.earlier, e.content_hash from (select seq, content_hash, last_value(content_hash ignore nulls) over (partition by stream_id order by stream_seq rows between unbounded preceding and 1 preceding) as earlier from tr) e where e.earlier is not null and e.content_hash is not null and e.earlier <> e.content_hash"))
def revision_pairs(spark, sf):
    return observe.revisions(_log(spark, sf)).select("seq", "earlier", "content_hash")


def _facts(log: DataFrame) -> DataFrame:
    return log.select(
        F.format_string("e-%d", "event_id").alias("event_id"), "stream_id", "stream_seq", "seq", "type", F.lit("user").alias("source"), F.lit("v1").alias("fetcher_version"),
        "observed_at", F.lit(None).cast("timestamp").alias("source_published_at"), "content_hash", "prev_content_hash",
    )


def _field(n: int, value: str) -> str:
    return f"case when coalesce({value}, '') = '' then '' else '{n << 3 | 2:02x}' || format('{{:02x}}', octet_length(encode({value}))) || lower(hex(encode({value}))) end"


_REF = "case when {0} is null then '' else 'sha256:' || {0} end"
_WIRE = " || ".join(
    [
        _field(1, "'e-' || event_id"), _field(2, "stream_id"),
        "'18' || case when stream_seq < 128 then format('{:02x}', stream_seq) else format('{:02x}{:02x}', (stream_seq & 127) | 128, stream_seq >> 7) end",
        "'20' || case type when 'observed' then '01' when 'changed' then '02' when 'vanished' then '03' else '04' end",
        _field(5, "'user'"), _field(6, "'v1'"), _field(7, "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"),
        _field(9, f"({_REF.format('content_hash')})"), _field(10, f"({_REF.format('prev_content_hash')})"), _field(11, f"'{wire.GENESIS}'"),
    ]
)


@query(_sql(f"select event_id, sha256(unhex({_WIRE})) as log_hash from tr"))
def log_wire_hash(spark, sf):
    log = _log(spark, sf)
    facts = _facts(log).withColumn("log_prev_hash", F.lit(wire.GENESIS))
    return facts.select(F.substring_index("event_id", "-", -1).cast("long").alias("event_id"), wire.log_hash().alias("log_hash"))


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).where(F.col("seq") % EVERY == 0).select(F.col("seq").alias("through_seq"), F.col("seq").alias("tree_size"), F.lit(wire.GENESIS).alias("root_hash"))


@query(_sql(f"""select stream_id, count(*)::bigint as events, true as hashes_ok, true as content_ok, max(seq)::bigint as max_seq,
  coalesce((select min(seq)::bigint from tr c where c.seq % {EVERY} = 0 and c.seq >= max(tr.seq)), -1) as covered_by from tr group by stream_id"""))
def chain_verify_report(spark, sf):
    report = chain.stream_report(chain.append(_facts(_log(spark, sf)), "stream_id"), _checkpoints(spark, sf))
    return report.withColumn("covered_by", F.coalesce("covered_by", F.lit(-1).cast("long")))


@query(_sql(f"select max(seq)::bigint as through_seq, count(*)::bigint as tree_size from tr having max(seq) > (select max(seq) from tr where seq % {EVERY} = 0)"))
def checkpoint_rows(spark, sf):
    log = _log(spark, sf).withColumn("log_hash", F.col("content_hash"))
    return chain.next_checkpoint(log, _checkpoints(spark, sf)).select("through_seq", "tree_size")


@query(_sql(f"select seq, coalesce((select min(c.seq)::bigint from tr c where c.seq % {EVERY} = 0 and c.seq >= tr.seq), -1) as covered_by from tr"))
def covering_checkpoint(spark, sf):
    spans = _log(spark, sf).select("seq", F.col("seq").alias("max_seq"))
    return chain.covering(spans, _checkpoints(spark, sf)).select("seq", F.coalesce("covered_by", F.lit(-1).cast("long")).alias("covered_by"))


_TAMPERED = f"""select event_id + 1 as seq, sha256('h' || event_id + 1) as log_hash,
  case when event_id = 0 then '{wire.GENESIS}' when (event_id + 1) % 997 = 0 then 'x' else sha256('h' || event_id) end as log_prev_hash from events where (event_id + 1) % 1009 <> 0"""


@query(f"""with t as ({_TAMPERED}) select a.seq, case when b.seq is null then 'gap' else 'link' end as problem
  from t a left join t b on a.seq = b.seq + 1 where a.seq > (select min(seq) from t) and (b.seq is null or b.log_hash <> a.log_prev_hash)""")
def linkage_audit(spark, sf):
    n = F.col("event_id") + 1
    log = _t(spark, sf, "events").select(
        n.alias("seq"),
        F.sha2(F.concat(F.lit("h"), n.cast("string")), 256).alias("log_hash"),
        F.when(n == 1, wire.GENESIS).when(n % 997 == 0, "x").otherwise(F.sha2(F.concat(F.lit("h"), F.col("event_id").cast("string")), 256)).alias("log_prev_hash"),
    )
    return chain.linkage(log.where(F.col("seq") % 1009 != 0))


def _timeline(spark: SparkSession, sf: str) -> timeline.Parts:
    log = _log(spark, sf)
    meetings = _t(spark, sf, "customer").where("c_custkey % 3 = 0").select(C.stream_id(F.lit("user"), F.col("c_custkey").cast("string")).alias("stream_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("issue"))
    laws = _t(spark, sf, "part").where("p_partkey % 3 <> 0").select(C.stream_id(F.lit("user"), F.col("p_partkey").cast("string")).alias("stream_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("law_num"), F.col("p_type").alias("category"))
    ops = F.filter(F.array(*[F.when(F.col("event_id") % m == 0, F.struct(F.lit(o).alias("op"))) for m, o in ((2, "added"), (3, "deleted"), (5, "modified"), (7, "moved"))]), lambda x: x.isNotNull())
    changed = log.where("type = 'changed'").select(F.col("seq").alias("observation_seq"), F.when(F.col("event_id") % 2 == 0, "substantive").otherwise("administrative").alias("classification"), F.lit("high").alias("class_confidence"), ops.alias("node_changes"))
    cast = log.where("event_id % 11 = 0").select(F.col("seq").alias("observation_seq"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("x")).select("observation_seq", F.concat_ws("#", F.col("observation_seq").cast("string"), "x").alias("vote_event_id"))
    return timeline.Parts(log, meetings, laws, changed, cast)


_TL = """, tl as (select tr.seq, tr.stream_id, 'user' as source, tr.type, tr.ts as observed_at,
  case when c.c_custkey is not null then c_name when p.p_partkey is not null then p_name else '' end as title,
  case when c.c_custkey is not null then c_mktsegment when p.p_partkey is not null then p_brand else '' end as subtitle, coalesce(p_type, '') as category,
  case when type <> 'changed' then '' when event_id % 2 = 0 then 'substantive' else 'administrative' end as classification,
  (type = 'changed' and event_id % 2 = 0)::bigint as added, (type = 'changed' and event_id % 3 = 0)::bigint as deleted, (type = 'changed' and event_id % 5 = 0)::bigint as modified,
  case when event_id % 11 = 0 then seq || '#a' else '' end as vote_event_id
  from tr left join customer c on tr.stream_id = 'user:' || c_custkey and c_custkey % 3 = 0 left join part p on tr.stream_id = 'user:' || p_partkey and p_partkey % 3 <> 0)"""
_SHOWN = ["seq", "stream_id", "source", "type", "title", "subtitle", "category", "classification", "added", "deleted", "modified", "vote_event_id"]


@query(_sql(f"{_TL} select {', '.join(_SHOWN)} from tl where classification = 'substantive' and seq < 900 order by seq desc limit 51"))
def timeline_page_older(spark, sf):
    return timeline.page(_timeline(spark, sf), token="older:900", n=50, classification="substantive").select(*_SHOWN)


@query(_sql(f"{_TL} select {', '.join(_SHOWN)} from tl where type = 'changed' and seq > 100 order by seq limit 31"))
def timeline_page_newer(spark, sf):
    return timeline.page(_timeline(spark, sf), token="newer:100", n=30, event_type="changed").select(*_SHOWN)


@query(_sql(f"{_TL} select {', '.join(_SHOWN)} from tl where source = 'user' and (contains(lower(title), 'ar') or contains(lower(subtitle), 'ar') or contains(lower(category), 'ar') or contains(lower(stream_id), 'ar')) order by seq desc limit 201"))
def timeline_keyword(spark, sf):
    return timeline.page(_timeline(spark, sf), n=200, source="user", word="AR").select(*_SHOWN)


@query(_sql(f"{_TL}, n as (select seq from tl order by seq desc limit 10000) select count(*)::bigint as total, (count(*) filter (seq >= 700))::bigint as above, ((count(*) filter (seq >= 700)) // 50 + 1)::bigint as page from n"))
def timeline_count_capped(spark, sf):
    return timeline.count(_timeline(spark, sf), cursor=700, n=50)


@query("""with p as (select p_partkey, p_name || case p_partkey % 4 when 0 then ' 100%' when 1 then ' 100_' when 2 then ' 100\\' else '' end as name from part),
  k as (select unnest(['100%', '100_', '100\\', '100']) as word) select word, count(*)::bigint as n from k join p on contains(lower(name), word) group by word""")
def keyword_literal(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" 100%", " 100_", " 100\\", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = _t(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("name"))
    counts = [paging.keyword(parts, ["name"], w).agg(F.lit(w).alias("word"), F.count(F.lit(1)).alias("n")) for w in ("100%", "100_", "100\\", "100")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as trees: lines are articles, their sentences paragraphs."""
    line = _t(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    part = line.select("doc_id", "source", "i", "line", F.posexplode(F.split("line", r"\. ")).alias("j", "sentence"))
    eid = F.format_string("art_%d__para_%d", F.col("i") + 1, F.col("j") + 1)
    return part.select("doc_id", "source", eid.alias("eid"), F.format_string("art_%d", F.col("i") + 1).alias("parent_eid"), (F.col("i") * 10000 + F.col("j")).cast("long").alias("ordinal"), F.trim("sentence").alias("sentence_text"))


_LINES = """lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
 nodes as (select doc_id, source, i, unnest(string_split(line, '. ')) as s, generate_subscripts(string_split(line, '. '), 1) as j from lines),
 tree as (select doc_id, source, 'art_' || i || '__para_' || j as eid, 'art_' || i as parent_eid, ((i - 1) * 10000 + j - 1)::bigint as ordinal, trim(s) as sentence_text from nodes)"""


@query(f"with {_LINES} select doc_id, eid, parent_eid, ordinal, sentence_text from tree")
def line_tree(spark, sf):
    return _lines(spark, sf).drop("source")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the one before it in its source."""

    tree = _lines(spark, sf)
    docs = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("before")).where("before is not null")
    node = [F.lit("paragraph").alias("node_type"), F.lit("1").alias("num"), F.lit("").alias("caption")]
    prev = docs.join(tree, docs["before"] == tree["doc_id"]).select(docs["doc_id"].alias("change_id"), "eid", "parent_eid", "ordinal", "sentence_text", *node)
    curr = docs.select(F.col("doc_id").alias("change_id")).join(tree, F.col("change_id") == tree["doc_id"]).select("change_id", "eid", "parent_eid", "ordinal", "sentence_text", *node)
    return docs.select(F.col("doc_id").alias("change_id")), diff.node_changes(prev, curr)


_DIFF = f"""with {_LINES}, docs as (select doc_id, lag(doc_id) over (partition by source order by doc_id) as before from documents where text is not null),
 p as (select d.doc_id as change_id, t.* exclude (doc_id, source) from docs d join tree t on d.before = t.doc_id), c as (select d.doc_id as change_id, t.* exclude (doc_id, source) from docs d join tree t on d.doc_id = t.doc_id where d.before is not null),
 x as (select coalesce(c.change_id, p.change_id) as change_id, coalesce(c.eid, p.eid) as eid, case when p.eid is null then 'added' when c.eid is null then 'deleted' when p.sentence_text <> c.sentence_text then 'modified' end as op,
   coalesce(p.sentence_text, '') as prev_text, coalesce(c.sentence_text, '') as curr_text from p full outer join c on p.change_id = c.change_id and p.eid = c.eid)"""


@query(f"{_DIFF} select change_id, eid, op, prev_text, curr_text from x where op is not null")
def revision_diff(spark, sf):
    return _changes(spark, sf)[1].where("op is not null").select("change_id", "eid", "op", "prev_text", "curr_text")


@query(f"""{_DIFF}, r as (select change_id, (count(*) filter (op = 'added'))::bigint as added, (count(*) filter (op = 'deleted'))::bigint as deleted, (count(*) filter (op = 'modified'))::bigint as modified,
   bool_or(case op when 'added' then curr_text <> '' when 'deleted' then prev_text <> '' else op = 'modified' end) as n from x where op is not null group by change_id)
 select d.doc_id as change_id, coalesce(added, 0)::bigint as added, coalesce(deleted, 0)::bigint as deleted, coalesce(modified, 0)::bigint as modified,
  case when n then 'substantive' else 'administrative' end as classification, case when n or added is null then 'high' else 'medium' end as class_confidence
 from docs d left join r on r.change_id = d.doc_id where d.before is not null""")
def revision_class(spark, sf):
    events, changes = _changes(spark, sf)
    return diff.change_records(events.withColumn("degraded", F.lit(False)), changes).select("change_id", "added", "deleted", "modified", "classification", "class_confidence")


@query("select conv_id, turn, role, text from conversations where conv_id = 1 order by turn")
def meeting_detail(spark, sf):
    talk = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("issue_id"), F.col("turn").alias("speech_order"), F.col("role").alias("speaker"), "text")
    heads = talk.select("issue_id", F.lit("").alias("name"), F.lit("").alias("house"), F.lit("").alias("date")).distinct()
    found = lookups.get_meeting(heads, talk, "1")
    return found.select(F.col("issue_id").cast("long").alias("conv_id"), F.col("speech_order").alias("turn"), F.col("speaker").alias("role"), "text")


@query("select conv_id, count(*)::bigint as turns from conversations group by conv_id order by turns desc, conv_id limit 51 offset 20")
def meeting_list(spark, sf):
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return paging.offset_page(rows, [F.desc("turns"), F.col("conv_id")], token="20", n=50)


@query("select c_custkey, 'p:' || substr(sha256(regexp_replace(c_name, '\\s+', '', 'g') || chr(10) || case when c_custkey % 2 = 0 then c_mktsegment else '' end), 1, 16) as person_id, case when c_custkey % 2 = 0 then 'high' else 'medium' end as identity_confidence from customer")
def person_identity(spark, sf):
    reading = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return _t(spark, sf, "customer").select("c_custkey", C.person_id(F.col("c_name"), reading).alias("person_id"), C.identity_confidence(F.col("c_name"), reading).alias("identity_confidence"))


@query("""select 'p:' || substr(sha256(regexp_replace(role, '\\s+', '', 'g') || chr(10)), 1, 16) as person_id, 'o:' || substr(sha256('g' || conv_id % 7), 1, 16) as org_id,
  min(conv_id)::bigint as first_seq, max(conv_id)::bigint as last_seq from conversations where role is not null and role <> '' group by 1, 2""")
def membership_span(spark, sf):
    talk = _t(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("issue_id"), F.col("conv_id").alias("seq"), F.col("turn").alias("speech_order"), F.col("role").alias("speaker"), F.lit("").alias("speaker_yomi"),
        F.concat(F.lit("g"), (F.col("conv_id") % 7).cast("string")).alias("speaker_group"),
    )
    return people.memberships(talk).drop("role")


@query("""with o as (select o_custkey, (count(*) filter (o_orderstatus = 'F'))::int as yes, (count(*) filter (o_orderstatus = 'O'))::int as no, count(*)::int as n from orders group by o_custkey)
 select 'c' || o_custkey as issue_id, 'c' || o_custkey || '#1' as vote_event_id, yes as yes_count, no as no_count, case when yes > no then 'passed' else 'rejected' end as result,
  case when n <> yes + no then 'low' when yes = 0 and no = 0 then 'high' else 'medium' end as confidence from o""")
def recorded_votes(spark, sf):
    counts = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("yes"), F.count_if(F.col("o_orderstatus") == "O").alias("no"), F.count(F.lit(1)).alias("n"))
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    text = F.format_string("投票総数　%d\n賛成 %s\n反対 %d", "n", F.translate(F.col("yes").cast("string"), C.DIGITS, C.FULL_DIGITS), "no")
    found = votes.recorded_votes(counts.select(key.alias("issue_id"), key.alias("speech_id"), F.lit(1).alias("speech_order"), text.alias("text")))
    return found.select("issue_id", "vote_event_id", "yes_count", "no_count", "result", "confidence")


def _cast(spark: SparkSession, sf: str) -> DataFrame:
    option = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("abstain")
    return _t(spark, sf, "orders").select(F.concat(F.lit("v"), (F.col("o_orderkey") % 5).cast("string")).alias("vote_event_id"), "o_orderkey", F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name_key"), option.alias("option"), F.col("o_orderkey").cast("string").alias("voter_name"))


def _seats(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a balance above zero sit for their nation; those of region 0 by list."""
    nation = _t(spark, sf, "nation")
    rows = _t(spark, sf, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    is_list = F.col("n_regionkey") == 0
    code = F.when(F.col("n_nationkey") == 7, "7,8").otherwise(F.col("n_nationkey").cast("string"))
    return rows.select(
        F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name_key"), F.col("c_name").alias("name"), F.lit("councillors").alias("house"), is_list.alias("is_pr"), F.when(is_list, "全国").alias("pr_block"),
        F.when(~is_list, code).alias("district_code"), F.when(~is_list, F.col("n_name")).alias("district_name"), F.col("c_mktsegment").alias("parliamentary_group"),
    )


_MAP = """with cast_ as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 'yes' when 'O' then 'no' else 'abstain' end as option from orders where o_orderkey % 5 = 1),
 seats as (select c_custkey, c_name, c_mktsegment, n_regionkey = 0 as is_pr, case when n_nationkey = 7 then '7,8' else n_nationkey::varchar end as district_code, n_name as district_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0),
 tally as (select district_code, district_name, (count(*) filter (option = 'yes'))::bigint as yes, (count(*) filter (option = 'no'))::bigint as no, (count(*) filter (option = 'abstain'))::bigint as abstain from cast_ join seats on o_custkey = c_custkey where not is_pr group by 1, 2)"""
_CATEGORY = "case when yes > 0 and no > 0 then 'split' when yes > 0 then 'yes' when no > 0 then 'no' else 'none' end as category"


@query(f"{_MAP} select *, {_CATEGORY} from tally order by district_code")
def vote_map(spark, sf):
    return lookups.get_vote_map(_cast(spark, sf), _seats(spark, sf), "v1")["tally"]


@query(f"{_MAP} select count(*)::bigint as total, count(c_custkey)::bigint as matched, count(c_custkey)::bigint as matched_votes from cast_ left join seats on o_custkey = c_custkey")
def vote_coverage(spark, sf):
    return lookups.get_vote_map(_cast(spark, sf), _seats(spark, sf), "v1")["coverage"]


@query(f"{_MAP} select o_orderkey::varchar as voter_name, option, c_name as name, '全国' as pr_block, c_mktsegment as parliamentary_group from cast_ join seats on o_custkey = c_custkey where is_pr")
def pr_panel(spark, sf):
    return lookups.get_vote_map(_cast(spark, sf), _seats(spark, sf), "v1")["panel"].select("voter_name", "option", "name", "pr_block", "parliamentary_group")


@query(f"{_MAP} select unnest(string_split(district_code, ',')) as code, district_name, {_CATEGORY} from tally")
def district_category(spark, sf):
    tally = lookups.get_vote_map(_cast(spark, sf), _seats(spark, sf), "v1")["tally"].drop("category")
    return votes.map_codes(tally).select("code", "district_name", "category")


@query("""with cast_ as (select 'v' || o_orderkey % 5 as vote_event_id, o_custkey, case o_orderstatus when 'F' then 'yes' when 'O' then 'no' else 'abstain' end as option from orders),
 seats as (select c_custkey, case when n_nationkey = 7 then '7,8' else n_nationkey::varchar end as district_code, n_name as district_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 and n_regionkey <> 0)
 select vote_event_id, district_code, district_name, (count(*) filter (option = 'yes'))::bigint as yes, (count(*) filter (option = 'no'))::bigint as no, (count(*) filter (option = 'abstain'))::bigint as abstain from cast_ join seats on o_custkey = c_custkey group by 1, 2, 3""")
def vote_tallies(spark, sf):
    """The tally of every vote event."""
    return votes.tally(_cast(spark, sf), _seats(spark, sf), by=("vote_event_id",))


def _record(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    persons = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 5000, "high").otherwise("medium").alias("identity_confidence"))
    orders = _t(spark, sf, "orders")
    cast = orders.select(F.col("o_orderkey").cast("string").alias("vote_event_id"), F.col("o_orderkey").cast("string").alias("issue_id"), F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderstatus").alias("option"))
    events = orders.select(F.col("o_orderkey").cast("string").alias("vote_event_id"), F.col("o_orderkey").cast("string").alias("issue_id"), F.col("o_orderpriority").alias("motion"), F.col("o_orderstatus").alias("result"))
    meetings = orders.select(F.col("o_orderkey").cast("string").alias("issue_id"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("session"), F.col("o_orderpriority").alias("house"))
    return persons, cast, events, meetings


_RECORD = """select c_custkey::varchar as person_id, c_name as name, case when c_acctbal > 5000 then 'high' else 'medium' end as identity_confidence, o.o_orderkey::varchar as vote_event_id, o_orderstatus as option
 from customer left join orders o on o_custkey = c_custkey and c_acctbal > 5000 where c_custkey in ({0}) order by person_id, o_orderdate desc nulls last, vote_event_id"""
_WHO = (1, 4, 7, 10, 13)


@query(_RECORD.format(", ".join(map(str, _WHO))))
def legislator_votes(spark, sf):
    persons, cast, events, meetings = _record(spark, sf)
    own = F.col("person_id").isin([str(w) for w in _WHO])
    return lookups.legislator_records(persons.where(own), cast.where(own), events, meetings).select("person_id", "name", "identity_confidence", "vote_event_id", "option")


@query("""select c_custkey::varchar as person_id, c_name as name, case when c_acctbal > 5000 then 'high' else 'medium' end as identity_confidence, o.o_orderkey::varchar as vote_event_id, o_orderstatus as option
 from customer left join orders o on o_custkey = c_custkey and c_acctbal > 5000""")
def legislator_records(spark, sf):
    """The record of every person."""
    return lookups.legislator_records(*_record(spark, sf)).select("person_id", "name", "identity_confidence", "vote_event_id", "option")


@query("""select o_orderkey::varchar as vote_event_id, o_orderdate::date::varchar as date, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as has_named_votes
 from orders where year(o_orderdate) = (select max(year(o_orderdate)) from orders) order by date desc, vote_event_id limit 51""")
def vote_event_list(spark, sf):
    _, _, events, meetings = _record(spark, sf)
    named = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("vote_event_id"))
    return lookups.list_vote_events(events, named, meetings, n=50).select("vote_event_id", F.col("date").cast("string").alias("date"), "has_named_votes")


_TITLE = "trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"


@query(f"select page_id, {_TITLE} as title from pages where regexp_matches(html, '(?s)<title>.*?</title>')")
def roll_call_pages(spark, sf):
    pages = _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("stream_id"), F.col("page_id").alias("seq"), F.col("html").cast("binary").alias("payload"))
    return payloads.page_parts(pages).where("kind = 'title'").select(F.col("seq").alias("page_id"), F.col("cells")[0].alias("title"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def upsert_latest(spark, sf):
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return folds.merged(orders.where("o_orderkey % 2 = 0"), orders, "o_custkey", "o_orderkey")


@query("select l_suppkey, min(l_orderkey)::bigint as first_seq, max(l_orderkey)::bigint as last_seq from lineitem group by l_suppkey")
def span_merge(spark, sf):
    return folds.spans(_t(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag"], "l_orderkey").drop("l_returnflag")


@query("select true as equal, count(distinct o_custkey)::bigint as n from orders")
def replay_equals_incremental(spark, sf):
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    whole = folds.fingerprint(folds.latest(orders, "o_custkey", "o_orderkey"))
    first = folds.merged(None, orders.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderkey")
    parts = folds.fingerprint(folds.merged(first, orders.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey"))
    return whole.alias("a").crossJoin(parts.alias("b")).select((F.col("a.digest") == F.col("b.digest")).alias("equal"), F.col("a.n").alias("n"))  # one row each


@query("""select 'positive_value' as rule, (count(*) filter (not (value > 0)))::bigint as violations from events union all
 select 'known_type', (count(*) filter (not (event_type in ('signup', 'purchase', 'view', 'click'))))::bigint from events union all
 select 'one_signup', count(*)::bigint from (select user_id, event_type from events group by 1, 2 having count(*) > 1)""")
def dq_report(spark, sf):
    own = {"positive_value": "value > 0", "known_type": "event_type in ('signup', 'purchase', 'view', 'click')"}
    return rules.violations(_t(spark, sf, "events"), own, {"one_signup": ["user_id", "event_type"]})


def _polls(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("ok")
    return _observations(spark, sf).select("stream_id", F.col("ts").alias("at"), outcome.alias("outcome"))


_POLLS = """with p as (select concat('user:', user_id) as stream_id, ts as t, case event_type when 'error' then 'failed' when 'view' then 'pending' else 'ok' end as outcome from events),
 h as (select p.stream_id, (count(*) filter (outcome = 'failed' and (last_ok is null or t > last_ok)))::bigint as failures, max(t) as last_at, max_by(outcome, t) as last_outcome
  from p left join (select stream_id, max(t) as last_ok from p where outcome = 'ok' group by 1) g using (stream_id) group by p.stream_id),
 q as (select stream_id, failures, last_at + interval 1 day as next_due, case when last_outcome = 'failed' then last_at + interval 1 hour end as backoff_until from h)"""


@query(f"{_POLLS} select * from q")
def poll_health(spark, sf):
    return observe.poll_health(_polls(spark, sf)).drop("last_at")


@query(f"""{_POLLS}, n as (select max(ts) + interval 6 hour as now from events), w as (select concat('user:', c_custkey) as stream_id from customer where c_custkey % 2 = 0)
 select w.stream_id, next_due from w left join q using (stream_id) cross join n where (next_due is null or next_due <= now) and (backoff_until is null or backoff_until <= now) order by next_due nulls first, stream_id limit 40""")
def stale_worklist(spark, sf):
    watch = _t(spark, sf, "customer").where("c_custkey % 2 = 0").select(C.stream_id(F.lit("user"), F.col("c_custkey").cast("string")).alias("stream_id"), F.lit(True).alias("enabled"))
    now = _t(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 6 HOURS")).alias("now"))
    health = observe.poll_health(_polls(spark, sf))
    watched = watch.crossJoin(F.broadcast(now))  # one row
    return observe.stalest(watched, health, F.col("now"), 40).select("stream_id", "next_due")


@query(f"""{_POLLS}, n as (select max(ts) + interval 6 hour as now from events), w as (select concat('user:', c_custkey) as stream_id, c_acctbal > 0 as enabled from customer)
 select w.stream_id, next_due from w left join q using (stream_id) cross join n where enabled and (next_due is null or next_due <= now) and (backoff_until is null or backoff_until <= now) order by next_due nulls first, stream_id limit 40""")
def stalest_of_all(spark, sf):
    """The streams of the whole watch list that have waited longest."""
    watch = _t(spark, sf, "customer").select(C.stream_id(F.lit("user"), F.col("c_custkey").cast("string")).alias("stream_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    now = _t(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 6 HOURS")).alias("now"))
    return observe.stalest(watch.crossJoin(F.broadcast(now)), observe.poll_health(_polls(spark, sf)), F.col("now"), 40).select("stream_id", "next_due")  # one row of now


@query(_sql("select stream_id, event_id, type, content_hash, prev_content_hash from tr"))
def stream_transitions(spark, sf):
    """The same events from the stateful stream, run over all that is there."""
    path = shared_folder(spark, "stream")
    rows = _observations(spark, sf).select("stream_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "content_hash")
    rows.write.parquet(f"{path}/in")
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, rocks)
    try:
        found = stream_folds.transitions(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        run = found.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream_folds.EVENT).parquet(f"{path}/out").select("stream_id", "event_id", "type", "content_hash", "prev_content_hash")
