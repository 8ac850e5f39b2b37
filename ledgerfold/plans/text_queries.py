"""Registered queries over texts that are made from the tables: pages, listings, laws,
minutes and rosters in the shapes that the sources have, and the columns read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diff, people, votes
from ..sources import lawtree, payloads
from . import lookups, readmodels
from .driver_queries import _t, query


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("string"))


def _text(*parts: str | Column) -> Column:
    """Texts end to end; strings that start with ``=`` are columns."""
    made = [F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("=") else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*made)


@query("""select c_custkey, (c_custkey % 300)::int as session, make_date((2018 + c_custkey % 7 + 1)::int, (c_custkey % 12 + 1)::int, (c_custkey % 28 + 1)::int)::varchar as date, c_custkey::int as number,
 '甲党' || c_custkey % 9 as party, '予算案' || c_custkey as motion, case c_custkey % 3 when 0 then 'yes' when 1 then 'no' else 'abstain' end as option,
 '岸本' || c_custkey as name_key, '岸 本' || c_custkey as display from customer""")
def heading_columns(spark, sf):
    """Session, date, number, party, motion and option of headings and cells in their usual spelling."""
    c = F.col("c_custkey")
    full = lambda x: F.translate(x.cast("string"), C.DIGITS, C.FULL_DIGITS)
    heading = F.concat(F.lit("第"), full(c % 300), F.lit("回国会　令和"), full(c % 7 + 1), F.lit("年"), (c % 12 + 1).cast("string"), F.lit("月"), full(c % 28 + 1), F.lit("日"))
    cells = [F.when(c % 3 == i, word).otherwise("") for i, word in ((0, "賛成"), (1, "反対"))]
    name = _text("岸　本", "=c_custkey", F.when(c % 2 == 0, "君").otherwise("さん"))
    return _t(spark, sf, "customer").select(
        "c_custkey", C.heading_session(heading).alias("session"), C.heading_date(heading).cast("string").alias("date"), C.heading_number(F.concat(F.lit("議席 "), full(c), F.lit("名"))).alias("number"),
        C.group_heading(F.concat(F.lit(" 甲党"), (c % 9).cast("string"), F.lit("（"), full(c % 40), F.lit("名）"))).alias("party"), C.motion_of_title(_text("予算案", "=c_custkey", "：採決の結果")).alias("motion"),
        C.vote_option(*cells).alias("option"), C.name_key(name).alias("name_key"), C.one_space(_text("  岸　本", "=c_custkey", " \n")).alias("display"),
    )


@query("select o_orderkey, (o_orderkey % 99999)::int as number from orders")
def kanji_numbers(spark, sf):
    """Numbers spelt in kanji and read again."""
    n = F.col("o_orderkey") % 99999
    digit = F.array(*map(F.lit, "〇一二三四五六七八九"))
    high, low = F.floor(n / 10000), n % 10000

    def spelt(x: Column, unit: int, mark: str) -> Column:
        d = (F.floor(x / unit) % 10).cast("int")
        return F.when(d == 0, "").when((d == 1) & F.lit(unit > 1), mark).otherwise(F.concat(digit[d], F.lit(mark)))

    below = F.concat(*[spelt(low, u, m) for u, m in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))])
    text = F.concat(F.when(high > 0, F.concat(digit[high.cast("int")], F.lit("万"))).otherwise(""), below)
    return _t(spark, sf, "orders").select("o_orderkey", C.number_token(F.when(text == "", "〇").otherwise(text)).alias("number"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else ((c_custkey % 47 + 1) * 100 + c_custkey % 9 + 1)::varchar end as lower_code, c_custkey % 3 = 0 as lower_pr,
 case when c_custkey % 5 = 0 then '31,32' when c_custkey % 5 = 1 then null else (c_custkey % 47 + 1)::varchar end as upper_code, c_custkey % 5 = 1 as upper_pr from customer""")
def district_codes(spark, sf):
    c = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, C.PREFECTURES)), (c % 47 + 1).cast("int"))
    lower = C.lower_house_district(F.when(c % 3 == 0, "（比）東海").otherwise(F.concat(name, F.translate((c % 9 + 1).cast("string"), C.DIGITS, C.FULL_DIGITS))))
    upper = C.upper_house_district(F.when(c % 5 == 0, "鳥取・島根").when(c % 5 == 1, "比例").otherwise(name))
    rows = _t(spark, sf, "customer").select("c_custkey", lower.alias("lower"), upper.alias("upper"))
    return rows.select("c_custkey", F.col("lower.code").alias("lower_code"), F.col("lower.is_pr").alias("lower_pr"), F.col("upper.code").alias("upper_code"), F.col("upper.is_pr").alias("upper_pr"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as enforced_on, strftime(o_orderdate + interval 9 hour, '%Y-%m-%d %H:%M') as shown, strftime(o_orderdate - interval 90 day, '%Y-%m-%d') as from_day, 91::int as days,
 'https://laws.e-gov.go.jp/law/L' || o_orderkey as url from orders""")
def law_columns(spark, sf):
    """Enforcement date of a revision id, local display time, look-back window, permalink."""
    day = F.to_date("o_orderdate")
    revision = F.concat_ws("_", F.lit("L"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("x"))
    window = C.look_back(day)
    return _t(spark, sf, "orders").select(
        "o_orderkey", C.enforcement_date(revision).cast("string").alias("enforced_on"), C.tokyo_time(F.col("o_orderdate").cast("timestamp")).alias("shown"), window[0].cast("string").alias("from_day"), F.size(window).alias("days"),
        C.law_link(_text("L", "=o_orderkey")).alias("url"),
    )


@query("select c_custkey, '{\"a\":' || c_custkey || ',\"b\":\"' || c_mktsegment || '\"}' as canonical, c_custkey % 2 = 1 as is_json from customer where c_custkey % 2 = 1 union all select c_custkey, null, false from customer where c_custkey % 2 = 0")
def canonical_values(spark, sf):
    """The same value written in another order and with spaces; broken text is none."""
    c = F.col("c_custkey")
    text = F.when(c % 2 == 1, _text('{ "b" : "', "=c_mktsegment", '", "a": ', "=c_custkey", "}")).otherwise("{broken")
    return _t(spark, sf, "customer").select("c_custkey", C.canonical_json(text).alias("canonical")).withColumn("is_json", F.col("canonical").isNotNull())


@query("select event_id, case event_id % 4 when 0 then 2 when 1 then 0 when 2 then 0 else 0 end::bigint as n, (event_id % 4 = 0)::bigint as added from events")
def guarded_changes(spark, sf):
    """Change records as JSON; what is no array, or no JSON, is an empty one."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, '{"node_changes":[{"op":"added","eid":"a"},{"op":"moved"}]}').when(k == 1, '{"node_changes":null}').when(k == 2, "no json").otherwise('{"node_changes":{"op":"added"}}')
    found = diff.guarded(text)
    return _t(spark, sf, "events").select("event_id", F.size(found).cast("long").alias("n"), diff.op_count(found, "added").alias("added"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages of ten meetings, which overlap."""
    rows = _t(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.floor(F.col("conv_id") / 10), F.floor(F.col("conv_id") / 7))).alias("page"))
    one = F.struct(F.col("conv_id").cast("string").alias("issueID"), _text("https://kokkai/", "=conv_id").alias("meetingURL"))
    return rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list(one).alias("meetingRecord"))).alias("payload"))


@query("select distinct 'kokkai:' || conv_id as stream_id, conv_id::varchar as local_key, 'https://kokkai/' || conv_id as url from conversations")
def listing_refs(spark, sf):
    return payloads.meeting_refs(_listing(spark, sf))


@query("select distinct 'kokkai:' || conv_id as stream_id, conv_id::varchar as local_key from conversations order by local_key limit 25")
def listing_refs_capped(spark, sf):
    return payloads.meeting_refs(_listing(spark, sf), limit=25).select("stream_id", "local_key")


@query("select distinct 'L' || o_custkey as law_id from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate < timestamp '1996-09-02' and o_orderstatus <> 'P'")
def updated_laws_window(spark, sf):
    """Update lists of a window of days, in four shapes; only what is in force."""
    one = F.struct(_text("L", "=o_custkey").alias("LawId"), F.when(F.col("o_orderstatus") == "P", "1").when(F.col("o_orderstatus") == "F", "0").otherwise("").alias("EnforcementFlg"))
    days = _t(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.to_json(F.collect_list(one)).alias("laws"))
    shape = F.pmod(F.datediff("day", F.lit("1990-01-01")), F.lit(4))
    payload = F.when(shape == 0, F.col("laws")).when(shape == 1, _text('{"result":{"LawList":', "=laws", "}}")).when(shape == 2, _text('{"ApplData":{"LawList":', "=laws", "}}")).otherwise(_text('{"laws":', "=laws", "}"))
    return payloads.updated_laws(days.select("day", payload.alias("payload")), "1995-03-01", "1996-09-01")


@query("select distinct c_custkey || '-1109-v' || lpad((c_custkey % 50)::varchar, 3, '0') as slug from customer")
def vote_slugs(spark, sf):
    slug = F.concat(F.col("k"), F.lit("-1109-v"), F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "0"))
    html = F.concat(F.lit('<a href="vote/'), slug, F.lit('.htm">a</a><a href="'), slug, F.lit('.htm">b</a><a href="index.htm">c</a>'))
    return payloads.vote_slugs(_customers(spark, sf).select(html.alias("html")))


def _log_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and snapshots of ``stream_id, seq, payload``."""
    made = rows.withColumn("content_hash", F.sha2("payload", 256)).withColumn("payload", F.col("payload").cast("binary"))
    events = made.select("stream_id", "seq", F.col("seq").alias("stream_seq"), "content_hash")
    return events, made.select("content_hash", "payload").dropDuplicates(["content_hash"])


@query("""with v as (select c_custkey, c_custkey || '-1109-v001' as id from customer)
 select id as vote_event_id, '岸本' || c_custkey as name_key, 'yes' as option, '甲党' as parliamentary_group from v union all
 select id, '佐藤' || c_custkey, 'no', '甲党' from v union all select id, '鈴木' || c_custkey, 'abstain', '乙党' from v""")
def roll_call_votes(spark, sf):
    """Votes of pages whose party headings carry on to the rows below them."""
    row = lambda a, b, name: f"<tr><td>{a}</td><td>{b}</td><td>{name}"
    page = _text(
        "<title>予算案：採決</title><h2>第198回国会 令和3年11月9日</h2><h4>甲党（２名）</h4>", row("賛成", "", "岸本　"), "=k", "君</td></tr>", row("", "反対", "佐藤"), "=k",
        "</td></tr><h4>乙党(1名)</h4>", row("", "", "鈴木"), "=k", "</td></tr>",
    )
    rows = _customers(spark, sf).select(_text("sangiin-vote:", "=k", "-1109-v001").alias("stream_id"), (F.col("c_custkey") + 1).alias("seq"), page.alias("payload"))
    return readmodels.roll_calls(*_log_of(rows))["vote"].select("vote_event_id", "name_key", "option", "parliamentary_group")


@query("""select c_custkey || '-1109-v001' as vote_event_id, '予算案' || c_custkey as motion, 198::int as session, '2021-11-09' as vote_date, (c_custkey % 90 + 1)::int as yes_count, (c_custkey % 40)::int as no_count from customer""")
def roll_call_events(spark, sf):
    c = F.col("c_custkey")
    page = _text("<title>予算案", "=k", "：結果</title><h2>第198回国会 令和3年11月9日</h2><h3>賛成票 ", c % 90 + 1, " 反対票 ", c % 40, "</h3>")
    rows = _customers(spark, sf).select(_text("sangiin-vote:", "=k", "-1109-v001").alias("stream_id"), (c + 1).alias("seq"), page.alias("payload"))
    found = readmodels.roll_calls(*_log_of(rows))["event"]
    return found.select("vote_event_id", "motion", "session", F.col("vote_date").cast("string").alias("vote_date"), "yes_count", "no_count")


@query("""select '岸本' || c_custkey as name_key, 'representatives' as house, ((c_custkey % 47 + 1) * 100 + 1)::varchar as district_code, '甲党' as parliamentary_group, 'high' as identity_confidence from customer union all
 select '鈴木' || c_custkey, 'councillors', (c_custkey % 47 + 1)::varchar, '乙党', 'medium' from customer""")
def roster_pages(spark, sf):
    """Seats of both houses' member pages: markup left open, header cells, rows that are none."""
    name = F.element_at(F.array(*map(F.lit, C.PREFECTURES)), (F.col("c_custkey") % 47 + 1).cast("int"))
    lower = F.concat(_text("<table><TR><TD>岸本　", "=k", "君<TD>きしもと<TD>甲党<TD>"), name, F.lit("１<TD>2</TR><TR><TD>x</TR></table>"))
    upper = F.concat(_text("<tr><th>ア</th><td>鈴木", "=k", "</td><td></td><td>乙党</td><td>"), name, F.lit("</td></tr><tr><td>x</td><td>y</td><td>z</td><td>どこ</td></tr>"))
    rows = _customers(spark, sf)
    pages = [rows.select(_text(f"{s}-roster:", "=k").alias("stream_id"), (F.col("c_custkey") + 1).alias("seq"), p.alias("payload")) for s, p in (("giin", lower), ("sangiin", upper))]
    return readmodels.rosters(*_log_of(pages[0].union(pages[1]))).select("name_key", "house", "district_code", "parliamentary_group", "identity_confidence")


def _meetings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as the minutes of meetings."""
    talk = _t(spark, sf, "conversations")
    speech = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("speechID"), F.col("turn").cast("int").alias("speechOrder"), F.col("role").alias("speaker"), F.lit("").alias("speakerYomi"), _text("党", F.col("conv_id") % 4).alias("speakerGroup"), F.coalesce("text", F.lit("")).alias("speech"),
    )
    one = F.struct(F.col("conv_id").cast("string").alias("issueID"), (F.col("conv_id") % 5 + 1).cast("int").alias("session"), F.lit("衆議院").alias("nameOfHouse"), F.lit("2021-11-09").alias("date"), F.col("speeches").alias("speechRecord"))
    held = talk.groupBy("conv_id").agg(F.collect_list(speech).alias("speeches"))
    return _log_of(held.select(_text("kokkai:", "=conv_id").alias("stream_id"), (F.col("conv_id") + 1).alias("seq"), F.to_json(F.struct(F.array(one).alias("meetingRecord"))).alias("payload")))


@query("select conv_id::varchar as issue_id, conv_id || '-' || turn as speech_id, turn::int as speech_order, coalesce(role, '') as speaker, coalesce(text, '') as text from conversations")
def minutes_speeches(spark, sf):
    found = readmodels.minutes(*_meetings(spark, sf))["speech"]
    return found.select("issue_id", "speech_id", "speech_order", F.coalesce("speaker", F.lit("")).alias("speaker"), "text")


@query("select conv_id::varchar as issue_id, (conv_id % 5 + 1)::int as session, '衆議院' as house, '2021-11-09' as date from (select distinct conv_id from conversations)")
def minutes_meetings(spark, sf):
    found = readmodels.minutes(*_meetings(spark, sf))["meeting"]
    return found.select("issue_id", "session", "house", F.col("date").cast("string").alias("date"))


@query("""select 'p:' || substr(sha256(regexp_replace(role, '\\s+', '', 'g') || chr(10)), 1, 16) as person_id, min(conv_id)::bigint + 1 as first_seq, max(conv_id)::bigint + 1 as last_seq from conversations where trim(coalesce(role, '')) <> '' group by 1""")
def minutes_people(spark, sf):
    return readmodels.minutes(*_meetings(spark, sf))["person"].select("person_id", "first_seq", "last_seq")


@query("""select 'o:' || substr(sha256('党' || conv_id % 4), 1, 16) as org_id, '党' || min(conv_id % 4) as name, min(conv_id)::bigint + 1 as first_seq, max(conv_id)::bigint + 1 as last_seq from conversations where trim(coalesce(role, '')) <> '' group by 1""")
def minutes_groups(spark, sf):
    return readmodels.minutes(*_meetings(spark, sf))["organization"].select("org_id", "name", "first_seq", "last_seq")


def _vote_speeches(spark: SparkSession, sf: str) -> DataFrame:
    """A recorded vote of three members in each customer's meeting; every third total is wrong."""
    total = F.when(F.col("c_custkey") % 3 == 0, "４").otherwise("三")
    names = F.when(F.col("c_custkey") % 3 == 1, _text("賛成者 甲", "=k", "君乙", "=k", "君\n反対者 丙", "=k", "君\n以上")).otherwise("")
    text = F.concat(F.lit("これより記名投票。投票総数 "), total, F.lit("\n賛成 ２ 反対 1\n予算案について\n"), names)
    return _customers(spark, sf).select(F.col("k").alias("issue_id"), _text("s", "=k").alias("speech_id"), F.lit(1).alias("speech_order"), text.alias("text"))


@query("select c_custkey || '#1' as vote_event_id, case c_custkey % 3 when 0 then 'low' else 'medium' end as confidence, '予算' as motion from customer where c_custkey % 3 <> 1")
def review_queue(spark, sf):
    return votes.review_queue(votes.recorded_votes(_vote_speeches(spark, sf))).select("vote_event_id", "confidence", "motion")


@query("""with v as (select c_custkey, c_custkey || '#1' as id from customer where c_custkey % 3 = 1), n as (select *, unnest([['甲', 'yes'], ['乙', 'yes'], ['丙', 'no']]) as x from v)
 select id as vote_event_id, x[1] || c_custkey as voter_name, x[2] as option, case when x[1] = '甲' then 'p:' || substr(sha256('甲' || c_custkey || chr(10)), 1, 16) end as person_id from n""")
def named_votes(spark, sf):
    """Names of a roster, cut at honorifics, met with the meeting's speakers."""
    cast = votes.named_votes(votes.recorded_votes(_vote_speeches(spark, sf)))
    talk = _customers(spark, sf).select(F.col("k").alias("issue_id"), F.col("c_custkey").alias("seq"), F.lit(1).alias("speech_order"), _text("甲", "=k", "君").alias("speaker"), F.lit("").alias("speaker_yomi"), F.lit("").alias("speaker_group"))
    return people.resolved(cast, talk).select("vote_event_id", "voter_name", "option", "person_id")


def _law_text(spark: SparkSession, sf: str) -> DataFrame:
    """A law of two articles for each part: whole, with a repeated number, with a subitem
    outside an item, or broken off."""
    k = F.col("p_partkey") % 4
    head = _text("<Law><LawNum>第", "=p_partkey", "号</LawNum><LawBody><LawTitle>", "=p_name", "</LawTitle><MainProvision>")
    first = _text('<Article Num="1"><ArticleCaption>', "=caption", "</ArticleCaption><Paragraph><ParagraphSentence><Sentence>", "=sentence", "</Sentence></ParagraphSentence>")
    inside = F.when(k == 2, '<Subitem1 Num="1"><Subitem1Sentence><Sentence>x</Sentence></Subitem1Sentence></Subitem1>').otherwise('<Item Num="1"><ItemSentence><Sentence>甲</Sentence></ItemSentence></Item>')
    second = F.concat(F.lit('</Paragraph></Article><Article Num="'), F.when(k == 1, "1").otherwise("2"), F.lit('"><ArticleTitle>削除</ArticleTitle></Article>'))
    end = F.when(k == 3, "</MainProv").otherwise("</MainProvision></LawBody></Law>")
    return _t(spark, sf, "part").withColumn("caption", F.lit("目的")).withColumn("sentence", F.col("p_type")).select("p_partkey", F.concat(head, first, inside, second, end).alias("payload"))


@query("""select p_partkey, p_name as title, e.eid, p_partkey % 4 <> 0 as degraded from part, lateral (select unnest(case p_partkey % 4 when 2 then ['art_1', 'art_1__para_1', 'art_2'] when 1 then ['art_1', 'art_1__para_1', 'art_1__para_1__item_1', 'art_1~2'] else ['art_1', 'art_1__para_1', 'art_1__para_1__item_1', 'art_2'] end) as eid) e""")
def law_trees(spark, sf):
    """Nodes of law texts; of a text that breaks off, what was read stays."""
    rows = _law_text(spark, sf).select("p_partkey", F.sha2("payload", 256).alias("content_hash"), F.col("payload").cast("binary").alias("payload"))
    nodes = lawtree.law_nodes(rows.select("content_hash", "payload"))
    return rows.select("p_partkey", "content_hash").join(nodes, "content_hash").select("p_partkey", "title", "eid", "degraded")


@query("""select p_partkey::bigint as change_id, case p_partkey % 3 when 0 then 'substantive' else 'administrative' end as classification, case when p_partkey % 5 = 0 then 'low' else 'high' end as class_confidence, (p_partkey % 3 = 0)::bigint as modified from part""")
def law_changes_classed(spark, sf):
    """Two versions of each law: another sentence, another caption only, or other spacing;
    some versions repeat an article's number and are uncertain."""
    c = F.col("p_partkey")
    text = lambda caption, sentence, num: _text('<Law><LawBody><MainProvision><Article Num="1"><ArticleCaption>', caption, "</ArticleCaption><Paragraph><ParagraphSentence><Sentence>", sentence, '</Sentence></ParagraphSentence></Paragraph></Article><Article Num="', num, '"><ArticleTitle>削除', "=p_partkey", "</ArticleTitle></Article></MainProvision></LawBody></Law>")
    num = F.when(c % 5 == 0, "1").otherwise("2")
    old, new = text("目的", "旧", num), F.concat(text(F.when(c % 3 == 1, "趣旨").otherwise("目的"), F.when(c % 3 == 0, "新").otherwise("旧"), num), F.lit(" "))
    parts = _t(spark, sf, "part").where("p_partkey is not null")
    rows = parts.select(_text("egov-law:", "=p_partkey").alias("stream_id"), (c + 1_000_000_000).alias("seq"), old.alias("payload")).union(parts.select(_text("egov-law:", "=p_partkey"), c + 2_000_000_000, new))
    found = readmodels.changes(*_log_of(rows))
    return found.select((F.col("change_id") - 2_000_000_000).alias("change_id"), "classification", "class_confidence", "modified")


@query("select conv_id::varchar as issue_id, (conv_id % 5 + 1)::int as session, case when conv_id % 7 = 0 then null else (date '2020-01-01' + (conv_id % 100)::int)::varchar end as date from (select distinct conv_id from conversations) where conv_id % 5 = 2 and conv_id % 2 = 0 order by date desc nulls last, issue_id limit 41 offset 5")
def meeting_pages(spark, sf):
    """Meetings of a session and house, dated ones first."""
    c = F.col("conv_id")
    rows = _t(spark, sf, "conversations").select("conv_id").distinct().select(c.cast("string").alias("issue_id"), (c % 5 + 1).cast("int").alias("session"), F.when(c % 2 == 0, "a").otherwise("b").alias("house"), F.when(c % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (c % 100).cast("int"))).alias("date"))
    return lookups.list_meetings(rows, session=3, house="a", n=40, token="5").select("issue_id", "session", F.col("date").cast("string").alias("date"))


@query("""select o_orderkey::varchar as vote_event_id, l_suppkey::varchar as person_id, l_returnflag as option, s_name as district_name, coalesce(s_acctbal < 0, false) as is_pr
 from orders left join lineitem on l_orderkey = o_orderkey left join supplier on l_suppkey = s_suppkey and s_acctbal > -500""")
def vote_event_bindings(spark, sf):
    """Every vote of every event with the voter's district."""
    events, cast, meetings, seats = _bindings(spark, sf)
    return lookups.vote_event_rows(events, cast, meetings, seats).select("vote_event_id", "person_id", "option", "district_name", F.coalesce("is_pr", F.lit(False)).alias("is_pr"))


def _bindings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders, key = _t(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    events = orders.select(key.alias("vote_event_id"), key.alias("issue_id"), F.col("o_orderpriority").alias("motion"))
    meetings = orders.select(key.alias("issue_id"), F.lit("m").alias("name"), F.to_date("o_orderdate").alias("date"))
    cast = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("vote_event_id"), F.col("l_suppkey").cast("string").alias("person_id"), F.col("l_returnflag").alias("option"), F.col("l_linenumber").cast("string").alias("voter_name"))
    seats = _t(spark, sf, "supplier").where("s_acctbal > -500").select(F.col("s_suppkey").cast("string").alias("person_id"), F.col("s_nationkey").cast("string").alias("district_code"), F.col("s_name").alias("district_name"), (F.col("s_acctbal") < 0).alias("is_pr"))
    return events, cast, meetings, seats


@query("""select l_suppkey::varchar as person_id, l_returnflag as option, l_linenumber::varchar as voter_name, o_orderpriority as motion from lineitem join orders on l_orderkey = o_orderkey where o_orderkey = (select min(l_orderkey) from lineitem)""")
def vote_event_detail(spark, sf):
    """One event with its meeting and votes, by its id."""
    first = _t(spark, sf, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return lookups.get_vote_event(*_bindings(spark, sf), str(first)).select("person_id", "option", "voter_name", "motion")


def _laws(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("p_partkey")
    return _t(spark, sf, "part").select(c.cast("string").alias("law_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("law_num"), F.col("p_type").alias("law_type"), F.when(c % 6 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (c % 400).cast("int"))).alias("enforced_on"))


@query("select p_partkey::varchar as law_id, p_name as title, case when p_partkey % 6 <> 0 then (date '2001-01-01' + (p_partkey % 400)::int)::varchar end as enforced_on from part where p_type = 'ECONOMY' order by enforced_on desc nulls last, law_id limit 151")
def law_list(spark, sf):
    return lookups.list_laws(_laws(spark, sf), law_type="ECONOMY", n=150).select("law_id", "title", F.col("enforced_on").cast("string").alias("enforced_on"))


@query("select '7' as law_id, (select p_name from part where p_partkey = 7) as title, l_linenumber::int as ordinal, l_orderkey from lineitem where l_partkey = 7")
def law_detail(spark, sf):
    nodes = _t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("law_id"), F.col("l_linenumber").alias("ordinal"), "l_orderkey")
    return lookups.get_law(_laws(spark, sf), nodes, "7").select("law_id", "title", "ordinal", "l_orderkey")


@query("select event_id as change_id, case when event_id % 2 = 0 then 'substantive' else 'administrative' end as classification from events where user_id = (select min(user_id) from events) and event_type <> 'click' order by change_id desc limit 51")
def law_change_list(spark, sf):
    """Changes of one law, newest first, by the log's sequence."""
    events = _t(spark, sf, "events")
    who = events.agg(F.min("user_id")).first()[0]
    log = events.select(F.col("event_id").alias("seq"), C.stream_id(F.lit("egov-law"), F.col("user_id").cast("string")).alias("stream_id"), F.col("ts").cast("timestamp").alias("observed_at"))
    changes = events.where("event_type <> 'click'").select(F.col("event_id").alias("change_id"), F.when(F.col("event_id") % 2 == 0, "substantive").otherwise("administrative").alias("classification"))
    return lookups.get_law_changes(changes, log, str(who)).select("change_id", "classification")


@query("select o_orderkey::varchar as vote_event_id, o_orderdate::date::varchar as vote_date from orders where year(o_orderdate) = (select max(year(o_orderdate)) from orders) order by vote_date desc nulls last, vote_event_id limit 31 offset 3")
def roll_call_list(spark, sf):
    events = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("vote_event_id"), F.to_date("o_orderdate").alias("vote_date"), F.year("o_orderdate").alias("session"))
    return lookups.list_roll_calls(events, n=30, token="3").select("vote_event_id", F.col("vote_date").cast("string").alias("vote_date"))


@query("select c_custkey, 'kokkai' as source, 'kokkai:' || c_custkey as stream_id, 'u/' || c_custkey as permalink, sha256(c_name) as content_hash from customer where c_custkey % 2 = 0 union all select c_custkey, 'egov-law', 'egov-law:' || c_custkey, 'https://laws.e-gov.go.jp/law/' || c_custkey, sha256(c_name) from customer where c_custkey % 2 = 1")
def attribution(spark, sf):
    """Where each row comes from: its event, and the link of its source."""
    rows = _customers(spark, sf)
    stream = F.when(F.col("c_custkey") % 2 == 0, _text("kokkai:", "=k")).otherwise(_text("egov-law:", "=k"))
    log = rows.select(F.col("c_custkey").alias("seq"), stream.alias("stream_id"), F.lit("2026-01-01").cast("timestamp").alias("observed_at"), F.sha2("c_name", 256).alias("content_hash"), F.lit("").alias("log_hash"))
    watch = rows.where("c_custkey % 2 = 0").select(stream.alias("stream_id"), _text("u/", "=k").alias("url"))
    found = lookups.attributed(rows.select("c_custkey", F.col("c_custkey").alias("seq")), log, watch)
    return found.select("c_custkey", *[F.col(f"attribution.{x}").alias(x) for x in ("source", "stream_id", "permalink", "content_hash")])


@query("select event_id as seq, 'user:' || user_id as stream_id, event_type || '|' || coalesce(props, '') as text from events where event_id > 40 and 'user:' || user_id like 'user:1%' and event_type <> 'error'")
def log_scan_of_source(spark, sf):
    """Events of one source after an offset, with their contents."""
    own = F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))
    rows = _t(spark, sf, "events").withColumn("text", own).withColumn("content_hash", F.when(F.col("event_type") != "error", F.sha2("text", 256)))
    events = rows.select(F.col("event_id").alias("seq"), C.stream_id(F.lit("user"), F.col("user_id").cast("string")).alias("stream_id"), "content_hash")
    snapshots = rows.where("content_hash is not null").select("content_hash", F.col("text").cast("binary").alias("payload")).dropDuplicates(["content_hash"])
    return readmodels.log_scan(events, snapshots, after=40, prefix="user:1").select("seq", "stream_id", F.col("payload").cast("string").alias("text"))
