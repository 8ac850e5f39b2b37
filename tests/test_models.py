import gzip
import json

from pyspark.sql import functions as F

from ledgerfold.operators import diff, folds, paging, people, rules, votes
from ledgerfold.plans import lookups, readmodels
from ledgerfold.sources import lawtree, payloads

LAW = """<Law Era="Showa"><LawNum>第一号</LawNum><LawBody><LawTitle Kana="みほんほう">見本法</LawTitle><MainProvision>
<Chapter Num="1"><Article Num="1"><ArticleCaption>（目的）</ArticleCaption><ArticleTitle>第一条</ArticleTitle><Paragraph Num="1"><ParagraphSentence><Sentence>この<Ruby>法<Rt>ほう</Rt></Ruby>は{0}。</Sentence><Sentence>次。</Sentence></ParagraphSentence>
<Item Num="1"><ItemTitle>一</ItemTitle><ItemSentence><Column><Sentence>語</Sentence></Column><Column><Sentence>意味</Sentence></Column></ItemSentence><Subitem1 Num="1"><Subitem1Sentence><Sentence>イの文</Sentence></Subitem1Sentence></Subitem1></Item></Paragraph></Article></Chapter>
<Article Num="2"><ArticleTitle>第二条　削除</ArticleTitle></Article>{1}</MainProvision><SupplProvision><Article Num="1"><Paragraph><ParagraphSentence><Sentence>附則。</Sentence></ParagraphSentence></Paragraph></Article><Paragraph Num="1"/></SupplProvision></LawBody></Law>"""
IDS = ["art_1", "art_1__para_1", "art_1__para_1__item_1", "art_1__para_1__item_1__subitem1_1", "art_2", "suppl_1__art_1", "suppl_1__art_1__para_1"]


def law(text="見本", more=""):
    return bytearray(LAW.format(text, more).encode())


def test_law_tree():
    head, tree = lawtree.parse(bytes(law()))
    assert head == ("第一号", "見本法", "みほんほう") and [r[0] for r in tree.rows] == IDS and not tree.degraded and tree.loose == 1
    by = {r[0]: r for r in tree.rows}
    assert by["art_1__para_1"][8] == "この法ほうは見本。　次。" and by["art_1__para_1__item_1"][8] == "語　意味" and by["art_2"][8] == "第二条　削除"
    assert by["art_1"][5] == "1" and by["suppl_1__art_1"][7] is True and [r[9] for r in tree.rows] == list(range(7))
    _, again = lawtree.parse(bytes(law(more='<Article Num="2"><ArticleTitle>再</ArticleTitle></Article>')))
    assert "art_2~2" in {r[0] for r in again.rows} and again.degraded


def log(spark, rows):
    events = spark.createDataFrame([(i, s, i, h) for i, (s, h, _) in enumerate(rows, 1)], "seq long, stream_id string, stream_seq long, content_hash string")
    blobs = spark.createDataFrame([(h, p) for h, p in {h: p for _, h, p in rows if h}.items()], "content_hash string, payload binary")
    return events, blobs


def test_law_models_and_changes(spark):
    rows = [("egov-law:A", "h1", law()), ("egov-law:A", "h2", law("改正")), ("egov-law:A", None, None), ("egov-law:A", "h3", law("改正").replace("（目的）".encode(), "（趣旨）".encode())), ("egov-law:B", "bad", bytearray(b"<x"))]
    events, blobs = log(spark, rows)
    records = {r.change_id: r for r in readmodels.changes(events, blobs).collect()}
    assert set(records) == {2, 4}
    assert records[2].classification == "substantive" and records[2].class_confidence == "high" and records[2].modified == 1 and records[2].node_changes[0].eid == "art_1__para_1"
    assert records[4].classification == "administrative" and records[4].class_confidence == "high" and list(records[4].node_changes) == []
    listing = payloads.law_refs(spark.createDataFrame([(json.dumps({"laws": [{"law_info": {"law_id": "A", "law_type": "Act"}, "revision_info": {"law_revision_id": "A_20260401_x", "category": "c"}}, {"law_info": {"law_id": ""}}]}),)], "payload string"))
    models = readmodels.laws(events, blobs, listing)
    heads = {r.law_id: r for r in models["legislative_work"].collect()}
    assert heads["A"].title == "見本法" and heads["A"].law_type == "Act" and heads["B"].degraded
    assert models["law_node"].where("law_id = 'A'").count() == 7
    assert [r.eid for r in lookups.get_law(models["legislative_work"], models["law_node"], "A").collect()] == IDS
    assert [r.law_id for r in lookups.list_laws(models["legislative_work"], law_type="Act").collect()] == ["A"]


def test_diff_kinds(spark):
    cols = "change_id long, eid string, parent_eid string, node_type string, num string, caption string, sentence_text string, ordinal long"
    prev = spark.createDataFrame([(1, "a", "", "article", "1", "", "x", 0), (1, "b", "", "article", "2", "", "y", 1), (2, "a", "p", "item", "1", "", "x", 0)], cols)
    curr = spark.createDataFrame([(1, "a", "", "article", "1", "", "z", 0), (1, "c", "", "article", "3", "", "", 2), (2, "a", "q", "item", "1", "", "x", 0)], cols)
    found = diff.node_changes(prev, curr)
    events = spark.createDataFrame([(1, False), (2, False), (3, True)], "change_id long, degraded boolean")
    got = {r.change_id: ([(c.eid, c.op) for c in r.node_changes], r.classification, r.class_confidence) for r in diff.change_records(events, found).collect()}
    assert got[1] == ([("a", "modified"), ("b", "deleted"), ("c", "added")], "substantive", "high")
    assert got[2] == ([("a", "moved")], "administrative", "medium") and got[3] == ([], "administrative", "low")
    guarded = spark.createDataFrame([('{"node_changes":null}',), ("no json",), ('{"node_changes":[{"op":"added"}]}',)], "p string").select(F.size(diff.guarded(F.col("p")))).collect()
    assert [r[0] for r in guarded] == [0, 0, 1]


def meeting(issue, speeches):
    keys = ["speechID", "speechOrder", "speaker", "speakerYomi", "speakerGroup", "speech"]
    return bytearray(json.dumps({"meetingRecord": [{"issueID": issue, "session": 221, "nameOfHouse": "衆議院", "nameOfMeeting": "本会議", "date": "2026-04-07", "speechRecord": [dict(zip(keys, s, strict=True)) for s in speeches]}]}).encode())


def test_minutes(spark):
    vote = "記名投票。投票総数 四\n賛成 三 反対 一\n予算案について\n賛成者 山田太郎君 佐藤一君鈴木二君\n反対者 高橋三君\n以上"
    say = [("s0", 0, "会議録情報", "", "", "x"), ("s1", 1, "山田太郎君", "やまだ", "甲党", vote), ("s2", 2, "佐藤一", "", "乙党", "こんにちは")]
    events, blobs = log(spark, [("kokkai:M", "m1", meeting("M", say)), ("other:x", "m2", bytearray(b"{}")), ("kokkai:M", "m3", meeting("M", say[:2]))])
    out = readmodels.minutes(events, blobs)
    assert out["meeting"].first().date.isoformat() == "2026-04-07" and out["speech"].count() == 2
    assert {r.name for r in out["person"].collect()} == {"山田太郎君", "佐藤一"} and out["organization"].count() == 2 and out["membership"].count() == 2
    event = out["vote_event"].first()
    assert (event.yes_count, event.no_count, event.result, event.confidence, event.needs_review, event.vote_event_id, event.motion) == (3, 1, "passed", "high", False, "M#1", "予算")
    cast = {r.voter_name: (r.option, r.person_id is not None) for r in out["vote"].collect()}
    assert cast == {"山田太郎": ("yes", True), "佐藤一": ("yes", False), "鈴木二": ("yes", False), "高橋三": ("no", False)}
    assert lookups.get_meeting(out["meeting"], out["speech"], "M").count() == 2
    assert lookups.list_meetings(out["meeting"], session=221).count() == 1
    assert lookups.list_vote_events(out["vote_event"], out["vote"], out["meeting"], mappable_only=True).first().has_named_votes


def test_vote_confidence(spark):
    texts = ["記名投票 賛成 2 反対 2 投票総数 4", "記名投票 賛成 2 反対 2 投票総数 5", "記名投票", "賛成 1"]
    rows = spark.createDataFrame([("M", f"s{i}", i, t) for i, t in enumerate(texts)], "issue_id string, speech_id string, speech_order int, text string")
    got = votes.recorded_votes(rows)
    assert [(r.result, r.confidence) for r in got.orderBy("speech_order" if "speech_order" in got.columns else "vote_event_id").collect()] == [("rejected", "medium"), ("rejected", "low"), ("unknown", "low")]
    assert [r.confidence for r in votes.review_queue(got).collect()] == ["low", "low", "medium"]


def test_resolution_strict(spark):
    talk = spark.createDataFrame([("M", 1, 1, "山田", "a", ""), ("M", 1, 2, "山田", "b", "")], "issue_id string, seq long, speech_order int, speaker string, speaker_yomi string, speaker_group string")
    cast = spark.createDataFrame([("M", "M#1", "yes", "山田")], "issue_id string, vote_event_id string, option string, voter_name string")
    assert people.resolved(cast, talk).first().person_id is not None and people.resolved(cast, talk, strict=True).first().person_id is None


def test_rosters(spark):
    lower = "<table><TR><th>氏名</th></TR><TR><TD>山田　太郎君<TD>やまだ　たろう<TD>甲党<TD>栃木３<TD>2</TR><TR><TD>佐藤花君</TD><TD>さとう</TD><TD>乙</TD><TD>（比）東海</TD><TD>1</TD></TR></table>"
    upper = "<tr><th>ア</th><td>鈴木　次郎</td><td>すずき</td><td>丙</td><td>鳥取・島根</td></tr><tr><td>x</td><td>y</td><td>z</td><td>どこ</td></tr>"
    events, blobs = log(spark, [("giin-roster:1", "r1", bytearray(lower.encode("shift_jis"))), ("sangiin-roster:1", "r2", bytearray(upper.encode()))])
    got = {r.name_key: (r.house, r.district_code, r.is_pr, r.pr_block) for r in readmodels.rosters(events, blobs).collect()}
    assert got == {"山田太郎": ("representatives", "903", False, None), "佐藤花": ("representatives", None, True, "東海"), "鈴木次郎": ("councillors", "31,32", False, None)}


def test_roll_calls(spark):
    page = "<title>予算案：本会議投票結果</title><h2>第221回国会 令和8年4月7日</h2><h3>賛成票 2 反対票 1</h3><h4>甲党（２名）</h4><tr><td>賛成</td><td></td><td>山田　太郎</td></tr><tr><td></td><td>反対</td><td>佐藤花</td></tr><h4>乙党(1名)</h4><tr><td>賛成</td><td></td><td>鈴木</td></tr>"
    events, blobs = log(spark, [("sangiin-vote:221-0407-v001", "v", bytearray(page.encode()))])
    out = readmodels.roll_calls(events, blobs)
    e = out["event"].first()
    assert (e.vote_event_id, e.motion, e.session, str(e.vote_date), e.yes_count, e.no_count) == ("221-0407-v001", "予算案", 221, "2026-04-07", 2, 1)
    assert {(r.name_key, r.option, r.parliamentary_group) for r in out["vote"].collect()} == {("山田太郎", "yes", "甲党"), ("佐藤花", "no", "甲党"), ("鈴木", "yes", "乙党")}
    assert lookups.list_roll_calls(out["event"]).count() == 1
    links = spark.createDataFrame([('<a href="vote/221-0407-v001.htm">x</a><a href="221-0407-v001.htm">y</a>',)], "html string")
    assert [r.slug for r in payloads.vote_slugs(links).collect()] == ["221-0407-v001"]


def test_listings_and_bytes(spark):
    lists = ['[{"LawId":"A","EnforcementFlg":"0"},{"LawId":"B","EnforcementFlg":"1"}]', '{"result":{"LawList":[{"LawId":"C"}]}}', '{"ApplData":{"LawList":[{"LawId":"A","EnforcementFlg":""}]}}', '{"laws":[{"LawId":"D"}]}', "<DataRoot><LawNameListInfo><LawId>E</LawId><EnforcementFlg>0</EnforcementFlg></LawNameListInfo></DataRoot>"]
    got = payloads.updated_laws(spark.createDataFrame([(p,) for p in lists], "payload string"))
    assert sorted(r.law_id for r in got.collect()) == ["A", "C", "D", "E"]
    refs = payloads.meeting_refs(spark.createDataFrame([(bytes(meeting("M", [])),), (bytes(meeting("M", [])),)], "payload binary"))
    assert [r.stream_id for r in refs.collect()] == ["kokkai:M"]
    blobs = spark.createDataFrame([(bytearray(gzip.compress(b"abc")),), (bytearray(b"abc"),), (None,)], "b binary").select(payloads.plain_bytes(F.col("b"))).collect()
    assert [r[0] and bytes(r[0]) for r in blobs] == [b"abc", b"abc", None]
    xml = spark.createDataFrame([(bytearray(b'<a y="1" x="2"/>'),), (bytearray(b'<a x="2"  y="1"></a>'),), (bytearray(b"<a"),)], "b binary").select(payloads.canonical_xml(F.col("b"))).collect()
    assert xml[0] == xml[1] and xml[2][0] is None


def test_folds(spark):
    rows = spark.createDataFrame([("p1", "a", 1), ("p1", "b", 1), ("p2", "a", 2), ("p1", "c", 3)], "page string, k string, seq long")
    assert {r.k for r in folds.latest_children(rows, "page").collect()} == {"a", "c"}
    assert {(r.k, r.page) for r in folds.by_page(rows, "page", "k").collect()} == {("a", "p2"), ("c", "p1")}
    assert folds.fingerprint(rows).first() == folds.fingerprint(rows.repartition(3)).first()
    assert folds.fingerprint(rows.limit(0)).first().n == 0


def test_paging(spark):
    df = spark.range(1, 21).withColumnRenamed("id", "seq")

    def walk(token, n=5):
        keys = [r.seq for r in paging.keyset_page(df, token, n).collect()]
        return paging.page_tokens(keys, token, n)

    assert walk("") == ([20, 19, 18, 17, 16], "older:16", "")
    assert walk("older:16") == ([15, 14, 13, 12, 11], "older:11", "newer:15")
    assert walk("newer:15") == ([20, 19, 18, 17, 16], "older:16", "")
    assert walk("newer:10")[0] == [15, 14, 13, 12, 11] and walk("16")[0][0] == 15 and walk("junk")[0][0] == 20
    assert walk("older:1") == ([], "", "")
    assert paging.page_size(0) == 50 and paging.page_size(201) == 50 and [r.seq for r in paging.offset_page(df, [F.col("seq")], "3", 2).collect()] == [4, 5, 6]
    assert tuple(paging.bounded_count(df, 11, 5, cap=15).first()) == (15, 10, 3)
    words = spark.createDataFrame([("100%",), ("100_",), ("1000",), (None,)], "t string")
    assert [paging.keyword(words, ["t"], w).count() for w in ("100%", "100_", "100", " ", "1\\")] == [1, 1, 3, 4, 0]
    try:
        paging.time_range(df, "seq", since="yesterday")
        raise AssertionError
    except ValueError:
        pass


def test_rules(spark):
    rows = spark.createDataFrame([("vanished", None, 1), ("changed", None, 1), ("odd", "x", 0)], "type string, content_hash string, stream_seq long")
    got = {r.rule: r.violations for r in rules.violations(rows, rules.RULES["event"], {"unique": ["stream_seq"]}).collect()}
    assert got == {"vanished_has_no_content": 1, "known_type": 1, "positive_seq": 1, "unique": 1}
