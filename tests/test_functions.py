import hashlib

from pyspark.sql import functions as F

from ledgerfold.functions import columns as C
from ledgerfold.functions import wire


def values(spark, texts, f, *more):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r[0] for r in df.select(f(F.col("x"), *more)).collect()]


def test_numbers(spark):
    tokens = ["242", "２４２", "二百四十二", "一万二百", "二四二", "十", "4百", "x", "", "〇"]
    assert values(spark, tokens, C.number_token) == [242, 242, 242, 10200, 2, 10, None, None, None, 0]


def test_names(spark):
    assert values(spark, ["山田　太郎君", " 山田 太郎 さん", "山田君さん", "君"], C.name_key) == ["山田太郎", "山田太郎", "山田君", ""]
    want = "p:" + hashlib.sha256("山田太郎\nやまだたろう".encode()).hexdigest()[:16]
    assert values(spark, ["山田　太郎君"], C.person_id, F.lit("やまだ たろう")) == [want]
    assert values(spark, ["議長", "", "山田"], C.identity_confidence, F.lit("")) == ["low", "low", "medium"]


def test_districts(spark):
    lower = values(spark, ["栃木3", "鳥取２", "（比）東海", "比例北海道", "（比）", "どこか1", "東京"], C.lower_house_district)
    assert [d and tuple(d) for d in lower] == [("903", "栃木3区", False, None), ("3102", "鳥取2区", False, None), (None, None, True, "東海"), (None, None, True, "北海道"), None, None, None]
    upper = values(spark, ["鳥取・島根", "比例", "東京", "月"], C.upper_house_district)
    assert [d and tuple(d) for d in upper] == [("31,32", "鳥取・島根", False, None), (None, None, True, "全国"), ("13", "東京", False, None), None]


def test_headings(spark):
    assert values(spark, ["自由党（１２名）", "無所属 (3名)"], C.group_heading) == ["自由党", "無所属"]
    assert [str(d) for d in values(spark, ["第221回国会 令和8年4月7日", "平成元年 1月 8日", "なし"], C.heading_date)] == ["2026-04-07", "1989-01-08", "None"]
    assert values(spark, ["第２２１回国会", "x"], C.heading_session) == [221, None]
    assert values(spark, ["法案：賛否", "表題", "：x"], C.motion_of_title) == ["法案", "表題", "：x"]
    assert [str(d) for d in values(spark, ["L_20260401_A", "L"], C.enforcement_date)] == ["2026-04-01", "None"]


def test_small_forms(spark):
    assert values(spark, ['{"b":1, "a":[2]}', "no"], C.canonical_json) == ['{"a":[2],"b":1}', None]
    assert values(spark, ["a:b:c", "abc"], C.stream_source) == ["a", ""]
    assert len(values(spark, ["2026-04-07"], lambda x: C.look_back(x.cast("date")))[0]) == 91
    body = spark.range(1).select(C.checkpoint_body(F.lit("o"), F.lit(3), F.lit("00ff"))).first()[0]
    assert body == "o\n3\nAP8=\n"


def encoded(fields):
    """Wire form in plain Python."""
    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | 128 * (n > 0)])
            if not n:
                return out
    out = b""
    for i, v in enumerate(fields, 1):
        if isinstance(v, int):
            out += varint(i << 3) + varint(v) if v else b""
        elif v:
            out += varint(i << 3 | 2) + varint(len(v.encode())) + v.encode()
    return out


def test_wire_form(spark):
    rows = [("e1", "s:é", 1, "observed", "s", "v", "2026-06-02 09:00:00.9", None, "ab" * 32, None, wire.GENESIS), ("e2", "x" * 300, 2**53 + 7, None, "", "v", "2026-06-02 10:00:00", "2026-01-01 00:00:00", None, "cd" * 32, "ef" * 32), ("", "", 0, None, "", "", None, None, None, None, "")]
    names = ["event_id", "stream_id", "stream_seq", "type", "source", "fetcher_version", "observed_at", "source_published_at", "content_hash", "prev_content_hash", "log_prev_hash"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'stream_seq' else 'string'}" for n in names))
    df = df.withColumns({n: F.col(n).cast("timestamp") for n in ("observed_at", "source_published_at")})
    got = [tuple(r) for r in df.select(wire.wire_hex(), wire.log_hash()).collect()]
    iso = lambda t: t and t[:19].replace(" ", "T") + "Z"
    for r, (wire_hex, digest) in zip(rows, got, strict=True):
        ref = lambda h: h and "sha256:" + h
        want = encoded([r[0], r[1], r[2], wire.TYPE_NUMBERS.get(r[3], 0), r[4], r[5], iso(r[6]), iso(r[7]), ref(r[8]), ref(r[9]), r[10]])
        assert wire_hex == want.hex() and digest == hashlib.sha256(want).hexdigest()
