"""Column builders: names, numbers, districts, dates, ids, links. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\u0085\p{Z}]+"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
# Speakers that are offices or the record itself, not people.
ROLES = ("議長", "副議長", "委員長", "主査", "会長")
RECORD_SPEAKERS = ("会議録情報",)
# Numerals of the minutes.
KANJI_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
KANJI_UNITS = {"十": 10, "百": 100, "千": 1000}
# Prefectures in the order of their JIS X 0401 codes, from 1.
PREFECTURES = (
    "北海道 青森 岩手 宮城 秋田 山形 福島 茨城 栃木 群馬 埼玉 千葉 東京 神奈川 新潟 富山 石川 福井 山梨 長野 岐阜 静岡 愛知 三重 "
    "滋賀 京都 大阪 兵庫 奈良 和歌山 鳥取 島根 岡山 広島 山口 徳島 香川 愛媛 高知 福岡 佐賀 長崎 熊本 大分 宮崎 鹿児島 沖縄"
).split()
JIS = {name: code for code, name in enumerate(PREFECTURES, 1)}


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def content_ref(digest: Column) -> Column:
    """``sha256:<hex>``, empty without a digest."""
    return F.when(digest.isNull() | (digest == ""), "").otherwise(F.concat(F.lit("sha256:"), digest))


def utc_seconds(ts: Column) -> Column:
    """RFC 3339 in UTC, whole seconds, empty without a time (the session's zone is UTC)."""
    return or_empty(F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def name_key(name: Column) -> Column:
    """Name without spaces; one trailing 君 goes, then one trailing さん."""
    bare = F.regexp_replace(name, SPACES, "")
    return F.regexp_replace(F.regexp_replace(bare, "君$", ""), "さん$", "")


def reading_key(reading: Column) -> Column:
    return F.regexp_replace(reading, SPACES, "")


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def person_id(name: Column, reading: Column) -> Column:
    return F.concat(F.lit("p:"), _short(F.concat(or_empty(name_key(name)), F.lit("\n"), or_empty(reading_key(reading)))))


def organization_id(name: Column) -> Column:
    return F.concat(F.lit("o:"), _short(or_empty(name_key(name))))


def identity_confidence(name: Column, reading: Column) -> Column:
    key = or_empty(name_key(name))
    return F.when((key == "") | key.isin(*ROLES), "low").when(or_empty(reading_key(reading)) == "", "medium").otherwise("high")


def is_person(speaker: Column) -> Column:
    bare = or_empty(F.trim(speaker))
    return (bare != "") & ~bare.isin(*RECORD_SPEAKERS)


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_DIGITS, DIGITS)


def number_token(token: Column) -> Column:
    """Count in ASCII, full-width or kanji numerals; null for anything else, mixtures too.

    Kanji are folded from the left: a digit waits for its unit, a second digit in a
    row replaces the first, 万 multiplies all since the last 万.
    """
    digits, units = lookup(KANJI_DIGITS), lookup(KANJI_UNITS)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("digit"))

    def step(s: Column, c: Column) -> Column:
        unit = units[c]
        made = s["section"] + F.greatest(s["digit"], F.lit(1)) * unit
        return (
            F.when(c == "万", F.struct((s["total"] + (s["section"] + s["digit"]) * 10000).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("digit")))
            .when(unit.isNotNull(), F.struct(s["total"].alias("total"), made.alias("section"), F.lit(0).alias("digit")))
            .otherwise(F.struct(s["total"].alias("total"), s["section"].alias("section"), digits[c].alias("digit")))
        )

    kanji = F.aggregate(F.split(token, ""), zero, step, lambda s: s["total"] + s["section"] + s["digit"])
    return F.when(token.rlike("^[0-9０-９]+$"), half_width(token).try_cast("int")).when(token.rlike("^[〇零一二三四五六七八九十百千万]+$"), kanji)


def heading_number(text: Column) -> Column:
    """Digits of a heading as one number, 0 without any."""
    return F.coalesce(half_width(F.regexp_replace(text, "[^0-9０-９]", "")).try_cast("int"), F.lit(0))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def group_heading(text: Column) -> Column:
    """Party heading without the number of members behind it."""
    return F.trim(F.regexp_replace(one_space(text), r"\s*[（(]\s*[0-9０-９]+\s*名\s*[)）]\s*$", ""))


def vote_option(pros: Column, cons: Column) -> Column:
    return F.when(pros.contains("賛成"), "yes").when(cons.contains("反対"), "no").otherwise("abstain")


def motion_of_title(title: Column) -> Column:
    """What stands before the first colon, the whole title if nothing does."""
    first = F.split(title, "[：:]")[0]
    return F.regexp_replace(F.when(F.length(first) > 0, first).otherwise(title), f"^{SPACES}|{SPACES}$", "")


def heading_session(text: Column) -> Column:
    return F.regexp_extract(half_width(text), "第([0-9]+)回", 1).try_cast("int")


def heading_date(text: Column) -> Column:
    """Date of a heading in era years (令和, 平成) or western ones; null if there is none."""
    t = half_width(text)
    year = (
        F.when(t.rlike("令和"), F.regexp_replace(F.regexp_extract(t, "令和 *([0-9]+|元) *年", 1), "元", "1").try_cast("int") + 2018)
        .when(t.rlike("平成"), F.regexp_replace(F.regexp_extract(t, "平成 *([0-9]+|元) *年", 1), "元", "1").try_cast("int") + 1988)
        .otherwise(F.regexp_extract(t, "([0-9]{4}) *年", 1).try_cast("int"))
    )
    month, day = (F.regexp_extract(t, pattern, 1).try_cast("int") for pattern in ("年 *([0-9]+) *月", "月 *([0-9]+) *日"))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def lower_house_district(cell: Column) -> Column:
    """``struct(code, name, is_pr, block)`` of ``栃木3`` or ``（比）東海``; null if it is neither."""
    text = F.trim(half_width(cell))
    block = F.trim(F.regexp_replace(text, "^(（比）|比例)", ""))
    name, number = F.regexp_extract(text, r"^(.+?)([0-9]+)$", 1), F.regexp_extract(text, r"^(.+?)([0-9]+)$", 2).try_cast("int")
    prefecture = lookup(JIS)[name]
    none, no = F.lit(None).cast("string"), F.lit(False)
    return F.when(
        text.rlike("^(（比）|比例)"),
        F.when(block != "", F.struct(none.alias("code"), none.alias("name"), (~no).alias("is_pr"), block.alias("block"))),
    ).when(
        prefecture.isNotNull() & (number > 0),
        F.struct(
            (prefecture * 100 + number).cast("string").alias("code"), F.concat(name, number.cast("string"), F.lit("区")).alias("name"), no.alias("is_pr"), none.alias("block")
        ),
    )


def upper_house_district(cell: Column) -> Column:
    """The same for prefectures, joint ones (``鳥取・島根`` → ``31,32``) and 比例."""
    text = F.trim(cell)
    codes = F.transform(F.split(text, "・"), lambda p: lookup(JIS)[F.trim(p)])
    none = F.lit(None).cast("string")
    return F.when(
        text.isin("比例", "比例代表"), F.struct(none.alias("code"), none.alias("name"), F.lit(True).alias("is_pr"), F.lit("全国").alias("block"))
    ).when(
        F.forall(codes, lambda c: c.isNotNull()),
        F.struct(F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("code"), text.alias("name"), F.lit(False).alias("is_pr"), none.alias("block")),
    )


def enforcement_date(revision_id: Column) -> Column:
    """Middle part of ``{law}_{yyyymmdd}_{amendment}``."""
    return F.try_to_date(F.get(F.split(revision_id, "_"), F.lit(1)), "yyyyMMdd")


def canonical_json(text: Column) -> Column:
    """The same value always as the same text: keys sorted, no spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def tokyo_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Tokyo"), "yyyy-MM-dd HH:mm")


def checkpoint_body(origin: Column, size: Column, root_hex: Column) -> Column:
    return F.concat_ws("\n", origin, size.cast("string"), F.base64(F.unhex(root_hex)), F.lit(""))


def stream_id(source: Column, key: Column) -> Column:
    return F.concat(source, F.lit(":"), key)


def stream_source(stream: Column) -> Column:
    """Part before the first colon, empty without one."""
    return F.when(stream.contains(":"), F.substring_index(stream, ":", 1)).otherwise("")


def law_link(law_id: Column) -> Column:
    return F.format_string("https://laws.e-gov.go.jp/law/%s", law_id)


def look_back(day: Column, days: int = 90) -> Column:
    """All dates from ``days`` before to the day itself."""
    return F.sequence(F.date_sub(day, days), day)


def roll_call_link(session: Column, slug: Column) -> Column:
    """Address of an upper-house roll-call page."""
    return F.concat(F.lit("https://www.sangiin.go.jp/japanese/touhyoulist/"), session.cast("string"), F.lit("/"), slug, F.lit(".htm"))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, full-width too; null as empty."""
    return F.regexp_replace(or_empty(text), r"^[\s\u3000]+|[\s\u3000]+$", "")
