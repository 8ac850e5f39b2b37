"""Licence scans by sentence rules, with DataFrame functions only.

Text is cut into sentences (at line ends, and again across lines at full stops),
sentences are normalised and looked up among the known licence sentences, and
the sequence of their identifiers is matched against ordered rules: a rule that
comes earlier takes its identifiers, later rules see what is left. Everything
happens inside a row; only texts with a cue word are cut at all.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Known licence sentences, normalised (small letters and digits, single spaces), and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "spdx license identifier mit": "mit-short",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-short",
    "spdx license identifier apache 2 0": "apache2-short",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "spdx license identifier gpl 3 0 only": "gpl3-short",
    "spdx license identifier gpl 3 0 or later": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-redistribute",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2 1 of the license or at your option any later version": "version21-later",
    "either version 3 of the license or at your option any later version": "version3-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "spdx license identifier mpl 2 0": "mpl2-short",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "licensed under cc by 4 0": "cc-by4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4",
    "all rights reserved": "reserved",
    "this work is in the public domain license free": "public-domain",
}
# Licence and the sentence identifiers, in their order, that stand for it; earlier rules go first.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-short", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-short", "apache2-use", "apache2-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "version3-later")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "version2-later")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute", "version3-later")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute", "version21-later")),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "version3-later")),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("EPL-2.0", ("epl2",)),
    ("MIT", ("mit-short",)),
    ("Apache-2.0", ("apache2-short",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("reserved",)),
]
#: Each known sentence holds one of these.
CUES = "licen|permi|software|distribut|rights reserved"
LINE_ENDS, SENTENCE_ENDS = r"[\n\r]+", r"[.!?;:]+[ \t\n\r]+|\n[ \t\r]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """Small letters and digits with single spaces, and ``*`` where any words may stand."""
    return " ".join(re.sub("[^a-z0-9*]+", " ", sentence.lower()).split())


def read_tables(spark: SparkSession, sentences: str, rules: str) -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Tables from JSON lines: ``sentence, id``, and ``place, licence, ids`` (rules by place).
    They are what every task matches with, so they come to the driver."""
    known = {normalised(r.sentence): r.id for r in spark.read.schema("sentence string, id string").json(sentences).collect()}
    ordered = spark.read.schema("place long, licence string, ids array<string>").json(rules).orderBy("place").collect()
    return known, [(r.licence, tuple(r.ids)) for r in ordered]


def cues_of(sentences: dict[str, str]) -> str:
    """Pattern of which every known sentence holds a part: the cues, and the longest word of those without any."""
    rest = {max(s.replace("*", " ").split(), key=len) for s in sentences if not any(c in s for c in CUES.split("|"))}
    return "|".join([CUES, *sorted(rest)])


def _plain(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def known(text: Column, ends: str, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    parts = F.split(F.translate(text, UPPER, LOWER), ends)
    plain = F.transform(parts, _plain)
    fixed = {s: i for s, i in sentences.items() if "*" not in s}
    open_ = {"^" + s.replace("*", "[a-z0-9]+( [a-z0-9]+){0,7}") + "$": i for s, i in sentences.items() if "*" in s}
    ids = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair]) if fixed else F.lit(None).cast("map<string,string>")

    def name(s: Column) -> Column:
        return reduce(lambda c, pattern: F.coalesce(c, F.when(s.rlike(pattern), open_[pattern])), open_, ids[s])

    if not open_:
        return F.transform(F.filter(plain, lambda s: s.isin(list(fixed))), lambda s: ids[s])
    return F.filter(F.transform(plain, name), lambda i: i.isNotNull())


def matched(ids: Column, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> Column:
    """Licences that the rules find in a sequence of identifiers, in order of place."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for licence, rule in rules:
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in rule)), F.lit(f"[{licence}]"))
    return F.regexp_extract_all(sequence, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """Per document: doc_id, licenses (comma-joined, by name), n_sentences (known
    sentences, the larger of both ways to cut), sentence_ids (of the line cut).
    Null and empty texts have none; rows are independent, repeated ones too. Identifiers
    and licences may not hold ``<>[]``; ``scan_with_tables`` takes any."""
    if set("<>[]") & set("".join([*sentences.values(), *(x for licence, ids in rules for x in (licence, *ids))])):
        raise ValueError("identifiers and licences may not hold <>[]")
    text = F.col(text_col)
    cue = F.coalesce(F.translate(text, UPPER, LOWER).rlike(cues_of(sentences)), F.lit(False))
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(cue, known(text, LINE_ENDS, sentences)).otherwise(none).alias("lines"),
        F.when(cue, known(text, SENTENCE_ENDS, sentences)).otherwise(none).alias("sentences"),
    )
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_union(matched(F.col("lines"), rules), matched(F.col("sentences"), rules))), ",").alias("licenses"),
        F.greatest(F.size("lines"), F.size("sentences")).cast("long").alias("n_sentences"),
        F.array_join("lines", ",").alias("sentence_ids"),
    )


def scan_with_tables(docs: DataFrame, sentences: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", cues: str = CUES) -> DataFrame:
    """``scan_licenses`` for tables of any size, by joins: ``sentences`` (sentence, id;
    without open words) and ``rules`` (place, licence, ids).

    Sentences of texts with a cue meet the known ones by digest of their normal form;
    a text's identifiers, in order, meet the rules by their first identifier, and a rule
    holds where the following ones are its own. Of what holds, the earlier rule and then
    the earlier place takes its identifiers. Columns as there.
    """
    text = F.col(text_col)
    cue = F.coalesce(F.translate(text, UPPER, LOWER).rlike(cues), F.lit(False))

    def digests(ends: str) -> Column:
        parts = F.split(F.translate(text, UPPER, LOWER), ends)
        return F.when(cue, F.transform(parts, lambda s: F.md5(_plain(s).cast("binary"))))

    held = docs.select(F.col(id_col).alias("doc_id"), digests(LINE_ENDS).alias("lines"), digests(SENTENCE_ENDS).alias("sentences"))
    held = materialize(held.withColumn("row", F.monotonically_increasing_id()))
    each = held.where("lines is not null").select("row", F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("digests")) for c in ("lines", "sentences")])).alias("x"))
    each = each.select("row", "x.cut", F.posexplode("x.digests").alias("pos", "digest"))
    known = sentences.groupBy(F.md5(_plain(F.lower("sentence")).cast("binary")).alias("digest")).agg(F.min("id").alias("id"))
    found = each.join(known, "digest").groupBy("row", "cut").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    found = materialize(found.select("row", "cut", F.col("s.id").alias("ids")))
    own = rules.where(F.size("ids") > 0).select("place", "licence", F.col("ids").alias("rule"), F.element_at("ids", 1).alias("id"))
    at = found.select("row", "cut", "ids", F.posexplode("ids").alias("at", "id")).join(own, "id")
    holds = at.where(F.slice("ids", F.col("at") + 1, F.size("rule")) == F.col("rule")).select("row", "cut", F.struct("place", "at", (F.col("at") + F.size("rule")).alias("end"), "licence").alias("m"))
    per = holds.groupBy("row", "cut").agg(F.array_sort(F.collect_list("m")).alias("all"))
    kind = per.schema["all"].dataType.simpleString()

    def take(taken: Column, m: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (t["at"] < m["end"]) & (m["at"] < t["end"])), taken).otherwise(F.concat(taken, F.array(m)))

    taken = F.aggregate("all", F.array().cast(kind), take)
    licences = per.select("row", F.explode(F.transform(taken, lambda m: m["licence"])).alias("licence")).groupBy("row").agg(F.array_sort(F.collect_set("licence")).alias("licences"))
    counts = found.groupBy("row").agg(F.max(F.size("ids")).cast("long").alias("n"), F.max(F.when(F.col("cut") == "lines", F.array_join("ids", ","))).alias("of_lines"))
    out = held.select("doc_id", "row").join(licences, "row", "left").join(counts, "row", "left")
    return out.select("doc_id", F.coalesce(F.array_join("licences", ","), F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0).cast("long")).alias("n_sentences"), F.coalesce("of_lines", F.lit("")).alias("sentence_ids"))


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL, from the same fixed values."""
    keys = ", ".join(f"'{s}'" for s in SENTENCES)
    ids = ", ".join(f"'{i}'" for i in SENTENCES.values())
    lower = f"translate(text, '{UPPER}', '{LOWER}')"

    def cut(ends: str) -> str:
        plain = f"list_transform(regexp_split_to_array({lower}, '{ends}'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        return f"case when coalesce(regexp_matches({lower}, '{CUES}'), false) then list_transform(list_filter({plain}, lambda s: list_contains([{keys}], s)), lambda s: [{ids}][list_position([{keys}], s)]) else []::varchar[] end"

    def rules(column: str) -> str:
        sql = f"array_to_string(list_transform({column}, lambda i: '<' || i || '>'), '')"
        for licence, rule in RULES:
            sql = f"replace({sql}, '{''.join(f'<{i}>' for i in rule)}', '[{licence}]')"
        return f"regexp_extract_all({sql}, '\\[([^\\]]+)\\]', 1)"

    return f"""
with x as (select doc_id, {cut(LINE_ENDS)} as lines, {cut(SENTENCE_ENDS)} as sentences from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_concat({rules("lines")}, {rules("sentences")}))), ',') as licenses,
  greatest(len(lines), len(sentences))::bigint as n_sentences, array_to_string(lines, ',') as sentence_ids from x"""
