import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.llm import bpe, licenses, middle, mixing, pii, quality, token_counts, token_files

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def library():
    import tiktoken
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# --- personal data -----------------------------------------------------------

PII = "mail a.b+c@x-y.example.com. or b@c, ip 10.0.0.255 and 1.2.3.999 1.2.3.4.5.6.7.8, card 4111 1111-1111 1111 and 4111111111111112, call +1 (555) 010-9999 or +12, IBAN GB82 WEST 1234 5698 7654 32 NOW, ssn 123-45-6789, 987-65-4321"


def base_spans(text):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_kinds():
    kinds = Counter(k for k, *_ in pii.spans_of(PII))
    assert kinds == {"email": 1, "ip": 3, "card": 1, "phone": 1, "iban": 1, "ssn": 1}
    assert pii.redacted("x a@b.co y") == "x <EMAIL> y" and pii.redacted("clean") == "clean"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-% 0123456789()é\n_", max_size=60))
def test_pii_base_equals_patterns(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_pii_is_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1(" * 70_000, "@a" * 100_000, "-" * 100_000 + "@b"):
        pii.spans_of(text)


def test_pii_query(docs, empty):
    got = pii.find_pii(docs)
    assert got.count() == docs.count() and pii.find_pii(empty).count() == 0 and pii.redact(empty).columns == empty.columns
    none = hashlib.sha256(b"").hexdigest()
    assert got.where("doc_id = 0").first().base_sha256 == none


def test_pii_columns_equal_plain_spans(spark):
    """Counts, digest and order of spans of whole documents, against patterns one by one."""
    rng = random.Random(2)
    bits = ["a.b@c-d.org", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 1234-567", "+12", "word", "é", "\n", "GB82 WEST 1234 5698 7654 32", "x@y"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", PII, PII * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = ("email", "ip", "card", "phone")
    for r in pii.find_pii(df).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in base] == [sum(s[0] == k for s in want) for k in base]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in every if x[0] in base] == [x.split(":") for x in line.split(",") if x]
        assert [(pii.KINDS.index(k), int(s)) for k, s, _ in every] == sorted((pii.KINDS.index(k), int(s)) for k, s, _ in every)


# --- token ids ---------------------------------------------------------------


def test_encoder_equals_libraries(docs, library):
    hf, tik = library
    texts = [t or "" for (t,) in docs.select("text").collect()]
    own, ranks = bpe.Encoder(JSON, cache_bytes=9000), bpe.Encoder(RANKS)
    table = bpe.byte_table(RANKS)
    for t, a, b in zip(texts, own.encode(texts), ranks.encode(texts), strict=True):
        assert list(memoryview(a).cast("I")) == hf.encode(t, add_special_tokens=False).ids
        assert list(memoryview(b).cast("I")) == tik.encode_ordinary(t)
        assert bpe.decode(b, table) == t.encode()
        offsets = bpe.char_offsets(b, table)
        assert not t or (offsets[0][0] == 0 and offsets[-1][1] == len(t))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB' \n\t.,!9éß日😀　\x1c\xa0", max_size=40))
def test_encoder_on_any_text(library, text):
    hf, tik = library
    assert list(memoryview(bpe.encoder(JSON).encode([text])[0]).cast("I")) == hf.encode(text, add_special_tokens=False).ids
    assert list(memoryview(bpe.encoder(RANKS).encode([text])[0]).cast("I")) == tik.encode_ordinary(text)


@pytest.mark.parametrize("end", ["", "\n", "\n\n", " tail\nline"])
def test_encoder_on_many_lines_without_spaces(library, end):
    hf, tik = library
    lines = [f"word{i % 700},{i}" if i % 3 else "naïve日本" for i in range(5000)]
    for text in ("\n".join(lines) + end, " " + "\n".join(lines[:2500]) + "\n\n" + "\r\n".join(lines[2500:]) + end):
        for own, want in ((bpe.Encoder(JSON), hf.encode(text, add_special_tokens=False).ids), (bpe.Encoder(RANKS), tik.encode_ordinary(text))):
            assert list(memoryview(own.encode([text])[0]).cast("I")) == want
            kept = [*own.first, *own.after_space]
            assert max(map(len, kept)) <= bpe.KEPT_CHARS and len(kept) <= 5100


def test_encoder_of_pieces_clears_its_cache(library):
    own = bpe.Encoder(JSON, cache_bytes=9000)
    pieces = [f"{i}\n{i + 1}\nx{i}" for i in range(500)]
    got = own.encode_pieces(pieces)
    assert [list(memoryview(x).cast("I")) for x in got] == [library[0].encode(p, add_special_tokens=False).ids for p in pieces]
    assert len(own.first) + len(own.after_space) < 60


def test_encoder_asks_for_letters_once(library):
    """Whatever marks and line ends stand around them; only clean line ends cut a text."""
    own, asked = bpe.Encoder(JSON), []
    encode_unit = own.encode_unit
    own.encode_unit = lambda lead, unit: asked.append((lead, unit)) or encode_unit(lead, unit)
    texts = ["über alpha, alpha. alpha!\nalpha; alpha\nüber, alpha:", "alpha.\nüber\n\n alpha \nalpha,\n", "\nalpha\r\nalpha"]
    got = own.encode(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == [library[0].encode(t, add_special_tokens=False).ids for t in texts]
    plain = [x for x in asked if "alpha" in x[1] and not re.search(r"\s", x[1])]
    assert sorted(plain) == [("", "alpha"), (" ", "alpha")]
    assert not any(re.search(r"\S\n\S", unit) for unit in (*own.first, *own.after_space))


def test_offsets_of_documents(spark):
    """Each token covers the characters that its bytes are part of; together all of the text."""
    texts = ["naïve 日本語 🙂 end", "a\nb\n" * 300, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = bpe.byte_table(RANKS)
    for r in bpe.encode_documents(df, RANKS, with_offsets=True).collect():
        text, ids = texts[r.doc_id] or "", list(memoryview(bytes(r.ids)).cast("I"))
        assert len(r.starts) == len(r.ends) == len(ids) and (not ids or (r.starts[0], r.ends[-1]) == (0, len(text)))
        for i, s, e in zip(ids, r.starts, r.ends, strict=True):
            assert table[i] in text[s:e].encode() and (s == 0 or table[i] not in text[s + 1 : e].encode() or len(text[s:e].encode()) > len(table[i]) or s + 1 > e)
        assert all(b <= e for b, e in zip(r.starts[1:], r.ends[:-1], strict=True)) or all(x - y <= 1 for x, y in zip(r.starts[1:], r.ends[:-1], strict=True))


def test_round_trip(docs, empty):
    got = bpe.round_trip(docs, RANKS, with_ids=True)
    sha = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert all(r.decoded_sha256 == sha[r.doc_id] and len(r.ids) == 4 * r.n_tokens for r in got.collect())
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS)
    assert rows(back, "doc_id", "text") == rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    assert bpe.round_trip(empty, RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60000), st.integers(0, 2**32 - 1), st.just(7)), max_size=700))
def test_blocks_round_trip(ids):
    x = np.array(ids, "<u4")
    assert (token_files.unpack(token_files.pack(x)) == x).all()


def test_blocks_hold_their_bits_in_order():
    """One block read bit by bit, as the format says."""
    for bits in (1, 7, 31, 32):
        x = np.random.default_rng(bits).integers(0, 2**bits, 128).astype("<u4")
        x[:2] = 0, 2**bits - 1
        image = token_files.pack(x, percentile=1.0)
        base, width, words = int.from_bytes(image[20:24], "little"), image[24], int.from_bytes(image[41:], "little")
        assert (base, width, len(image)) == (0, bits, 41 + 16 * bits)
        assert [words >> (i * bits) & (2**bits - 1) for i in range(128)] == x.tolist()


def test_images_are_not_shuffled(spark, docs, tmp_path):
    path, key = str(tmp_path / "tokens"), "spark.sql.autoBroadcastJoinThreshold"
    token_files.write_token_files(docs, path, JSON)
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = token_files.read_token_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_token_files(spark, docs, empty, library, tmp_path):
    hf, _ = library
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, JSON)
    got = token_files.read_token_files(spark, path).collect()
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = np.array([*hf.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted(want)
    token_files.write_token_files(empty, str(tmp_path / "none"), JSON)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_counts(docs, empty, library):
    hf, _ = library
    got = token_counts.count_tokens(docs, JSON)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(hf.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()]
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.count_tokens(empty, JSON).count() == 0


# --- licences ----------------------------------------------------------------


def test_licence_tables_can_be_given(spark, tmp_path):
    """Sentences and rules from files, with words left open for names and years."""
    lines = [("Copyright * by *.", "holder"), ("This text is under the Plain Licence", "plain"), ("You may keep it", "keep")]
    spark.createDataFrame(lines, "sentence string, id string").write.json(f"{tmp_path}/s")
    spark.createDataFrame([(2, "Kept", ["keep"]), (1, "Plain", ["holder", "plain"])], "place long, licence string, ids array<string>").write.json(f"{tmp_path}/r")
    sentences, rules = licenses.read_tables(spark, f"{tmp_path}/s", f"{tmp_path}/r")
    assert rules == [("Plain", ("holder", "plain")), ("Kept", ("keep",))]
    texts = ["Copyright 2019-2024 by Ann B. Other\nThis text is under the Plain licence.", "copyright by\nthis text is under the plain licence", "You may keep it!\nYOU MAY KEEP IT", "Copyright " + "x " * 9 + "by y\nThis text is under the plain licence", "keep", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.scan_licenses(df, sentences=sentences, rules=rules).collect()}
    assert got == {0: ("Plain", 2), 1: ("", 1), 2: ("Kept", 2), 3: ("", 1), 4: ("", 0), 5: ("", 0), 6: ("", 0)}


def test_licence_scan_by_joins_equals_the_one_in_rows(spark, docs, empty):
    """Every order of known sentences, repeats and overlapping rules; rows that share an id."""
    rng = random.Random(21)
    names = list(licenses.SENTENCES)
    texts = [rng.choice(["\n", ". ", "; "]).join(rng.choice([*names, "other words", names[6], names[7], names[8]]).capitalize() for _ in range(rng.randrange(0, 12))) for _ in range(250)]
    texts += ["\n".join([names[4], names[6], names[7], names[8], names[6], names[7]]), None, "", "licence"]
    df = spark.createDataFrame([(i % 200, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sentences = spark.createDataFrame(list(licenses.SENTENCES.items()), "sentence string, id string")
    rules = spark.createDataFrame([(i, licence, list(ids)) for i, (licence, ids) in enumerate(licenses.RULES)], "place long, licence string, ids array<string>")
    for own in (df, docs, empty):
        a, b = licenses.scan_licenses(own), licenses.scan_with_tables(own, sentences, rules)
        assert a.columns == b.columns and rows(a, *a.columns) == rows(b, *b.columns)
    assert len({r.licenses for r in licenses.scan_licenses(df).collect()}) > 30


def test_licence_names_with_brackets(spark):
    df = spark.createDataFrame([(1, "This text is under the odd licence.")], "doc_id long, text string")
    with pytest.raises(ValueError, match="may not hold"):
        licenses.scan_licenses(df, sentences={"this text is under the odd licence": "a<b"}, rules=[("[x]", ("a<b",))])
    own = spark.createDataFrame([("This text is under the odd licence", "a<b")], "sentence string, id string"), spark.createDataFrame([(0, "[x]", ["a<b"])], "place long, licence string, ids array<string>")
    assert licenses.scan_with_tables(df, *own).first().licenses == "[x]"


def test_more_licences(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
    texts = [gpl.format("", "3"), gpl.format("Lesser ", "2.1"), gpl.format("Affero ", "3"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "This is free and unencumbered software released into the public domain.\nAnyone"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.licenses for r in got.orderBy("doc_id").collect()] == ["GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "MPL-2.0", "Unlicense"]


def test_licenses(spark, docs, empty):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,\nand to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", mit, "we talk about the MIT License and licensing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0,CC-BY-NC-4.0", 2: "MIT", 3: "", 4: ""}
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


# --- mixing ------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing until none is above its stop."""
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[k] for k in free)
        over = [k for k in free if level * w[k] > most * sizes[k]]
        if not over:
            return out | {k: level * w[k] for k in free}
        out |= {k: float(most * sizes[k]) for k in over}
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, None: 100}, {"x": 0, "y": 7}, {"k": 0}, {"p": 5, "q": 5, "r": 5, "s": 5, None: 5}])
def test_targets(spark, sizes):
    got = mixing.target_table(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in got)
    per = {}
    of = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        per.setdefault(of[r.doc_id], [r.source_size, r.target, 0])[2] += r.taken
    want = targets({k: v[0] for k, v in per.items()})
    assert all(v[1] == pytest.approx(want[k]) and abs(v[2] - v[1]) <= 0.5 for k, v in per.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) and mixing.mix(empty).count() == 0


def test_mixed_rows_hold_what_is_taken(docs, empty):
    unique = docs.where("doc_id <> 20")
    out = mixing.mixed(unique)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in mixing.mix(unique).collect() if r.taken} and mixing.mixed(empty).count() == 0


def test_round_trip_leaves_no_units_in_workers(spark, docs, tmp_path):
    path = shutil.copy(P.path("byte_bpe_50k.tiktoken"), tmp_path)  # no other test's workers know it
    got = bpe.round_trip(docs, path, with_ids=True, keep_units=False).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), with_ids=True).collect()))

    def cached(batches):
        for b in batches:
            own = bpe.encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([own.cached + len(own.first) + len(own.after_space)])], ["n"])

    assert {r.n for r in spark.range(16).repartition(8).mapInArrow(cached, "n long").collect()} == {0}


# --- quality -----------------------------------------------------------------


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")  # the other half is held out
    held = quality.classify(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def plain_model(texts, least=2):
    """Interpolated modified Kneser-Ney, counted one by one: a function from a text to its bits."""
    count = Counter(w for t in texts for w in (t or "").split())
    known = {w for w, n in count.items() if n >= least}
    makes = [f"<{i}>" for i in range(5)]
    rare = {f"<{i}>": max(1, sum(quality.make(w) == i for w in count if w not in known)) for i in range(5)}

    def walk(text):
        own, out = (text or "").split(), ["<s>", "<s>"]
        for i, w in enumerate(own):
            runs = any(i > k and own[i - k] == w and own[i - 1 - k] == own[i - 1] for k in (1, 2, 3))
            out.append("<run>" if runs else "<same>" if i and own[i - 1] == w else w if w in known else f"<{quality.make(w)}>")
        return [tuple(out[i - 2 : i + 1]) for i in range(2, len(out))]

    tri = Counter(g for t in texts for g in walk(t) if g[-1] != "<run>")
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def discount(counts):
        n = [max(1, sum(v == i for v in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    d = {3: discount(tri), 2: discount(bi)}
    size, whole = len(known) + 7, sum(uni.values())
    after = {n: {} for n in (2, 3)}
    for n, counts in ((3, tri), (2, bi)):
        for g, v in counts.items():
            after[n].setdefault(g[:-1], []).append(v)

    def p(g):
        if len(g) == 1:
            return (uni[g] + 1 / size) / (whole + 1)
        n, counts = len(g), (tri if len(g) == 3 else bi)
        all_of = after[n].get(g[:-1])
        if not all_of:
            return p(g[1:])
        off = lambda v: d[n][min(v, 3) - 1]
        own = (counts[g] - off(counts[g])) / sum(all_of) if counts[g] else 0.0
        return own + sum(map(off, all_of)) / sum(all_of) * p(g[1:])

    def bits(text):
        return sum(-math.log2(p(g) / rare.get(g[-1], 1)) for g in walk(text))

    return bits, p, [*sorted(known), *makes, "<same>", "<run>"]


def test_quality_equals_plain_kneser_ney(spark, docs):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "w1 w1 w1 w1 w1", "Ab cd, XY a-b a1 ## a b a b a b", "p q r p q r p q r"]
    bits, p, names = plain_model(texts)
    assert sum(p(("w1", "w1", w)) for w in names) == pytest.approx(1) and sum(p(("w2", "nowhere", w)) for w in names) == pytest.approx(1)
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known, rare = quality.fit_words(sample)
    model = quality.fit(sample, known, rare)
    other = [(i, t) for i, t in enumerate([*texts, "never seen at all", "Never SEEN a7 !! x_y don't 日本 É", "w1 unseen w1 w2 w1 w2", "w2 w3 " * 4000])] + [(1000 + r.doc_id, r.text) for r in docs.where("doc_id < 13").collect()]
    rows = spark.createDataFrame(other, "doc_id long, text string").repartition(4)
    for most in (quality.FREQUENT, 40, 0):  # frequent n-grams where they stand, others by joins
        got = {r.doc_id: r for r in quality.totals(rows, model, known, most).collect()}
        for i, t in other:
            assert got[i].n_tokens == len((t or "").split()) and got[i].total == pytest.approx(bits(t), rel=1e-5, abs=1e-5)
    # what the bit filter lets pass by mistake has the same sum
    grams, whose, n = quality._trigrams(quality._Tokens(known), [t for _, t in other])
    parts, of, keys = quality.asked(np.full(quality.FILTER_BITS // 8, 255, np.uint8), grams)
    assert len(parts) == len(grams) and (parts == grams).all() and (keys == quality.gram_key(grams)).all()
    found = quality.surprise(spark.createDataFrame(pd.DataFrame(np.unique(grams, axis=0).astype(np.int32), columns=["a", "b", "c"])), model).collect()
    value = {(r.a, r.b, r.c): r.value for r in found}
    sums = np.bincount(whose, [value[tuple(g)] for g in grams.tolist()], len(other))
    assert [got[i].total for i, _ in other] == pytest.approx(list(sums), rel=1e-5, abs=1e-5)


def test_quality_in_parts_equals_plain_kneser_ney(spark, docs, tmp_path):
    """By the middle word, and with frequent words in several parts, in one round and in more."""
    rng = random.Random(19)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "w1 w1 w1 w1 w1", "Ab cd, XY a-b a1 ## a b a b a b", "p q r p q r p q r"]
    bits, _, _ = plain_model(texts)
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = quality.counted_words(sample)
    known, rare = quality.vocabulary(counted)
    other = [(i, t) for i, t in enumerate([*texts, "never seen at all", "w1 unseen w1 w2 w1 w2", "w2 w3 " * 4000])] + [(1000 + r.doc_id, r.text) for r in docs.where("doc_id < 13").collect()]
    rows = spark.createDataFrame(other, "doc_id long, text string").repartition(4)
    measured = middle.spread_of(counted, known, len(texts), 4, quality.MIN_COUNT)
    assert len(measured) > 1 and max(measured.values()) > 1
    for i, (spread, rounds) in enumerate((({}, 1), (measured, 3), ({t: 3 for t in range(1, 60)}, 2))):
        model = middle.fit(sample, known, rare, spread, f"file://{tmp_path}/{i}")
        got = {r.doc_id: r for r in middle.totals(rows, model, rounds).collect()}
        assert len(got) == len(other)
        for i, t in other:
            assert got[i].n_tokens == len((t or "").split()) and got[i].total == pytest.approx(bits(t), rel=1e-5, abs=1e-4)


def test_quality_is_fitted_on_all_trusted_documents(spark):
    rng = random.Random(23)
    texts = [" ".join(f"x{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(3, 7))) for _ in range(14_500)]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    held = {r[0] for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0).collect()}
    fitted = [t for i, t in enumerate(texts) if i not in held]
    assert len(fitted) > 10_000
    bits, _, _ = plain_model(fitted)
    total = [bits(t) for t in texts]
    n = [len(t.split()) for t in texts]
    mean = sum(total[i] for i in held) / sum(n[i] for i in held)
    want = [(x + quality.PRIOR_TOKENS * mean) / (k + quality.PRIOR_TOKENS) for x, k in zip(total, n, strict=True)]
    got = {r.doc_id: r.surprise for r in quality.classify(docs, labels).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_places_of_keys(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, keys[: n // 3] + np.uint64(1), np.arange(min(n, 40), dtype=np.uint64)]))
    asked = rng.permutation(np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    want = np.where(keys[at] == asked, at, -1) if len(keys) else np.full(len(asked), -1)
    assert (quality._Places(keys).find(asked) == want).all()


def test_quality_limits_are_quantiles_of_held_out_scores(spark):
    """Limit and verdict of every document, ties at the limit among them, from the sorted scores."""
    rng = random.Random(12)
    vocabulary = [f"v{int(rng.paretovariate(0.9))}" for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 50))) for _ in range(700)]
    rows = [(i, t, "aa" if i % 5 < 3 else "bb" if i % 5 == 3 else None if i % 35 else "cc") for i, t in enumerate(texts)]
    rows += [(2000 + i, texts[i], "aa") for i in range(0, 700, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[0] % 11 != 0), 0) for r in rows if r[0] % 7], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, quantile=0.9, margin=0.05).collect()}
    good = labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0)
    held = {r.doc_id for r in good.collect()}
    lang = {r[0]: r[2] for r in rows}

    def cut(scores):
        return sorted(scores)[math.ceil(0.9 * len(scores)) - 1] + 0.05

    by_lang = {x: [got[i].surprise for i in held if lang[i] == x] for x in {*lang.values()}}
    everywhere = cut([got[i].surprise for i in held])
    limits = {x: cut(v) if len(v) >= quality.MIN_TRUSTED else everywhere for x, v in by_lang.items()}
    assert sum(len(v) >= quality.MIN_TRUSTED for v in by_lang.values()) == 1  # one language of its own, the others share
    assert len(got) == len(rows) and {r.kept for r in got.values()} == {True, False}
    for i, r in got.items():
        assert r.limit == pytest.approx(limits[lang[i]], abs=1e-9) and r.kept == (r.surprise <= r.limit)


def test_quality_limits_are_exact_however_many_scores(spark):
    """More scores than a summary of them would tell apart, with ties and a language of one score."""
    rng = np.random.default_rng(3)
    scores = {"aa": rng.normal(9, 1.5, 400_000), "bb": np.repeat(rng.normal(9, 1, 700), 3), None: rng.normal(12, 2, 1000), "cc": np.full(60, 7.25), "dd": np.full(3, 5.0)}
    rows = pd.DataFrame({"lang": [x for x, v in scores.items() for _ in v], "total": np.concatenate([*scores.values()])})
    scored = spark.createDataFrame(rows).selectExpr("monotonically_increasing_id() as doc_id", "lang", "1000000000000L as n_tokens", "total * n_tokens as total", "true as trusted").repartition(7).cache()
    for q in (0.0, 0.5, 0.999, 1.0):
        drawn = quality._judged(scored, q, 0.0).select("lang", "surprise", "limit", "kept").toPandas()
        every = np.sort(drawn.surprise.to_numpy())
        for lang, v in scores.items():
            own = drawn[drawn.lang.isna()] if lang is None else drawn[drawn.lang == lang]
            among = np.sort(own.surprise.to_numpy()) if len(v) >= quality.MIN_TRUSTED else every
            want = among[max(0, math.ceil(q * len(among)) - 1)]
            assert len(own) == len(v) and set(own.limit) == {want} and (own.kept == (own.surprise <= want)).all()


def test_quality_edges(docs, empty, spark):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and got.where("n_tokens = 0 and not kept").count() == 0
    assert quality.classify(docs, labels.limit(0)).where("not kept").count() == 0
    assert quality.classify(empty, labels).count() == 0
    clash = docs.withColumns({"judged": F.lit(1), "Gone": F.lit("x"), "kept": F.lit(2), "score": F.lit(0)})
    good = quality.keep_good(clash, labels)
    assert good.columns == clash.columns and good.where("judged <> 1").count() == 0
