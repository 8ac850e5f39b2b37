import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.llm import importance, merkle, repeats

TEXT = "doc_id long, text string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# --- repeats -----------------------------------------------------------------


def plain_repeats(text, least):
    """Every pair of positions, symbol by symbol."""
    n = len(text)
    inside, longest = [False] * n, 0
    same = [[0] * (n + 1) for _ in range(n + 1)]
    for p in range(n - 1, -1, -1):
        for q in range(n - 1, -1, -1):
            same[p][q] = same[p + 1][q + 1] + 1 if p != q and text[p] == text[q] else 0
    for p in range(n):
        m = max((same[p][q] for q in range(n) if q != p), default=0)
        if m >= least:
            longest = max(longest, m)
            inside[p : p + m] = [True] * m
    return inside, longest


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=40) | st.text(alphabet="aé日🙂 \n", max_size=40), st.integers(8, 20), st.integers(0, 40), st.integers(0, 40))
def test_repeated_spans_are_all_there_is(text, least, a, b):
    text = text + text[a:] + text[:b]
    spans, longest = repeats.repeated_spans(text, least)
    inside, want = plain_repeats(text, least)
    assert longest == want and [any(s <= i < e for s, e in spans) for i in range(len(text))] == inside


def test_repeated_spans_of_long_texts():
    rng = random.Random(3)
    for size in (5_000, 60_000):
        text = "".join(rng.choice("abcdefgh 日") for _ in range(size))
        twice = text + "|" + text[100:3_100] + "#"
        spans, longest = repeats.repeated_spans(twice, 40)
        assert longest == 3_000 and spans == [(100, 3_100), (size + 1, size + 3_001)]
    for text in ("a" * 200_000, "ab" * 100_000, "word " * 40_000, "".join(map(chr, range(0x4E00, 0x4E00 + 7_000))) * 20, "".join(map(chr, range(0x10000, 0x21170))) * 2):
        spans, longest = repeats.repeated_spans(text, 40)
        assert spans == [(0, len(text))] and longest >= len(text) // 2


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, lines = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    bad = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(inside), bad


def test_rules_against_plain_ones(spark, docs, empty):
    got = repeats.rules(docs, least=12)
    assert repeats.rules(empty).count() == 0 and got.count() == docs.count() and got.columns == repeats.rules(empty).columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.collect():
        text = texts[r.doc_id]
        assert tuple(r)[1:7] == plain_counts(text)
        if len(text) < 700:
            inside, longest = plain_repeats(text, 12)
            n = sum(inside)
            assert (r.n_chars_repeated, r.longest_repeat) == (n, longest)
            assert r.kept == (not r.base_failed and 100 * n <= repeats.COVERED_PERCENT * len(text) and (longest <= repeats.LONGEST_FREE or 100 * longest <= repeats.LONGEST_PERCENT * len(text)))
    kept = {r.doc_id for r in repeats.rules(docs).where("kept").collect()}
    assert {r.doc_id for r in repeats.keep_varied(docs).collect()} == kept


def test_rules_reject_what_repeats_and_keep_what_does_not(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    clean = " ".join(prose(400))
    passage = " ".join(prose(60))
    half = " ".join(prose(100))
    odd = half + " " + " ".join(prose(60)) + " " + half  # three-word windows fail too
    spaced = "".join(words[:200]) * 2 + " " + " ".join(prose(60))  # one word twice the text: only the spans see it
    texts = [clean, clean + " " + passage, passage + " " + clean + " " + passage, odd, spaced]
    got = [r.kept for r in repeats.rules(spark.createDataFrame(list(enumerate(texts)), TEXT).repartition(1)).orderBy("doc_id").collect()]
    assert got == [True, True, True, False, False]


# --- importance resampling ---------------------------------------------------


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(docs, target, longest, buckets, min_words, percent):
    def found(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in found(x)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        own = found(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_and_features(text):
    own = importance.words_of(text)
    assert [w.decode() for w in own] == plain_words(text)
    assert importance.features(own, 3) == [zlib.crc32(b" ".join(own[i : i + k])) for k in (1, 2, 3) for i in range(len(own) - k + 1)]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 300, 35)])
def test_resampling_against_a_plain_one(spark, docs, empty, longest, buckets, percent):
    target = ["alpha beta gamma the of", "Über alpha1 beta2", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    own = docs.union(docs.where("doc_id = 40")).union(docs.where("doc_id = 41").withColumn("doc_id", F.lit(None).cast("long")))  # a repeated row, a null id
    options = {"longest": longest, "buckets": buckets, "percent": percent}
    got = importance.resample(own, bench, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = [(r.doc_id, r.text) for r in own.collect()]
    assert rows(got, *got.columns) == plain_resample(plain, target, longest, buckets, 20, percent)
    assert importance.resample(empty, bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).count() == docs.count()
    ids = {r.doc_id for r in importance.resample(docs, bench, **options).where("rank is not null").collect()}
    taken = importance.drawn(docs, bench, **options)
    assert taken.columns == docs.columns and {r.doc_id for r in taken.collect()} == ids


# --- manifest ----------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Levels of a tree, and siblings of every leaf."""
    levels, proofs = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i, proof in enumerate(proofs):
            at = i // 3 ** (len(levels) - 1)
            run = range(at - at % 3, min(len(last), at - at % 3 + 3))
            proof.append(("".join(last[k] for k in run if k < at), "".join(last[k] for k in run if k > at)))
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels[-1][0] if nodes else None, proofs


def plain_manifest(table, changed):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(told, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
    groups = {}
    for r in table:
        now = leaf(r) if not changed(r) or r.text is None else h(*map(told, (r.doc_id, r.source, r.lang, r.n_chars, r.text.replace("\n", ""))))
        groups.setdefault(r.source, []).append((r.doc_id, leaf(r), now))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in groups[s]]) for s in order}
    root, over = plain_tree([trees[s][0] for s in order])
    out = []
    for s, outer in zip(order, over, strict=True):
        for (doc_id, first, now), local in zip(groups[s], trees[s][1], strict=True):
            node = now
            for before, behind in local + outer:
                node = h(before, node, behind)
            out.append((doc_id, first, trees[s][0], root, h(*(x for level in local + outer for x in level)), node, node == root))
    return sorted(out, key=str)


def odd_ids(text):
    return F.when(F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(F.col(text))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_against_a_plain_one(spark, docs, height):
    one = spark.createDataFrame([(9000, "only\none", "en", "zz", 8, 0, "", 0)], docs.schema)
    own = docs.union(docs.where("doc_id = 30")).union(one).union(docs.where("doc_id = 31").withColumn("doc_id", F.lit(None).cast("long")))
    got = merkle.manifest(own, changed={"text": odd_ids("text")}, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(got, *got.columns) == plain_manifest(own.collect(), lambda r: r.doc_id is not None and r.doc_id % 2 == 1)
    assert 0 < got.where("not verified").count() < got.count()


def test_manifest_of_few_rows_and_many_sources(spark, docs, empty):
    assert merkle.manifest(empty).count() == 0
    single = merkle.manifest(docs.where("doc_id = 20"), with_proof=True).collect()
    assert single and all(r.verified for r in single)
    one = merkle.manifest(docs.where("doc_id = 20").limit(1), with_proof=True).first()
    assert one.proof == [] and one.root == one.leaf == one.subroot and one.proof_sha256 == h("")
    many = docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 97).cast("string")))
    got = merkle.manifest(many, with_proof=True, height=2)
    assert rows(got, *[c for c in got.columns if c != "proof"]) == plain_manifest(many.collect(), lambda r: False)
    for r in got.collect():
        assert merkle.folded(r.leaf, [(x.before, x.behind) for x in r.proof]) == r.root and r.verified
