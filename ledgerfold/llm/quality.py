"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are words between white space. A word that the trusted sample has less than
MIN_COUNT times is unknown; unknown words are told apart by their make (small letters,
a capital before them, capitals, with digits, other), and the probability of each make
is shared by as many words as the sample has of it. Other than that the vocabulary has
no limit. A word that repeats the one before it is a token of its own, and so is one
that goes on with a repetition of one to three words; that one is never learnt, so each
further repeat is a full surprise.

A quarter of the trusted documents, by the hash of their ids, is held out: the limits
are quantiles of their scores, which the model has not been fitted to. It is fitted on
all others (``middle``: counted and asked in parts, by the middle word).

For tables of n-grams there is the model as a table (``fit``, ``surprise``, ``totals``).
The surprise of a word whose trigram the model has not seen is that of its context and
of its bigram, and so on down: log(left) + log(lower). So each word asks for one seen
n-gram, or for contexts and a shorter one. A bit filter of fixed size, made from the
model, tells what cannot have been seen; what passes by mistake is taken apart when its
join finds nothing. The FREQUENT most frequent n-grams go to every task; the others meet
the model's shards in packed lists dealt by n-gram, once for each chunk of documents.

A document's score is its mean surprise in bits, drawn towards its language's mean as
far as it is short; it is kept up to a quantile of the held-out scores of its language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import middle
from .bpe import small_batches
from .chunks import LISTS, expand, squeeze
from .common import fresh_name, materialize, scratch, shared_dir, shuffles_removed
from .common import mix64 as _mix

MIN_COUNT = 2
QUANTILE = 0.999
MARGIN = 0.4
PRIOR_TOKENS = 12
MIN_TRUSTED = 50
#: Bits of the filter, and how many an n-gram sets; n-grams that go to every task; n-grams
#: of documents that close a chunk.
FILTER_BITS, FILTER_MARKS, FREQUENT, CHUNK_GRAMS = 1 << 26, 3, 1 << 21, 1 << 20
#: Words up to which their probabilities are sent to the tasks; more are joined by a shuffle.
SENT_WORDS = 1 << 20

#: No word (in a context or a shorter n-gram), before the text, the word before again, a
#: repetition going on; unknown words by their make; known words from WORD on, by the order of their ids.
NONE, START, SAME, RUN, UNKNOWN, WORD = -1, 1, 2, 3, (4, 5, 6, 7, 8), 16
_SLICE = 1 << 16
#: Steps of a bit that scores are counted by before they are put in order.
STEPS = 1024


def words(text: str | None) -> list[str]:
    """Words between white space; none in a null text."""
    return (text or "").split()


def make(word: str) -> int:
    """Small letters 0, a capital before them 1, capitals 2, with digits 3, other 4; one
    mark at the end, hyphens and apostrophes do not count."""
    if word.isalpha():  # most words
        return _cased(word)
    core = word.rstrip(".,;:!?")
    letters = core.replace("'", "").replace("’", "").replace("-", "")
    if len(word) - len(core) > 1 or not letters:
        return 4
    if letters.isalpha():
        return _cased(letters)
    return 3 if any(c.isdigit() for c in letters) and letters.isalnum() else 4


def _cased(letters: str) -> int:
    if letters == letters.lower():
        return 0
    return 1 if letters[1:] == letters[1:].lower() else 2 if letters == letters.upper() else 4


def word_id(word: str) -> int:
    """63 bits that stand for a word, the last three for its make."""
    return max(xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) >> 1, 16) & ~7 | make(word)


class _Tokens(dict):
    """What stands for a word, found once: its token in the low 32 bits, above it 31 bits
    of its id that tell it from others of the same token. Starts anew when it holds too much."""

    def __init__(self, known: np.ndarray):
        self.known = known

    def __missing__(self, word: str) -> int:
        return int(self._found([word])[0])  # long ones, which are not kept

    def _found(self, new: list[str]) -> np.ndarray:
        own = np.fromiter(map(word_id, new), np.int64, len(new))
        at = np.searchsorted(self.known, own)
        there = np.zeros(len(new), bool)
        if len(self.known):
            there = self.known[np.minimum(at, len(self.known) - 1)] == own
        return (own >> 3 & 0x7FFFFFFF) << 32 | np.where(there, WORD + at, UNKNOWN[0] + (own & 7))

    def learn(self, found: list[list[str]]) -> None:
        """All new words of some texts at once."""
        if len(self) > 300_000:
            self.clear()
        new = [w for w in set().union(*found) if w not in self and len(w) <= 64]
        self.update(zip(new, self._found(new).tolist(), strict=True))


def _trigrams(tokens: _Tokens, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all trigrams (two START before each text), the text of each, and words per text."""
    split = [words(t) for t in texts]
    tokens.learn(split)
    found = [list(map(tokens.__getitem__, x)) for x in split]
    n = np.array([len(f) for f in found], np.int64)
    raw = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
    whose = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
    c = raw & 0xFFFFFFFF
    run = np.zeros(len(raw), bool)
    for period in (1, 2, 3):
        again = (nth >= period) & (raw == np.roll(raw, period))
        run |= again & np.roll(again, 1) & (nth > period)
        if period == 1:
            c[again] = SAME
    c[run] = RUN
    b = np.where(nth > 0, np.roll(c, 1), START)
    a = np.where(nth > 1, np.roll(c, 2), START)
    return np.stack([a, b, c], 1), whose, n


def _key(*tokens: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int64).view(np.uint64) for x in tokens)
    return _mix(_mix(_mix(a + np.uint64(0x9E3779B97F4A7C15)) + b) + c)


def gram_key(grams: np.ndarray) -> np.ndarray:
    """64 bits that stand for an n-gram or a context (NONE where it has no word)."""
    return _key(*(grams[:, i] for i in range(3)))


def _mark(keys: np.ndarray, i: int) -> np.ndarray:
    """The filter's ``i``-th bit of each key; FILTER_BITS is a power of two."""
    return ((keys + np.uint64(i) * (keys >> np.uint64(32) | np.uint64(1))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def may_be_seen(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    live = np.arange(len(keys))
    for i in range(FILTER_MARKS):  # most of what was not seen goes at the first bit
        at = _mark(keys[live], i)
        live = live[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    out = np.zeros(len(keys), bool)
    out[live] = True
    return out


def asked(bits: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the surprise of each trigram is the sum of: rows of n-grams and contexts,
    the trigram of each, and their keys."""
    every = np.arange(len(grams))
    key = gram_key(grams)
    seen = may_be_seen(bits, key)
    parts = [(grams[seen], every[seen], key[seen])]
    rest = every[~seen]
    a, b, c = grams[rest].T
    none = np.full(len(rest), NONE)

    def part(here: np.ndarray, key: np.ndarray | None, *tokens: np.ndarray) -> None:
        own = [t[here] for t in tokens]
        parts.append((np.stack(own, 1), rest[here], _key(*own) if key is None else key[here]))

    context, bigram = _key(a, b, none), _key(none, b, c)
    known = may_be_seen(bits, bigram)
    part(may_be_seen(bits, context), context, a, b, none)
    part(known, bigram, none, b, c)
    part(~known, None, none, b, none)
    part(~known, None, none, none, c)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Places:
    """Where a key stands among sorted ones that are spread evenly: by its first bits, then
    step by step through the few keys that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift))))]).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        out = np.full(len(key), -1)
        if not len(self.keys):
            return out
        head = (key >> self.shift).astype(np.int64)
        live, at, end = np.arange(len(key)), self.starts[head], self.starts[head + 1]
        while True:
            inside = at < end
            live, at, end = live[inside], at[inside], end[inside]
            if not len(live):
                return out
            there, own = self.keys[at], key[live]
            hit = there == own
            out[live[hit]] = at[hit]
            more = there < own
            live, at, end = live[more], at[more] + 1, end[more]


def fit_words(sample: DataFrame, min_count: int = MIN_COUNT, folder: str | None = None) -> tuple[np.ndarray, list[int]]:
    """Sorted ids of the known words, and the number of words of each make that are rarer.
    They are bounded by the sample: at most its words by ``min_count``."""
    return vocabulary(counted_words(sample, folder), min_count)


def vocabulary(counted: DataFrame, min_count: int = MIN_COUNT) -> tuple[np.ndarray, list[int]]:
    known = counted.where(F.col("n") >= min_count).select("word").toArrow().column("word")
    rare = {r[0]: r[1] for r in counted.where(F.col("n") < min_count).groupBy(F.col("word").bitwiseAND(7)).count().collect()}
    return np.sort(np.asarray(known.combine_chunks(), np.int64)), [rare.get(i, 0) for i in range(len(UNKNOWN))]


def counted_words(sample: DataFrame, folder: str | None = None) -> DataFrame:
    """``word, n``: ids of all words of the sample and how often it has them."""

    def run(batches):
        for b in small_batches(batches, 1024):
            counted = Counter(w for t in b.column(0).to_pylist() for w in words(t))
            yield pa.RecordBatch.from_arrays([pa.array(map(word_id, counted), pa.int64()), pa.array(counted.values(), pa.int64())], ["word", "n"])

    return materialize(sample.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), folder and f"{folder}/words")


def _discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney discounts by the numbers of n-grams with counts of one to four."""
    n = [max(1.0, x) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def _off(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def shared_by(c: Column, rare: list[int]) -> Column:
    """Number of words that the token stands for."""
    out = F.lit(1.0)
    for token, n in zip(UNKNOWN, rare, strict=True):
        out = F.when(c == token, float(max(1, n))).otherwise(out)
    return out


def fit(sample: DataFrame, known: np.ndarray, rare: list[int], folder: str | None = None) -> dict:
    """The model: ``bits`` has ``a, b, c, value, weight``, the surprise in bits of every
    seen trigram, every seen bigram (no ``a``) and word (neither), and of leaving a context
    (no ``c``), each with its count in the sample.

    Trigrams are dealt by their middle word, so contexts, bigrams and the words before
    and after it meet in one place: all sums are windows over what is there, and the
    numbers of n-grams by count, which give the discounts, are kept with the middle word.
    """

    def run(batches):
        tokens = _Tokens(known)
        for b in small_batches(batches, 1024):
            grams, _, _ = _trigrams(tokens, b.column(0).to_pylist())
            one, n = np.unique(grams, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(one[:, i], pa.int32()) for i in range(3)), pa.array(n, pa.int32())], ["a", "b", "c", "n"])

    raw = sample.select("text").mapInArrow(run, "a int, b int, c int, n int").where(F.col("c") != RUN)  # never learnt
    a, b, c, n, n2 = (F.col(x) for x in ("a", "b", "c", "n", "n2"))
    ab, bc, of_b = Window.partitionBy("a", "b"), Window.partitionBy("b", "c"), Window.partitionBy("b")
    tri = raw.repartition("b").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    tri = tri.select(
        "*", F.count(F.lit(1)).over(bc).alias("n2"), F.sum("n").over(bc).alias("w2"), (a == F.min("a").over(bc)).alias("is_bigram"),  # n2: how many words come before
        F.sum("n").over(ab).alias("all3"), *[F.count_if(test).over(ab).alias(name) for name, test in (("ones", n == 1), ("twos", n == 2), ("more", n > 2))], (c == F.min("c").over(ab)).alias("is_context"),
    )
    per = {"all2": F.count(F.lit(1)), "w1": F.sum("n"), "more2": F.sum(F.when(n2 > 2, 1 / n2).otherwise(0.0))}
    per |= {f"tri{i}": F.count_if(n == i) for i in (1, 2, 3, 4)} | {f"bi{i}": F.sum(F.when(n2 == i, 1 / n2).otherwise(0.0)) for i in (1, 2, 3, 4)}
    tri = tri.select("*", (F.struct("a", "c") == F.min(F.struct("a", "c")).over(of_b)).alias("is_word"), *[x.over(of_b).alias(name) for name, x in per.items()])
    tri = materialize(tri.withColumns({f"{kind}{i}": F.when(F.col("is_word"), F.col(f"{kind}{i}")) for kind, low in (("tri", 1), ("bi", 3)) for i in range(low, 5)}), folder and f"{folder}/trigrams")
    seen = tri.where("is_word").agg(*[F.coalesce(F.sum(f"{kind}{i}"), F.lit(0)).cast("double") for kind in ("tri", "bi") for i in (1, 2, 3, 4)]).first()
    d3, d2 = _discounts(*seen[:4]), _discounts(*seen[4:])
    uni = materialize(tri.where("is_bigram").groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("w2").alias("weight")), folder and f"{folder}/words")
    total, size = uni.agg(F.sum("m")).first()[0] or 0, len(known) + len(UNKNOWN) + 2
    floor = 1.0 / size / (total + 1.0)
    p1 = uni.select("c", (F.col("m") / (total + 1.0) + floor).alias("p1"), "weight")
    sent = F.broadcast(p1.select("c", "p1")) if len(known) <= SENT_WORDS else p1.select("c", "p1")

    by = shared_by(c, rare)
    left3 = (d3[0] * F.col("ones") + d3[1] * F.col("twos") + d3[2] * F.col("more")) / F.col("all3")
    left2 = (d2[0] * F.col("bi1") + d2[1] * F.col("bi2") + d2[2] * F.col("more2")) / F.col("all2")
    mid = (n2 - _off(n2, d2)) / F.col("all2") / by + left2 * F.col("p1") / by
    high = (n - _off(n, d3)) / F.col("all3") / by + left3 * mid
    none = F.lit(NONE)

    def row(a, b, c, p, weight):
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (-F.log2(p)).cast("float").alias("value"), weight.cast("long").alias("weight"))

    made = F.array(
        row(a, b, c, high, n),
        F.when(F.col("is_context"), row(a, b, none, left3, F.col("all3"))),
        F.when(F.col("is_bigram"), row(none, b, c, mid, F.col("w2"))),
        F.when(F.col("is_word"), row(none, b, none, left2, F.col("w1"))),
    )
    words_alone = p1.select(F.inline(F.array(row(none, none, c, F.col("p1") / by, F.col("weight")))))
    bits = tri.join(sent, "c").select(F.inline(F.filter(made, lambda x: x.isNotNull()))).union(words_alone)
    return {"bits": bits, "floor": floor, "rare": rare}


def bit_filter(grams: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, in which every n-gram and context of ``a, b, c`` is set."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            keys = _key(*(np.asarray(x, np.int64) for x in b.columns))
            for i in range(FILTER_MARKS):
                at = _mark(keys, i)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(0, len(bits), _SLICE):
            if bits[i : i + _SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstandard.compress(bits[i : i + _SLICE].tobytes())], pa.binary())], ["at", "bits"])

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(zstandard.decompress(x), np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"at": rows["at"].iloc[:1], "bits": [whole.tobytes()]})

    slices = grams.select("a", "b", "c").mapInArrow(run, "at int, bits binary").groupBy("at").applyInPandas(either, "at int, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slices.collect():  # the filter's fixed size in all
        out[r["at"] : r["at"] + _SLICE] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent(bits_table: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and values of the n-grams of the greatest weights, at most ``most`` of
    them, and the weight from which on they are frequent."""
    by_weight = bits_table.groupBy(F.least("weight", F.lit(1 << 16)).alias("w")).count().orderBy(F.desc("w")).collect()  # 65536 rows at most
    ends = np.cumsum([r["count"] for r in by_weight])
    enough = int((ends <= most).sum())
    least = by_weight[enough - 1]["w"] if enough else 1 << 62
    got = bits_table.where(F.col("weight") >= least).select("a", "b", "c", "value").toArrow()
    key = gram_key(np.stack([np.asarray(got.column(x).combine_chunks(), np.int64).reshape(-1) for x in "abc"], 1))
    order = np.argsort(key)
    return key[order], np.asarray(got.column("value").combine_chunks(), np.float32).reshape(-1)[order], least


_LIST = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("packed", pa.binary()), ("values", pa.binary())])
_CHUNK = pa.schema(
    [*_LIST, ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64())), ("held", pa.list_(pa.int64())), ("which", pa.binary()), ("times", pa.binary())]
)
_LIST_ROW = "chunk long, part int, start int, packed binary, values binary"


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """Rows of which only some columns are given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _unsqueeze(x: bytes) -> np.ndarray:
    return expand(x, zstandard.frame_content_size(x) // 4)


def _unpacked(x: bytes) -> np.ndarray:
    """The n-grams of a packed list: steps from one first word to the next, then the other words."""
    a, b, c = _unsqueeze(x).view(np.int32).reshape(3, -1)
    return np.stack([np.cumsum(a, dtype=np.int32), b, c], 1)


def _dealt(grams: np.ndarray, keys: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, Callable]:
    """The order of n-grams by part and, in a part, by words; where each list of a part
    begins; and its columns, given the n-grams in that order."""
    part = (keys % np.uint64(lists)).astype(np.int32)
    order = np.lexsort((*grams.T[::-1], part))
    part = part[order]
    starts = np.nonzero(np.diff(part, prepend=-1))[0]

    def columns(grams: np.ndarray) -> dict:
        each = [np.concatenate([np.diff(g[:, 0], prepend=np.int32(0)), g[:, 1], g[:, 2]]) for g in np.split(grams, starts[1:])]
        return {"part": part[starts], "start": starts, "packed": [squeeze(x.view(np.uint32)) for x in each]}

    return order, starts, columns


def _chunked(rows: DataFrame, shared) -> DataFrame:
    """Chunks of documents: a dictionary of the n-grams that are asked for, in lists by
    part (``part, start, packed``), and for each document its words, the bits of the
    frequent ones, and which of the dictionary it asks for how often."""
    lists = _lists(rows)

    def run(batches):
        from pyspark import TaskContext

        known, bits, keys, values = shared.value
        tokens, places, number, size = _Tokens(known), _Places(keys), TaskContext.get().partitionId() << 32, 0
        parts: list[tuple] = []

        def close():
            who, n, sums, held, asked_for, grams, often = (np.concatenate(x) for x in zip(*parts, strict=True))
            one, first, place = np.unique(asked_for, return_index=True, return_inverse=True)
            grams = grams[first]
            order, starts, columns = _dealt(grams, one, lists)
            place = np.argsort(order)[place]
            by_doc = np.argsort(np.repeat(np.arange(len(held)) << 32, held) | place)
            place, often = place[by_doc], often[by_doc]
            ends = np.cumsum(held)
            steps = np.diff(place, prepend=0)  # a document's are in order, so places only grow
            steps[(ends - held)[held > 0]] = place[(ends - held)[held > 0]]
            yield _rows(_CHUNK, 1, chunk=[number], doc_ids=[who], n_tokens=[n], sums=[sums], held=[held], which=[squeeze(steps)], times=[squeeze(often)])
            if len(one):
                yield _rows(_CHUNK, len(starts), chunk=np.full(len(starts), number), **columns(grams[order]))

        for b in small_batches(batches, 32):
            grams, whose, n = _trigrams(tokens, b.column(1).to_pylist())
            grams, of, key = asked(bits, grams)
            whose, at = whose[of], places.find(key)
            here = at >= 0
            sums = np.bincount(whose[here], values[at[here]].astype(np.float64), len(n))
            key, whose, grams = key[~here], whose[~here], grams[~here].astype(np.int32)
            order = np.lexsort((key, whose))
            key, whose, grams = key[order], whose[order], grams[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])
            often = np.diff(np.append(np.nonzero(new)[0], len(key)))
            who = np.array(b.column(0).to_pylist(), object)
            parts.append((who, n, sums, np.bincount(whose[new], minlength=len(n)), key[new], grams[new], often.astype(np.int32)))
            size += int(new.sum())
            if size >= CHUNK_GRAMS:
                yield from close()
                number, parts, size = number + 1, [], 0
        if parts:
            yield from close()

    kind = f"{_LIST_ROW}, doc_ids array<long>, n_tokens array<long>, sums array<double>, held array<long>, which binary, times binary"
    return materialize(rows.select("doc_id", "text").mapInArrow(run, kind))


def _lists(rows: DataFrame) -> int:
    """Parts that n-grams are dealt to."""
    return LISTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shards(bits: DataFrame) -> DataFrame:
    """The model's n-grams and their values in packed lists by part, CHUNK_GRAMS at a time."""
    lists = _lists(bits)

    def run(batches):
        parts: list[tuple] = []
        size = 0

        def close():
            grams, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, starts, columns = _dealt(grams, gram_key(grams), lists)
            yield _rows(_LIST, len(starts), values=[squeeze(v.view(np.uint32)) for v in np.split(values[order], starts[1:])], **columns(grams[order]))

        for b in batches:
            if b.num_rows:
                parts.append((np.stack([np.asarray(b.column(i), np.int32) for i in range(3)], 1), np.asarray(b.column(3), np.float32)))
                size += b.num_rows
            if size >= CHUNK_GRAMS:
                yield from close()
                parts, size = [], 0
        if parts:
            yield from close()

    return bits.select("a", "b", "c", "value").mapInArrow(run, _LIST_ROW)


def _priced(asked_for: DataFrame, shards: DataFrame) -> DataFrame:
    """``chunk, start, values`` for each list of a chunk, and ``no, a, b, c``: places and words of
    the n-grams that its part's shard has not. Only that shard is held, a share of the model."""

    def run(batches):
        last, shard, places, values = None, [], None, None
        for b in batches:
            for chunk, part, start, packed, own in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if part != last:
                    last, shard, places = part, [], None
                if own is not None:
                    shard.append((gram_key(_unpacked(packed)), _unsqueeze(own).view(np.float32)))
                    continue
                if places is None:
                    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in shard)])
                    order = np.argsort(keys)
                    places = _Places(keys[order])
                    values = np.append(np.concatenate([np.zeros(0, np.float32), *(v for _, v in shard)])[order], np.float32(np.nan))
                    shard = []
                grams = _unpacked(packed)
                got = values[places.find(gram_key(grams))]  # the last one, not a number, where there is no place
                no = np.nonzero(np.isnan(got))[0]
                columns = [[chunk], [start], [squeeze(got.view(np.uint32))], [no + start], *([grams[no, i]] for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["chunk", "start", "values", "no", "a", "b", "c"])

    kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 4]
    both = asked_for.union(shards).repartition("part").sortWithinPartitions("part", F.col("values").isNull())
    return materialize(both.mapInArrow(run, "chunk long, start int, values binary, no array<int>, a array<int>, b array<int>, c array<int>"))


def taken_apart(unseen: DataFrame, model: dict) -> DataFrame:
    """``a, b, c, value`` of distinct n-grams and contexts that the model has not: a trigram is
    context and bigram, a bigram context and word; an unseen context leaves all of its mass."""
    id3, none = ["a", "b", "c"], F.lit(NONE)
    asked_for = materialize(unseen.select(F.struct(*id3).alias("of"), *id3))
    pieces = [F.struct(x.alias("a"), y.alias("b"), z.alias("c")) for x, y, z in ((F.col("a"), F.col("b"), none), (none, F.col("b"), F.col("c")), (none, F.col("b"), none), (none, none, F.col("c")))]
    wanted = unseen.sparkSession.sparkContext.broadcast(bit_filter(asked_for.select(F.inline(F.array(*pieces)))))  # FILTER_BITS

    def asked_for_here(batches):
        for b in batches:
            yield b.filter(pa.array(may_be_seen(wanted.value, _key(*(np.asarray(b.column(i), np.int64) for i in range(3))))))

    shorter = model["bits"].where(f"a = {NONE} or c = {NONE}").select(*id3, "value")
    bits = materialize(shorter.mapInArrow(asked_for_here, "a int, b int, c int, value float"))  # once for all rounds, and only what they look up
    done = []
    for _ in range(3):
        a, b, c = (F.col(x) for x in id3)
        least = -F.log2(F.lit(model["floor"]) / shared_by(c, model["rare"]))
        parts = F.when((a != NONE) & (c != NONE), F.array(F.struct(a.alias("a"), b.alias("b"), none.alias("c")), F.struct(none.alias("a"), b.alias("b"), c.alias("c")))).when(
            (b != NONE) & (c != NONE), F.array(F.struct(none.alias("a"), b.alias("b"), none.alias("c")), F.struct(none.alias("a"), none.alias("b"), c.alias("c")))
        )
        alone = asked_for.where((c == NONE) | (b == NONE))
        done.append(alone.select("of", F.when(c == NONE, 0.0).otherwise(least).alias("value")))
        asked_for = asked_for.where((c != NONE) & (b != NONE)).select("of", F.explode(parts).alias("p")).select("of", "p.*")
        priced = materialize(asked_for.join(bits, id3).select("of", *id3, F.col("value").cast("double").alias("value")))
        done.append(priced.select("of", "value"))
        asked_for = materialize(asked_for.join(priced.select("of", *id3), ["of", *id3], "left_anti"))
    rest = done[0]
    for more in done[1:]:
        rest = rest.union(more)
    return rest.groupBy("of").agg(F.sum("value").cast("float").alias("value")).select("of.*", "value")


def surprise(rows: DataFrame, model: dict) -> DataFrame:
    """``a, b, c, value``: bits of the n-gram or context of each row, by a join with the
    model's table; what it has not seen is taken apart. For tables of n-grams: documents
    are scored by ``totals``."""
    id3 = ["a", "b", "c"]
    found = materialize(rows.join(model["bits"].select(*id3, "value"), id3, "left").select(*id3, "value"))
    unseen = found.where("value is null").select(*id3)
    return found.where("value is not null").union(unseen.join(taken_apart(unseen.distinct(), model), id3))


def totals(rows: DataFrame, model: dict, known: np.ndarray, most: int = FREQUENT) -> DataFrame:
    """``doc_id, n_tokens, total``: words and surprise in bits of each row of ``doc_id, text``."""
    keys, values, least = frequent(model["bits"], most)
    shared = rows.sparkSession.sparkContext.broadcast((known, bit_filter(model["bits"]), keys, values))  # bounded by the sample, FILTER_BITS and ``most``
    held = _chunked(rows, shared)
    answers = _priced(held.where("packed is not null").select(*_LIST.names), _shards(model["bits"].where(F.col("weight") < least)))
    unseen = answers.where("size(no) > 0").select("chunk", F.inline(F.arrays_zip("no", "a", "b", "c")))
    mended = unseen.join(taken_apart(unseen.select("a", "b", "c").distinct(), model), ["a", "b", "c"]).groupBy("chunk").agg(F.collect_list(F.struct("no", "value")).alias("mended"))
    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("start", "values")).alias("prices"))
    own = held.where("doc_ids is not null").select("chunk", "doc_ids", "n_tokens", "sums", "held", "which", "times")
    both = own.join(back, "chunk", "left").join(mended, "chunk", "left").drop("chunk")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                held, sums = np.asarray(b.column(3)[i].values), np.asarray(b.column(2)[i].values)
                ends = np.cumsum(held)
                which, times = (expand(b.column(k)[i].as_py(), int(ends[-1])).astype(np.int64) for k in (4, 5))
                price = np.zeros(1)
                if b.column(6)[i].is_valid:
                    prices = b.column(6)[i].values
                    lists = prices.field("values")
                    price = np.concatenate([_unsqueeze(lists[int(k)].as_py()).view(np.float32) for k in np.argsort(np.asarray(prices.field("start")))]).astype(np.float64)
                if b.column(7)[i].is_valid:
                    apart = b.column(7)[i].values
                    price[np.asarray(apart.field("no"))] = np.asarray(apart.field("value"))
                walk = np.concatenate([[0], np.cumsum(which)])
                place = walk[1:] - np.repeat(walk[ends - held], held)  # places start anew from 0 in each document
                bits = np.bincount(np.repeat(np.arange(len(held)), held), price[place] * times, len(held))
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(sums + bits)], ["doc_id", "n_tokens", "total"])

    return both.mapInArrow(run, "doc_id long, n_tokens long, total double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    margin: float = MARGIN,
) -> DataFrame:
    """Per document: doc_id, lang, n_tokens, surprise, perplexity, limit, kept.

    ``labels`` has doc_id and quality; quality 1 marks trusted documents. ``limit`` is the
    ``quantile`` of the held-out scores of the document's language plus ``margin`` bits;
    languages (null among them) with fewer than MIN_TRUSTED held-out documents take that
    of all languages. Texts that are null or have no word have no
    score and are kept, as is everything if nothing is trusted. Rows that share an id are
    scored each on their own, in the smallest language that the id has; an id is trusted
    if every label it has says so.
    """
    with shuffles_removed(docs.sparkSession), scratch(docs.sparkSession) as folder:
        scored = _scored(folder, docs, labels, id_col, text_col, lang_col)
    return _judged(scored, quantile, margin)


def _scored(folder: str, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id, lang, n_tokens, total, trusted`` (held out, with a known good label)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("trusted"))
    held_out = F.pmod(F.xxhash64("trusted", F.lit("held out")), F.lit(4)) == 0
    fitted = trusted.where(~held_out)
    spark = docs.sparkSession
    with scratch(spark) as only:  # the fitted texts go once the model stands; their ids grow with the corpus, so they are sorted, not sent
        sample = materialize(rows.join(fitted.hint("merge"), F.col("doc_id") == F.col("trusted"), "left_semi").select("text"), f"{only}/sample")
        counted = counted_words(sample, only)
        known, rare = vocabulary(counted)
        spread = middle.spread_of(counted, known, sample.count(), middle.parts_of(spark), MIN_COUNT)
        model = middle.fit(sample, known, rare, spread, folder)
    sums = middle.totals(rows, model)
    langs = docs.groupBy(F.col(id_col).cast("long").alias("of")).agg(F.min(lang_col).alias("lang"))
    return materialize(
        sums.join(langs, F.col("doc_id").eqNullSafe(F.col("of")), "left")
        .join(trusted, F.col("doc_id") == F.col("trusted"), "left")
        .select("doc_id", "lang", "n_tokens", "total", F.coalesce(F.col("trusted").isNotNull() & held_out, F.lit(False)).alias("trusted")),
        shared_dir(docs.sparkSession),
    )


def _judged(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    sure = scored.where("trusted and n_tokens > 0")
    mean = sure.groupBy(F.col("lang").alias("of")).agg((F.sum("total") / F.sum("n_tokens")).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TRUSTED).drop("n")
    everywhere = sure.agg(F.sum("total").alias("t"), F.sum("n_tokens").alias("n")).first()
    overall = everywhere["t"] / everywhere["n"] if everywhere["n"] else 0.0
    drawn = scored.join(mean, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    score = (F.col("total") + PRIOR_TOKENS * F.coalesce("mean", F.lit(overall))) / (F.col("n_tokens") + PRIOR_TOKENS)
    drawn = drawn.withColumn("score", score)
    sure = drawn.where("trusted and n_tokens > 0")
    by_lang = quantiles(sure.select(F.col("lang").alias("of"), "score"), quantile).where(F.col("n") >= MIN_TRUSTED)
    everywhere = quantiles(sure.select(F.lit(0).alias("of"), "score"), quantile).first()
    limit = F.coalesce(F.col("cut"), F.lit(everywhere and everywhere["cut"]).cast("double"), F.lit(float("inf"))) + margin
    out = drawn.join(by_lang.select("of", "cut"), F.col("lang").eqNullSafe(F.col("of")), "left")
    some = F.col("n_tokens") > 0
    return out.select(
        "doc_id",
        "lang",
        "n_tokens",
        F.when(some, F.col("score")).alias("surprise"),
        F.when(some, F.pow(F.lit(2.0), F.col("score"))).alias("perplexity"),
        limit.alias("limit"),
        (~some | (F.col("score") <= limit)).alias("kept"),
    )


def quantiles(scores: DataFrame, quantile: float) -> DataFrame:
    """``of, n, cut`` of ``of, score``: the number of scores of each group and, in their order,
    the one at place ``ceil(quantile * n)``, exactly, however many there are. Places are
    counted over steps of the score, then over the scores of the one step that holds it."""
    step = F.floor(F.col("score") * STEPS)
    before = lambda order: Window.partitionBy("of").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = scores.groupBy("of", step.alias("step")).agg(F.count(F.lit(1)).alias("m"))
    counted = counted.select("*", F.coalesce(F.sum("m").over(before("step")), F.lit(0)).alias("below"), F.sum("m").over(Window.partitionBy("of")).alias("n"))
    place = F.greatest(F.lit(1), F.ceil(F.col("n") * quantile)) - F.col("below")
    hit = counted.withColumn("place", place).where("place > 0 and place <= m").select(F.col("of").alias("own"), F.col("step").alias("own_step"), "n", "place")
    inside = scores.join(hit, F.col("of").eqNullSafe(F.col("own")) & (step == F.col("own_step")))
    inside = inside.groupBy("of", "n", "place", "score").agg(F.count(F.lit(1)).alias("m"))
    inside = inside.withColumn("below", F.coalesce(F.sum("m").over(before("score")), F.lit(0)))
    return inside.where("below < place and place <= below + m").select("of", "n", F.col("score").alias("cut"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that ``classify`` keeps, with their columns. Rows that share an
    id stay or go together: they go if every one of them is rejected."""
    name = fresh_name(docs, "judged")
    verdict = classify(docs, labels, id_col, **options).groupBy(F.col("doc_id").alias(name)).agg(F.bool_or("kept").alias("any"))
    gone = verdict.where(~F.col("any")).select(name)
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]), "left_anti")
