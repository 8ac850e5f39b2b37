"""The trigram model of ``quality``, counted and asked in parts by the middle word.

Of a trigram a b c, the context a b, the bigram b c and the word b have the middle word
in common. So all counts that its surprise needs, but the number of words that c follows,
stand in one part when trigrams are dealt by b, and a part answers what is asked of it
without a second join. Trigrams move as packed lists, sorted by words: those of the fitted
documents once to be counted, those of all documents with the place of their document, in
ROUNDS of documents so that no more than a share of them is on disk. What goes back is a
sum for each document and part.

A word b that is more than half of a part's share is dealt by a as well. Its bigrams are
then counted over its parts and sent to each of them; contexts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .chunks import LISTS, expand, squeeze
from .common import materialize, mix64

#: Trigrams and documents that close a chunk; rounds of documents; words in a slice of the counts by last word.
CHUNK, CHUNK_DOCS, ROUNDS, SLICE = 1 << 20, 1 << 16, 4, 1 << 16
#: Kinds of rows: counted trigrams of a part, bigrams of a word in several parts, slices of how
#: many words each word follows, numbers of n-grams by count; what is asked, documents of a chunk.
_TRIGRAMS, _BIGRAMS, _FOLLOWS, _COUNTS, _ASKED, _DOCS = range(6)
_ROW = "part int, kind int, key long, packed binary, counts array<long>"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("packed", pa.binary()), ("counts", pa.list_(pa.int64()))])


@dataclass
class Model:
    """``shards`` has the counted trigrams of each part, ``bigrams`` those of the words in
    several parts; ``follows`` how many words each token follows."""

    shards: DataFrame
    bigrams: DataFrame
    known: np.ndarray
    follows: np.ndarray
    spread: dict[int, int]
    parts: int
    discounts: tuple[list[float], list[float]]
    shared: np.ndarray  # words that a token below WORD stands for


def _pack(*columns: np.ndarray) -> bytes:
    return squeeze(np.concatenate(columns))


def _unpack(x: bytes, columns: int) -> np.ndarray:
    return expand(x, zstandard.frame_content_size(x) // 4).view(np.int32).reshape(columns, -1)


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _walk(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int32).astype(np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    edges = [*np.nonzero(np.diff(x, prepend=-1))[0].tolist(), len(x)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def parts_of(spark: SparkSession) -> int:
    return LISTS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_of(counted: DataFrame, known: np.ndarray, docs: int, parts: int, min_count: int) -> dict[int, int]:
    """In how many parts a token goes that is more than half of a part's share, of ``word,
    n`` (all words of the fitted documents) and their first places: 2 ``parts`` tokens at most."""
    from .quality import START, UNKNOWN, WORD

    total = (counted.agg(F.sum("n")).first()[0] or 0) + docs
    rare = counted.where(F.col("n") < min_count).groupBy(F.col("word").bitwiseAND(7).alias("make")).agg(F.sum("n").alias("n")).collect()
    often = {UNKNOWN[r["make"]]: r["n"] for r in rare} | {START: docs}
    most = counted.where((F.col("n") >= min_count) & (2 * parts * F.col("n") > total)).collect()
    often |= {WORD + int(np.searchsorted(known, r["word"])): r["n"] for r in most}
    return {t: min(parts, -(-2 * parts * n // total)) for t, n in often.items() if 2 * parts * n > total}


def dealer(spread: dict[int, int], parts: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The part of trigrams by their first and middle words."""
    hot = np.array(sorted(spread), np.int64)
    among = np.array([spread[int(b)] for b in hot], np.uint64)

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = mix64(b.astype(np.uint64)) % np.uint64(parts)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, b), len(hot) - 1)
            some = np.nonzero(hot[at] == b)[0]
            out[some] = (out[some] + mix64(a[some].astype(np.uint64) + np.uint64(1 << 40)) % among[at[some]]) % np.uint64(parts)
        return out.astype(np.int64)

    return part


def _chunks(batches: Iterator[pa.RecordBatch], known: np.ndarray, text: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """First columns, words, trigrams and their documents' places, CHUNK trigrams at a time."""
    from .quality import _Tokens, _trigrams

    tokens = _Tokens(known)
    held: list[tuple] = []
    docs = size = 0

    def close():
        return [x for h in held for x in h[0]], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))

    for b in small_batches(batches, 128):
        grams, whose, n = _trigrams(tokens, b.column(text).to_pylist())
        held.append((b.column(0).to_pylist(), n, grams.astype(np.int32), (whose + docs).astype(np.int32)))
        docs, size = docs + len(n), size + len(grams)
        if size >= CHUNK or docs >= CHUNK_DOCS:
            yield close()
            held, docs, size = [], 0, 0
    if held:
        yield close()


def _lists(grams: np.ndarray, whose: np.ndarray | None, deal: Callable) -> tuple[np.ndarray, list[bytes]]:
    """Parts, and for each its trigrams in order (b, a, c), of what document, and how often."""
    a, b, c = (grams[:, i].astype(np.int64) for i in range(3))
    part = deal(a, b)
    first, second = part << 32 | b, a << 32 | c
    order = np.lexsort((second, first))  # documents stay in order
    first, second = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    if whose is not None:
        whose = whose[order]
        new[1:] |= whose[1:] != whose[:-1]
    at = np.nonzero(new)[0]
    often = np.diff(np.append(at, len(order)))
    part, columns = first[at] >> 32, [first[at] & 0xFFFFFFFF, second[at] >> 32, second[at] & 0xFFFFFFFF, often]
    if whose is not None:
        columns.append(whose[at].astype(np.int64))
    packed = []
    for i, j in _runs(part):
        own = [x[i:j] for x in columns]
        packed.append(_pack(_steps(own[0]), _steps(own[1]), *own[2:]))
    return np.unique(part), packed


def _bigrams(b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``b << 32 | c`` of distinct trigrams and how many words come before each."""
    return np.unique(b << 32 | c, return_counts=True)


def _by_count(n: np.ndarray) -> np.ndarray:
    """Numbers of n-grams with counts of one to four."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def _summed_up(tri: np.ndarray, bi: np.ndarray, follows: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield _rows(1, kind=[_COUNTS], counts=[[*tri.tolist(), *bi.tolist()]])
    for i in range(0, len(follows), SLICE):
        if follows[i : i + SLICE].any():
            yield _rows(1, kind=[_FOLLOWS], key=[i], packed=[_pack(follows[i : i + SLICE])])


def _counted(sample: DataFrame, known: np.ndarray, spread: dict[int, int], parts: int) -> DataFrame:
    from .quality import RUN, WORD

    size, hot = WORD + len(known), np.array(sorted(spread), np.int64)
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def dealt(batches):
        deal = dealer(spread, parts)
        for _, _, grams, _ in _chunks(batches, shared.value, 0):
            part, packed = _lists(grams[grams[:, 2] != RUN], None, deal)  # never learnt
            yield _rows(len(part), part=part, packed=packed)

    def count(batches):
        tri, bi, follows = np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros(size, np.int64)
        held: list[np.ndarray] = []
        last = None

        def close():
            nonlocal tri, bi, follows
            b, a, c, n = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
            order = np.lexsort((c, b << 32 | a))
            b, a, c, n = b[order], a[order], c[order], n[order]
            at = np.nonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))[0]
            b, a, c, n = b[at], a[at], c[at], np.add.reduceat(n, at)
            yield _rows(1, part=[last], kind=[_TRIGRAMS], packed=[_pack(_steps(b), _steps(a), c, n)])
            tri += _by_count(n)
            key, n2 = _bigrams(b, c)
            apart = np.isin(key >> 32, hot)
            bi += _by_count(n2[~apart])
            follows += np.bincount(key[~apart] & 0xFFFFFFFF, minlength=size)
            key, n2 = key[apart], n2[apart]
            for i, j in _runs(key >> 32):
                yield _rows(1, kind=[_BIGRAMS], key=[key[i] >> 32], packed=[_pack(_steps(key[i:j] & 0xFFFFFFFF), n2[i:j])])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != last and held:
                    yield from close()
                    held = []
                last = part
                x = _unpack(packed, 4)
                held.append((_walk(x[0]), _walk(x[1]), x[2], x[3]))
        if held:
            yield from close()
            yield from _summed_up(tri, bi, follows)

    lists = sample.select("text").mapInArrow(dealt, _ROW).select("part", "packed")
    return lists.repartition("part").sortWithinPartitions("part").mapInArrow(count, _ROW)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Bigrams of one word from all its parts: they have different words before, so numbers add up."""
    each = [_unpack(x, 2) for x in rows["packed"]]
    c, place = np.unique(np.concatenate([_walk(x[0]) for x in each]), return_inverse=True)
    n2 = np.bincount(place, np.concatenate([x[1] for x in each])).astype(np.int64)
    return pd.DataFrame({"key": rows["key"].iloc[:1], "packed": [_pack(_steps(c), n2)]})


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    whole = np.sum([_unpack(x, 1)[0].astype(np.int64) for x in rows["packed"]], axis=0)
    return pd.DataFrame({"key": rows["key"].iloc[:1], "packed": [_pack(whole)]})


def fit(sample: DataFrame, known: np.ndarray, rare: list[int], spread: dict[int, int], folder: str) -> Model:
    """The model of all of ``sample`` (text). ``spread``: the number of parts of tokens
    that are dealt by the word before as well."""
    from .quality import UNKNOWN, WORD, _discounts

    spark, size = sample.sparkSession, WORD + len(known)
    parts = parts_of(spark)
    counted = materialize(_counted(sample, known, spread, parts), f"{folder}/counted")
    bigrams = materialize(counted.where(F.col("kind") == _BIGRAMS).select("key", "packed").groupBy("key").applyInPandas(_joined, "key long, packed binary"), f"{folder}/bigrams")

    def sums(batches):
        bi, follows = np.zeros(4, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                c, n2 = _unpack(packed, 2)
                bi += _by_count(n2)
                follows += np.bincount(_walk(c), minlength=size)
        yield from _summed_up(np.zeros(4, np.int64), bi, follows)

    both = counted.where(F.col("kind").isin(_FOLLOWS, _COUNTS)).union(materialize(bigrams.mapInArrow(sums, _ROW), f"{folder}/sums"))
    counts = both.where(F.col("kind") == _COUNTS).agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(8)]).first()
    follows = np.zeros(size, np.int32)
    for r in both.where(F.col("kind") == _FOLLOWS).select("key", "packed").groupBy("key").applyInPandas(_added, "key long, packed binary").toLocalIterator():  # one number for each known word
        follows[r["key"] : r["key"] + SLICE] = _unpack(bytes(r["packed"]), 1)[0]
    shared = np.ones(WORD)
    shared[list(UNKNOWN)] = np.maximum(1, rare)
    shards = counted.where(F.col("kind") == _TRIGRAMS)
    return Model(shards, bigrams, known, follows, spread, parts, (_discounts(*counts[:4]), _discounts(*counts[4:])), shared)


class _Part:
    """The model's counts in one part; ``bits`` of trigrams that are dealt to it."""

    def __init__(self, trigrams: list[bytes], bigrams: list[tuple[int, bytes]], constants: tuple):
        self.follows, self.unit, self.floor, (d3, d2), self.shared = constants
        if trigrams:
            x = _unpack(trigrams[0], 4)
            b, a, c, n = _walk(x[0]), _walk(x[1]), x[2].astype(np.int64), x[3].astype(np.int64)
        else:
            b = a = c = n = np.zeros(0, np.int64)
        pair = b << 32 | a
        starts = np.nonzero(np.diff(pair, prepend=-1))[0]
        self.contexts = pair[starts]
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pair))))
        self.trigrams = which << 32 | c  # sorted, as trigrams are
        all3 = np.bincount(which, n, len(starts))
        off = np.array([0.0, *d3])[np.minimum(n, 3)]
        self.high = (n - off) / all3[which]
        self.left3 = np.bincount(which, off, len(starts)) / np.maximum(all3, 1)
        own = ~np.isin(b, [w for w, _ in bigrams])
        key, n2 = _bigrams(b[own], c[own])
        more = [(w << 32 | _walk(y[0]), y[1].astype(np.int64)) for w, y in ((w, _unpack(p, 2)) for w, p in bigrams)]
        key, n2 = np.concatenate([key, *(k for k, _ in more)]), np.concatenate([n2, *(v for _, v in more)])
        order = np.argsort(key)
        self.bigrams, n2 = key[order], n2[order]
        self.words, which = np.unique(self.bigrams >> 32, return_inverse=True)
        all2 = np.bincount(which, n2, len(self.words))
        off = np.array([0.0, *d2])[np.minimum(n2, 3)]
        self.middle = (n2 - off) / all2[which]
        self.left2 = np.bincount(which, off, len(self.words)) / np.maximum(all2, 1)

    @staticmethod
    def _at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those that are there, and which these are."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        there = np.nonzero(keys[at] == asked)[0]
        return at[there], there

    def bits(self, b: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        p = self.follows[c] * self.unit + self.floor
        at, there = self._at(self.words, b)
        p[there] *= self.left2[at]
        at, there = self._at(self.bigrams, b << 32 | c)
        p[there] += self.middle[at]
        at, there = self._at(self.contexts, b << 32 | a)
        p[there] *= self.left3[at]
        seen, some = self._at(self.trigrams, at << 32 | c[there])
        p[there[some]] += self.high[seen]
        return -np.log2(p / self.shared[np.where(c < len(self.shared), c, 0)])


def totals(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, total``: words and surprise in bits of each row of ``doc_id, text``."""
    whole = int(model.follows.sum(dtype=np.int64))
    size = len(model.known) + 7  # with the makes of unknown words and the two repetitions
    constants = (model.follows, 1 / (whole + 1.0), 1.0 / size / (whole + 1.0), model.discounts, model.shared)
    known, constants = (rows.sparkSession.sparkContext.broadcast(x) for x in (model.known, constants))
    spread, parts = model.spread, model.parts

    def ask(batches):
        from pyspark import TaskContext

        deal, number = dealer(spread, parts), TaskContext.get().partitionId() << 32
        for ids, n, grams, whose in _chunks(batches, known.value, 1):
            yield _rows(1, part=[number % parts], kind=[_DOCS], key=[number], packed=[_pack(n)], counts=[ids])
            part, packed = _lists(grams, whose, deal)
            yield _rows(len(part), part=part, kind=np.full(len(part), _ASKED), key=np.full(len(part), number), packed=packed)
            number += 1

    def answer(batches):
        last, trigrams, bigrams, own = None, [], [], None
        for batch in batches:
            for part, kind, key, packed, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != last:
                    last, trigrams, bigrams, own = part, [], [], None
                if kind == _TRIGRAMS:
                    trigrams.append(packed)
                elif kind == _BIGRAMS:
                    bigrams.append((key, packed))
                elif kind == _DOCS:
                    yield _rows(1, kind=[kind], key=[key], packed=[packed], counts=[ids])
                else:
                    own = own or _Part(trigrams, bigrams, constants.value)
                    x = _unpack(packed, 5)
                    bits = own.bits(_walk(x[0]), _walk(x[1]), x[2].astype(np.int64)) * x[3]
                    docs, place = np.unique(x[4], return_inverse=True)
                    sums = np.bincount(place, bits).astype(np.float32)
                    yield _rows(1, kind=[kind], key=[key], packed=[_pack(_steps(docs).astype(np.uint32), sums.view(np.uint32))])

    def add(chunk: pa.Table) -> pa.Table:
        ids, n, total = [], np.zeros(0, np.int64), None
        rows = sorted(zip(*(chunk.column(x).to_pylist() for x in ("kind", "packed", "counts")), strict=True), key=lambda r: -r[0])
        for kind, packed, counts in rows:  # the documents come first
            if kind == _DOCS:
                ids, n = counts, _unpack(packed, 1)[0].astype(np.int64)
                total = np.zeros(len(n))
            else:
                docs, sums = _unpack(packed, 2)
                total[_walk(docs)] += sums.view(np.float32)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": n, "total": total})

    columns = ["part", "kind", "key", "packed", "counts"]
    at = [(int(b), [int(p) for p in (int(mix64(np.array([b], np.uint64))[0] % np.uint64(parts)) + np.arange(k)) % parts]) for b, k in spread.items()]
    places = rows.sparkSession.createDataFrame(at, "of long, parts array<int>")  # words that are more than half of a part's share: two for each part at most
    spread_out = model.bigrams.join(F.broadcast(places), F.col("key") == F.col("of")).select(F.explode("parts").alias("part"), F.lit(_BIGRAMS).alias("kind"), "key", "packed", F.lit(None).cast("array<long>").alias("counts"))
    counts = model.shards.select(*columns).union(spread_out)
    done = []
    for i in range(rounds):
        some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i) if rounds > 1 else rows
        both = counts.union(some.select("doc_id", "text").mapInArrow(ask, _ROW))
        answers = materialize(both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(answer, _ROW))
        done.append(answers.select("kind", "key", "packed", "counts").groupBy("key").applyInArrow(add, "doc_id long, n_tokens long, total double"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
