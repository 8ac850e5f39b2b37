"""Importance resampling: documents drawn by how much likelier a target makes them.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter and no
digit, so ``bytes.split`` gives the words of a text's UTF-8. A feature is a run of
words; its bucket is a crc-32 that goes on from that of the run one word shorter.
Counters gather buckets by document and by chunk; what leaves a task is one count a
bucket. The gain of a bucket is the logarithm of its share in the target over its share
in the corpus, and Gumbel noise of the id makes the best scores a draw by weight.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import materialize

#: Longest run of words, number of buckets, words that a document must have to be drawn, percent drawn.
LONGEST_RUN, BUCKETS, MIN_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"

_UPPER, _LOWER, _DIGITS = (bytes(range(a, a + n)) for a, n in ((65, 26), (97, 26), (48, 10)))
TABLE = bytes(b if b >= 128 or b in _LOWER + _DIGITS else b + 32 if b in _UPPER else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def features(words: list[bytes], longest: int = LONGEST_RUN) -> list[int]:
    """The crc-32 of every run of 1 to ``longest`` words, joined by single spaces."""
    runs = list(map(zlib.crc32, words))
    out = runs
    for k in range(1, longest):
        runs = [zlib.crc32(b" " + w, c) for c, w in zip(runs, words[k:], strict=False)]
        out = out + runs
    return out


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()  # ``buckets`` entries at most
        for b in small_batches(batches):
            own: Counter[int] = Counter()
            for t in b.column(0).to_pylist():
                own.update(features(words_of(t), longest))
            for code, n in own.items():
                held[code % buckets] += n
        if held:
            yield pa.RecordBatch.from_pydict({"bucket": list(held), "n": list(held.values())})

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths, from the ``bucket_counts`` of both. At most
    ``buckets`` rows of each come to the driver."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (corpus, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def noise(doc_id: object, seed: str = SEED) -> int:
    """Gumbel noise of an id in thousandths; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], id_col: str, text_col: str, longest: int = LONGEST_RUN, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                own = Counter(features(words, longest))
                n = own.total()
                weight = sum(gain[code % buckets] * times for code, times in own.items()) // n if n else 0
                rows.append((len(words), n, weight, weight + noise(doc_id, seed)))
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank``, 1 and up in the total order of ``order``, without one task that sees
    all rows: rows are dealt by ranges and sorted inside, the ranges' counts (a row for
    each) are summed up, and a row's number in its range is added."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_range", F.shiftright("_at", 33)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return dealt.join(F.broadcast(starts), F.col("_range") == F.col("_of")).withColumn("rank", place.cast("long")).drop("_at", "_range", "_of", "_before")  # a row a range


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null where not drawn).

    Of the rows with ``min_words`` words, the ``percent`` per cent with the highest
    scores are drawn and ranked; ties go to the smaller id (null first), then to the
    text with fewer features. Null and empty texts have no features, weight 0, and are
    not drawn. Rows that repeat an id are drawn each for itself. Every text counts in
    the corpus, drawn or not; an empty target gives the uniform share to each bucket.

    Two passes over the texts; then rows of five numbers are sorted by ranges.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    able = F.col("n_words") >= min_words
    rows = materialize(scored(docs, gain, id_col, text_col, longest, seed).withColumn("able", able))
    wanted = rows.agg((F.count_if("able") * percent / 100).alias("share")).select(F.floor("share").alias("wanted"))
    placed = ranked(rows, [F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("n_features")]).join(F.broadcast(wanted))  # one row
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= F.col("wanted")), F.col("rank")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns. Ids are expected
    to be unique; rows that share one follow each other."""
    ids = resample(docs, target, id_col, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")
