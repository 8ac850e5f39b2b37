"""Exact top-k search by segment statistics, coarse to fine.

For a segment of ``m`` components, the mean and deviation of two vectors bound
their inner product from above: ``m (mean mean + dev dev)``, which is the lower
bound of their distance in other words. Summed over 1, 4 and 16 segments this
bounds the score more and more tightly; each finer level is looked at only for the
candidates that the coarser one leaves, and the rest get their exact score in integers.

A query's floor is its k-th best score among a bounded set of seeds to begin with,
and rises as it goes on through the candidates, so whole blocks fall at the coarsest
level once good rows are known. Candidates and their statistics are packed in blocks,
and the blocks in shelves. A task holds one shelf, and each block of queries passes
it once; a query leaves k rows at most, so what is ranked last is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrices, usable

#: Queries and rows of a block, blocks of a shelf and components in it at most, rows that give the first floors.
QUERY_BLOCK, ROW_BLOCK, SHELF, SHELF_COMPONENTS, SEEDS = 256, 1024, 64, 1 << 22, 2048
LEVELS = (1, 4, 16)
#: Share of a block's pairs under which single pairs are cheaper than the product of the block.
FEW = 0.1
_BLOCK = "block long, dim int, ids binary, data binary, stats binary, floors binary"


def quantize(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else as doubles."""
    small = len(x) and np.abs(x).max() < 32768
    return x.astype("<i2" if small else "<f8").tobytes()


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * rows * dim else "<f8"
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.float64)


def blocks(rows: DataFrame, size: int, scale: float, k: int = 0, seeds: dict | None = None) -> DataFrame:
    """``block, dim, ids, data, stats, floors``: up to ``size`` quantized vectors of one
    length with their segment statistics, and with ``seeds`` (ids and vectors by length)
    the first floors of queries."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for ids, x in matrices(b.column(0), b.column(1)):
                for i in range(0, len(ids), size):
                    who, q = ids[i : i + size].astype("<i8"), quantize(x[i : i + size], scale)
                    stats = np.concatenate([features(q, level) for level in LEVELS], axis=1)
                    floors = _floors(who, q, seeds, k) if seeds is not None else np.zeros(0)
                    row = [number, q.shape[1], who.tobytes(), _packed(q), stats.astype("<f8").tobytes(), floors.astype("<f8").tobytes()]
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "dim", "ids", "data", "stats", "floors"])

    return rows.select("vec_id", "vec").mapInArrow(run, _BLOCK)


def _floors(ids: np.ndarray, q: np.ndarray, seeds: dict, k: int) -> np.ndarray:
    """The k-th best exact score of each query among the seeds, -inf if there are fewer."""
    own, x = seeds.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
    if len(own) < k:
        return np.full(len(ids), -np.inf)
    scores = exact(q, x).astype(np.float64)
    scores[ids[:, None] == own[None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k]


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that inner products of
    features are the bounds; components beyond the last whole segment join it."""
    d = x.shape[1]
    edges = np.linspace(0, d, min(segments, d) + 1).astype(int)
    m = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = sums / m
    dev = np.sqrt(np.maximum(0, squares / m - mean * mean))
    return np.concatenate([mean * np.sqrt(m), dev * np.sqrt(m)], axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in double while they are exact there, else in 64-bit integers."""
    if max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) * q.shape[1] < 2**52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def survivors(q: np.ndarray, x: np.ndarray, q_stats: list[np.ndarray], x_stats: list[np.ndarray], floor: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no level's bound puts under the query's floor. A finer level sees the
    rows and columns that still have pairs, or the single pairs once they are few."""
    slack = 1e-9 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :] + 1e-6
    alive = (q_stats[0] @ x_stats[0].T + slack >= floor[:, None]) & ~own
    for a, b in zip(q_stats[1:], x_stats[1:], strict=True):
        rows, cols = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
        if not len(rows):
            break
        if alive.sum() < FEW * len(rows) * len(cols):
            i, j = np.nonzero(alive)
            alive[i, j] = np.einsum("nd,nd->n", a[i], b[j]) + slack[i, j] >= floor[i]
        else:
            part = np.ix_(rows, cols)
            alive[part] &= a[rows] @ b[cols].T + slack[part] >= floor[rows][:, None]
    return np.nonzero(alive)


def block_top(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, q_stats: list | None = None, x_stats: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids of rows and scores of the k best rows of a block for each
    query that reach its floor, best first, ties to the smaller id."""
    floor = np.full(len(qi), -np.inf) if floor is None else floor
    q_stats, x_stats = (given or [features(m, level) for level in LEVELS] for given, m in ((q_stats, q), (x_stats, x)))
    rows, cols = survivors(q, x, q_stats, x_stats, floor, qi[:, None] == xi[None, :])
    if len(rows) > FEW * len(qi) * len(xi):
        scores = exact(q, x)[rows, cols]
    else:
        big = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * q.shape[1] >= 2**52
        kind = np.int64 if big else np.float64
        scores = np.concatenate([np.einsum("nd,nd->n", q[rows[i : i + 65536]].astype(kind), x[cols[i : i + 65536]].astype(kind)) for i in range(0, len(rows), 65536)] or [np.zeros(0)]).astype(np.int64)
    enough = scores >= floor[rows]
    return _best(rows[enough], xi[cols[enough]], scores[enough], k, len(qi))


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; only what reaches a row's k-th score is sorted. Rows come in order."""
    count = np.bincount(rows, minlength=n)
    ends = np.cumsum(count)
    low = np.full(n, np.iinfo(np.int64).min)
    for r in np.nonzero(count > 4 * k)[0]:
        part = scores[ends[r] - count[r] : ends[r]]
        low[r] = np.partition(part, len(part) - k)[len(part) - k]
    some = scores >= low[rows]
    rows, ids, scores = rows[some], ids[some], scores[some]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], ids[first], scores[first]


def _split(stats: bytes, rows: int, dim: int) -> list[np.ndarray]:
    widths = [2 * min(level, dim) for level in LEVELS]
    whole = np.frombuffer(stats, "<f8").reshape(rows, sum(widths))
    return np.split(whole, np.cumsum(widths)[:-1], axis=1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every query by
    integer inner product of ``floor(scale * x)``; ties go to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Vectors that are null or hold a
    component that is null or not finite take no part, nor do null ids; vectors of
    other lengths than the query's are no candidates. Rows that repeat an id count
    as rows: each is a candidate of other ids' queries, and a query's k rows are the
    best of all its rows'. Scores must fit in 64 bits.
    """
    rows = materialize(usable(vectors, id_col, vector_col))
    held = materialize(blocks(rows, ROW_BLOCK, scale))
    seeds: dict = {}
    for r in held.orderBy(F.xxhash64("block")).limit(max(1, SEEDS // ROW_BLOCK)).select("dim", "ids", "data").collect():  # SEEDS rows at most
        ids = np.frombuffer(r.ids, "<i8")
        seeds.setdefault(r.dim, (ids, _matrix(r.data, len(ids), r.dim)))
    asked = materialize(blocks(rows.where(is_query).coalesce(1 + rows.rdd.getNumPartitions() // 16), QUERY_BLOCK, scale, k, seeds))
    fits = F.greatest(F.lit(1), F.least(F.lit(SHELF), F.floor(F.lit(SHELF_COMPONENTS) / ROW_BLOCK / F.col("of"))))
    shelves = held.groupBy(F.col("dim").alias("of")).agg(F.count(F.lit(1)).alias("n")).select("of", F.ceil(F.col("n") / fits).cast("int").alias("shelves"))
    placed = held.join(F.broadcast(shelves), F.col("dim") == F.col("of"))  # a row for each length
    there = placed.select("dim", F.pmod(F.xxhash64("block"), F.col("shelves")).cast("int").alias("shelf"), F.lit(0).alias("kind"), "ids", "data", "stats", "floors")
    ask = asked.join(F.broadcast(shelves), F.col("dim") == F.col("of"))
    ask = ask.select("dim", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"), F.lit(1).alias("kind"), "ids", "data", "stats", "floors")
    order = ["dim", "shelf", "kind"]
    laid = there.union(ask).repartition("dim", "shelf").sortWithinPartitions(*order)

    def run(batches):
        at, shelf = None, []
        for b in batches:
            for i in range(b.num_rows):
                d, place, kind = (b.column(c)[i].as_py() for c in range(3))
                if (d, place) != at:
                    at, shelf = (d, place), []
                ids = np.frombuffer(b.column(3)[i].as_py(), "<i8")
                x, stats = _matrix(b.column(4)[i].as_py(), len(ids), d), _split(b.column(5)[i].as_py(), len(ids), d)
                if kind == 0:
                    shelf.append((ids, x, stats))
                    continue
                floor = np.frombuffer(b.column(6)[i].as_py(), "<f8").copy()
                best = [np.zeros(0, np.int64)] * 3
                for xi, m, x_stats in shelf:
                    new = block_top(ids, x, xi, m, k, floor, stats, x_stats)
                    if not len(new[0]):
                        continue
                    both = [np.concatenate(p) for p in zip(best, new, strict=True)]
                    inside = np.argsort(both[0], kind="stable")
                    best = _best(*(p[inside] for p in both), k, len(ids))
                    full = np.nonzero(np.bincount(best[0], minlength=len(ids)) == k)[0]
                    last = np.searchsorted(best[0], full, "right") - 1
                    floor[full] = np.maximum(floor[full], best[2][last])
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in (ids[best[0]], best[1], best[2])], ["query_id", "vec_id", "score"])

    best = laid.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
