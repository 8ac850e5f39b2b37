"""Near-duplicate vectors by spherical-cap filters.

Filters are directions of a structured random product code: a random rotation,
then in each of three parts of the vector one of ``m`` random codewords. A vector
goes to all filters that it exceeds its own threshold on, which is where it exceeds
on ``lists`` of them; one threshold for all would leave vectors with few filters or
none. The parts' products are sorted, so the filters are decoded without trying all
``m ** 3`` of them. Vectors that share a filter are compared by exact cosine in
double precision.

The rotation is random, so a pair of given cosine meets as often as random pairs of
that cosine do, whatever the data. ``lists`` grows with the table until pairs at
the very threshold meet as often as ``RECALL`` asks for; closer pairs meet more
often. Tables so small that there would be no more filters than lists have one filter.
So have vectors of so few components that none of the ``TRIES`` numbers of lists is
enough: caps of this cosine are a large part of their sphere.

Equal vectors are one class, compared once. A pair of classes counts only in the
first filter that both are in, and gives counts and a link to its group's root, so
no table of pairs is made. A filter with many vectors is cut in tiles of bounded
size, and every pair of tiles meets, so one task never holds a whole hot filter.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, scratch, shared_dir
from .vectors import finite, sorted_groups

PARTS = 3
#: Filters a vector is in at least; vectors a filter has on average; rows of a tile.
LISTS, PER_FILTER, TILE = 32, 192, 1024
#: Share of the pairs at the threshold that have to meet; pairs that it is measured on.
RECALL, TRIALS, TRIES = 0.998, 4000, 8


class ProductCode:
    """Rotation and codewords, all from the seed; a few kilobytes."""

    def __init__(self, dim: int, m: int, lists: float, seed: int = 7):
        rng = self.rng = np.random.default_rng([seed, dim, m])
        self.dim, self.m, self.lists = dim, m, lists
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [dim * i // PARTS for i in range(PARTS + 1)]
        words = [rng.standard_normal((m, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.words = [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / np.sqrt(PARTS) for w in words]

    @cached_property
    def threshold(self) -> float:
        """What random directions exceed on ``lists`` filters in the mean."""
        x = self.rng.standard_normal((512, self.dim))
        a, b, c = self.products(x / np.linalg.norm(x, axis=1, keepdims=True))
        sums = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(-1) if self.m <= 24 else self._sampled(a, b, c, self.rng)
        return float(np.quantile(sums, 1 - min(1.0, self.lists / self.m**PARTS)))

    @staticmethod
    def _sampled(a, b, c, rng) -> np.ndarray:
        i = rng.integers(0, len(a), 8_000_000)
        return a[i, rng.integers(0, a.shape[1], len(i))] + b[i, rng.integers(0, b.shape[1], len(i))] + c[i, rng.integers(0, c.shape[1], len(i))]

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        r = x @ self.rotation
        return [r[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the filters that each unit vector exceeds the threshold on; at least its best filter."""
        out = []
        m, t = self.m, self.threshold
        for a, b, c in zip(*self.products(x), strict=True):
            top_b, top_c = b.max(), c.max()
            low = min(t, a.max() + top_b + top_c)
            i = np.nonzero(a >= low - top_b - top_c)[0]
            r, j = np.nonzero(a[i][:, None] + b[None, :] >= low - top_c)
            i = i[r]
            p, k = np.nonzero((a[i] + b[j])[:, None] + c[None, :] >= low - 1e-15)
            out.append(np.sort((i[p] * m + j[p]) * m + k).astype(np.int64))
        return out

    def best(self, x: np.ndarray) -> np.ndarray:
        """Sorted numbers of the ``lists`` best filters of each unit vector, of all if there are no more."""
        m, n = self.m, int(np.ceil(self.lists))
        # a filter whose ranks in the parts have a product over n has n better ones
        ranks = np.array([(i, j, k) for i in range(min(m, n)) for j in range(min(m, n // (i + 1))) for k in range(min(m, n // ((i + 1) * (j + 1))))])
        at_once = max(1, 2**22 // len(ranks))
        out = [np.zeros((0, min(n, m**PARTS)), np.int64)]
        for start in range(0, len(x), at_once):
            sums, number = -1e-13 * np.arange(len(ranks)), 0  # equal sums go by rank
            for part, rank in zip(self.products(x[start : start + at_once]), ranks.T, strict=True):
                order = np.argsort(-part, axis=1, kind="stable")
                sums = sums + np.take_along_axis(part, order, 1)[:, rank]
                number = number * m + order[:, rank]
            if sums.shape[1] > n:
                number = np.take_along_axis(number, np.argpartition(-sums, n - 1, axis=1)[:, :n], 1)
            out.append(np.sort(number, axis=1))
        return np.concatenate(out)

    def recall(self, cosine: float, trials: int = TRIALS, seed: int = 11) -> float:
        """Share of random pairs of unit vectors with this cosine that share a filter."""
        rng = np.random.default_rng([seed, self.dim])
        x, y = rng.standard_normal((2, trials, self.dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        cosine = min(1.0, max(-1.0, cosine))
        y = cosine * x + np.sqrt(1 - cosine**2) * y
        return float(np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(self.best(x), self.best(y), strict=True)]))


def code_for(dim: int, n: int, threshold: float, lists: float = LISTS, per_filter: int = PER_FILTER, target: float = RECALL) -> ProductCode:
    """The code with the fewest lists, from ``lists`` on in ``TRIES`` steps of a quarter, by
    which pairs at the threshold meet as often as the target asks for among ``n`` vectors."""
    for _ in range(TRIES):
        code = ProductCode(dim, max(2, int(np.ceil((lists * n / per_filter) ** (1 / PARTS)))), lists)
        if code.m**PARTS <= lists:
            break
        if code.recall(threshold) >= target:
            return code
        lists = np.ceil(lists * 1.25)
    return ProductCode(dim, 1, 1)


def _shared_before(lists_a: list[np.ndarray], lists_b: list[np.ndarray], own: int) -> np.ndarray:
    """For each pair, whether it shares a filter numbered under ``own``."""
    a = [x[x < own] for x in lists_a]
    b = [x[x < own] for x in lists_b]
    both = np.intersect1d(np.concatenate(a) if a else [], np.concatenate(b) if b else [])
    if not len(both):
        return np.zeros((len(a), len(b)), bool)

    def marks(lists):
        out = np.zeros((len(lists), len(both)), np.float32)
        for i, x in enumerate(lists):
            at = np.searchsorted(both, x)
            at = at[(at < len(both)) & (both[np.minimum(at, len(both) - 1)] == x)]
            out[i, at] = 1
        return out

    return marks(a) @ marks(b).T > 0


def _roots(n: int, linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric matrix of links."""
    label = np.arange(n)
    for _ in range(n):
        near = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def link(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", lists: float = LISTS, per_filter: int = PER_FILTER, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose cosine with it is at least
    ``threshold`` and that share a filter with it, which at the threshold itself is
    ``recall`` of them (equal vectors always); ``component_id`` is the smallest id reachable
    by links. Vectors that are null, zero, or hold a component that is null or
    not finite link with nothing and are their own component, as are vectors of
    different lengths; rows that repeat an id count as rows. A null id is never a
    component's smallest id unless nothing else is in it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    good = finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    # components travel as they are stored: single precision is a double's value in half the bytes
    single = rows.schema["vec"].dataType.elementType.typeName() == "float"
    width, kind = (4, "<f4") if single else (8, "<f8")

    spark = vectors.sparkSession
    with scratch(spark):
        def key(batches):
            for b in batches:
                v = b.column(1).to_pylist()
                raw = [None if x is None else (np.array(x, kind) + np.zeros(1, kind)).tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

        keyed = materialize(
            rows.select("vec_id", F.when(good, F.col("vec") if single else F.col("vec").cast("array<double>")).alias("vec"))
            .mapInArrow(key, "vec_id long, raw binary")
            .select("vec_id", "raw", F.sha2("raw", 256).alias("digest")),
            shared_dir(spark),
        )
        classes = materialize(
            keyed.where("raw is not null").groupBy("digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
            .withColumn("cls", F.monotonically_increasing_id())  # stays as it is written
        )
        dims = {r["dim"]: r["n"] for r in classes.groupBy((F.length("raw") / width).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
        codes = {d: code_for(d, n, threshold, lists, per_filter, recall) for d, n in dims.items()}

        small = all(code.m**PARTS < 1 << 31 for code in codes.values())
        numbers = pa.int32() if small else pa.int64()

        def spread(batches):
            for b in batches:
                raws = b.column(1).to_pylist()
                found: list = [None] * len(raws)
                size = np.array([len(r) // width for r in raws])
                for d in np.unique(size).tolist():
                    own = np.nonzero(size == d)[0]
                    x = np.frombuffer(b"".join(raws[i] for i in own), kind).reshape(-1, d).astype(np.float64)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    for i, f in zip(own, codes[d].best(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                        found[i] = f
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(numbers))], ["cls", "raw", "copies", "filters"])

        spread_out = materialize(classes.select("cls", "raw", "copies").mapInArrow(spread, f"cls long, raw binary, copies long, filters array<{'int' if small else 'long'}>"))
        in_filter = spread_out.select((F.length("raw") / width).cast("int").alias("dim"), F.explode("filters").alias("filter"))
        tiles = in_filter.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("dim").alias("of_dim"), F.col("filter").alias("of"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
        each = spread_out.select("*", (F.length("raw") / width).cast("int").alias("dim"), F.explode("filters").alias("filter"))
        placed = each.join(tiles, (F.col("filter") == F.col("of")) & (F.col("dim") == F.col("of_dim"))).withColumn("tile", F.pmod(F.hash("cls"), F.col("tiles")))
        met = placed.select("dim", "filter", "tile", "cls", "raw", "copies", "filters", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
            "dim", "filter", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cls", "raw", "copies", "filters"
        )
        order = ["dim", "filter", "i", "j"]
        grouped = met.repartition(*order).sortWithinPartitions(*order, "tile", "cls")

        def compare(batches):
            for group in sorted_groups(batches, order):
                d, f, i, j = (group.column(k)[0].as_py() for k in order)
                side = np.asarray(group.column("tile"))
                x = np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).reshape(-1, d).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.linalg.norm(x, axis=1)
                cls, copies = np.asarray(group.column("cls")), np.asarray(group.column("copies"))
                linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
                np.fill_diagonal(linked, False)
                if i != j:
                    linked &= side[:, None] != side[None, :]
                busy = np.nonzero(linked.any(axis=1))[0]
                if not len(busy):
                    continue
                linked = linked[np.ix_(busy, busy)]
                own = [np.array(group.column("filters")[int(r)].values, np.int64) for r in busy]
                first = linked & ~_shared_before(own, own, f)
                n = first @ copies[busy]
                roots = _roots(len(busy), linked)
                yield pa.RecordBatch.from_arrays([pa.array(cls[busy]), pa.array(n.astype(np.int64)), pa.array(cls[busy][roots])], ["cls", "n", "root"])

        found = materialize(grouped.mapInArrow(compare, "cls long, n long, root long"))
        n = found.groupBy("cls").agg(F.sum("n").alias("n"))
        labels = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        named = classes.select("cls", "digest", "first", "copies").join(n, "cls", "left").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
        named = materialize(named.withColumn("component", F.coalesce("component", "cls")), shared_dir(spark))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "component").select("digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("vec_id", F.col("digest").alias("own")).join(by_class, F.col("own") == F.col("digest"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
