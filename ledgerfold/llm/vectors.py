"""Vectors as Arrow batches and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are not null and whose components are finite and not null."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec`` of all rows but those with a null id or a vector that is not finite."""
    own = rows.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    return own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))


def matrices(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each length."""
    flat, ends = np.asarray(vectors.flatten()), np.cumsum(np.asarray(vectors.value_lengths()))
    starts = ends - np.asarray(vectors.value_lengths())
    who = np.asarray(ids)
    for d in np.unique(ends - starts):
        own = np.nonzero(ends - starts == d)[0]
        yield who[own], flat[starts[own][:, None] + np.arange(d)]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; the rows come sorted by key, nulls apart."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k)) for k in key]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        at = 0
        for cut in np.nonzero(change)[0].tolist():
            if cut > at:
                held.append(b.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
