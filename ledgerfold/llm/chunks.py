"""Per-document sums of values that are looked up once for each distinct key.

Documents are taken in chunks. A chunk keeps a dictionary of its distinct keys
and, for each document, which of them it holds and how often (packed). Only the
dictionaries are shuffled, in lists dealt by key: they meet the value of their key
and go back to their chunk, where the documents' sums are made. So what moves is
one entry for each key of a chunk, however often its documents hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import materialize

#: Distinct keys and bytes of text that close a chunk; lists a dictionary is dealt to, for each shuffle partition.
CHUNK_KEYS, CHUNK_BYTES, LISTS = 1 << 19, 64 << 20, 4

_END = b"\xff"  # no UTF-8 text holds it


def squeeze(x: np.ndarray) -> bytes:
    """Small unsigned numbers: byte planes, then zstd."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def expand(x: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x, max_output_size=max(1, 4 * n)), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def chunked(docs: DataFrame, keys_of: Callable[[], Callable[[str], tuple[list, np.ndarray, int]]]) -> DataFrame:
    """Chunks of ``docs`` (doc_id long, text string), written to shared storage.

    ``keys_of()`` is called once a task and gives a function from a text to its
    keys, how often it holds each, and one number of the document's own.
    """
    schema = pa.schema(
        [("chunk", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("which", pa.binary()), ("times", pa.binary())]
    )

    lists_of_all = LISTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        find = keys_of()
        number, size = TaskContext.get().partitionId() << 32, 0
        index: dict = {}
        held: list[tuple] = []
        which: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def close():
            nonlocal number, size, index, held, which, times
            # the dictionary anew: by list, sorted inside, so that a list is a range of places
            keys = list(index)
            part = np.fromiter((zlib.crc32(k.encode()) for k in keys), np.int64, len(keys)) % lists_of_all
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
            order = order[np.argsort(part[order], kind="stable")]
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            n = np.array([d[3] for d in held])
            whose = np.repeat(np.arange(len(held), dtype=np.int64) << 32, n) | place[np.concatenate(which)]
            by_doc = np.argsort(whose)
            steps = np.diff(whose[by_doc], prepend=0)
            firsts = (np.cumsum(n) - n)[n > 0]
            steps[firsts] = whose[by_doc][firsts] & 0xFFFFFFFF
            lists = {k: [d[i] for d in held] for i, k in enumerate(("doc_ids", "n_bytes", "own", "held"))}
            yield pa.RecordBatch.from_pylist([{"chunk": number, "which": squeeze(steps), "times": squeeze(np.concatenate(times)[by_doc]), **lists}], schema=schema)
            at = 0
            for own in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
                if len(own):
                    mine = [keys[i] for i in own]
                    row = {"chunk": number, "part": int(part[own[0]]), "start": at, "packed": zstandard.compress(_END.join(k.encode() for k in mine), 3)}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                    at += len(own)
            number, size, index, held, which, times = number + 1, 0, {}, [], [], []

        for b in small_batches(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, often, own = find(text or "")
                places = np.fromiter((index.setdefault(k, len(index)) for k in keys), np.int64, len(keys))
                n = len((text or "").encode())
                held.append((doc, n, own, len(keys)))
                which.append(places.astype(np.int32))
                times.append(np.asarray(often, np.int32))
                size += n
                if len(index) >= CHUNK_KEYS or size >= CHUNK_BYTES:
                    yield from close()
        if held:
            yield from close()

    row = "chunk long, part int, start int, packed binary, doc_ids array<long>, n_bytes array<long>, own array<long>, held array<long>, which binary, times binary"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, row))


def valued(chunks: DataFrame, value_of: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """``chunk, start, values``: a value for each text key of a dictionary, made once
    for each distinct one. All lists of a part come to one task one after the other, and
    what has been seen is kept for that part only."""

    def run(batches):
        made = value_of()
        seen: dict = {}
        last = None
        for b in batches:
            for i in range(b.num_rows):
                if b.column(1)[i].as_py() != last:
                    last, seen = b.column(1)[i].as_py(), {}
                keys = _keys(b.column(3)[i].as_py())
                new = [k for k in keys if k not in seen]
                seen.update(zip(new, made(new), strict=True))
                values = pa.array([list(map(seen.__getitem__, keys))], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), values], ["chunk", "start", "values"])

    lists = chunks.where("packed is not null").select("chunk", "part", "start", "packed").repartition("part").sortWithinPartitions("part")
    return lists.mapInArrow(run, "chunk long, start int, values array<float>")


def _keys(packed: bytes) -> list[str]:
    return [k.decode() for k in zstandard.decompress(packed).split(_END)]


def summed(chunks: DataFrame, values: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, own, times, total``: for each document, the number of keys
    with repeats and the sum of their values. ``values``: ``chunk, start, values``
    (lists, each a range of places)."""
    back = values.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("start", "values")).alias("prices"))
    own = chunks.where("doc_ids is not null").select("chunk", "doc_ids", "n_bytes", "own", "held", "which", "times")
    both = own.join(back, F.col("chunk") == F.col("of"), "left").select("doc_ids", "n_bytes", "own", "held", "which", "times", "prices")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                size, own, held = (np.array(b.column(k)[i].values, np.int64) for k in (1, 2, 3))
                ends = np.cumsum(held)
                which, times = (expand(b.column(k)[i].as_py(), int(ends[-1])).astype(np.int64) for k in (4, 5))
                price = np.zeros(1)
                if b.column(6)[i].is_valid:
                    prices = b.column(6)[i].values
                    order = np.argsort(np.asarray(prices.field("start")))
                    parts = prices.field("values")
                    price = np.concatenate([np.asarray(parts[int(k)].values, np.float64) for k in order])
                walk = np.concatenate([[0], np.cumsum(which)])
                place = walk[1:] - np.repeat(walk[ends - held], held)  # places start anew from 0 in each document
                value = np.concatenate([[0.0], np.cumsum(price[place] * times)])
                often = np.concatenate([[0], np.cumsum(times)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i].values, pa.array(size), pa.array(own), pa.array(often[ends] - often[ends - held]), pa.array(value[ends] - value[ends - held])],
                    ["doc_id", "n_bytes", "own", "times", "total"],
                )

    return both.mapInArrow(run, "doc_id long, n_bytes long, own long, times long, total double")
