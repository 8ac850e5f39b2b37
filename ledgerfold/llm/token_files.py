"""Token ids in files of patched frame-of-reference blocks.

A table of segments in Parquet (so any store that Spark writes to will do, and a
lost task is written again whole). A segment holds whole documents in ascending
id order: their ids, their token counts and one binary image of all their tokens.

Image: ``PFR1``, block size, number of blocks, number of exceptions, number of
tokens (unsigned 32-bit, little-endian), then by block: base, width (one byte),
start of its words, start of its exceptions; then exception values and positions;
then the packed words. A block is its minimum (the base) plus, for each value, the
low ``width`` bits of the rest; the width is what the given percentile of the
block needs, and values that need more stand in full in the exception list.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, small_batches

BLOCK = 128
SEGMENT_TOKENS = 1 << 16
PERCENTILE = 0.9
MAGIC = b"PFR1"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _mask(bits: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << bits) - np.uint64(1)).astype(np.uint32)


def _places(starts: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit in it where each of a block's ``size`` values begins."""
    at = starts.astype(np.uint64)[:, None] * np.uint64(64) + bits * np.arange(size, dtype=np.uint64)
    return (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    base = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v -= base[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bits(np.partition(v, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    wide = (v >> width[:, None].astype(np.uint32)) != 0
    where, pos = np.nonzero(wide)
    exceptions = v[where, pos]
    exc_start = np.concatenate([[0], np.cumsum(wide.sum(axis=1))]).astype("<u4")
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))]).astype("<u4")
    words = np.zeros(int(starts[-1]), np.uint64)
    own = np.nonzero(width)[0]
    if len(own):
        bits = width[own].astype(np.uint64)[:, None]
        low = (v[own] & _mask(bits)).astype(np.uint64)
        word, shift = _places(starts[own], bits, BLOCK)
        first = np.flatnonzero(np.diff(word.ravel(), prepend=-1))  # of the values that begin in a word
        words[word.ravel()[first]] = np.bitwise_or.reduceat((low << shift).ravel(), first)
        over = np.nonzero(shift + bits > 64)  # one value at most goes on in a word
        words[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
    head = np.array([BLOCK, blocks, len(exceptions), n], "<u4")
    return b"".join(
        x.tobytes() if isinstance(x, np.ndarray) else x
        for x in (MAGIC, head, base.astype("<u4"), width, starts, exc_start, exceptions.astype("<u4"), pos.astype(np.uint8), words.astype("<u8"))
    )


def unpack(image: bytes) -> np.ndarray:
    if image[:4] != MAGIC:
        raise ValueError("not a token segment")
    size, blocks, n_exc, n = map(int, np.frombuffer(image, "<u4", 4, 4))
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(image, kind, count, at)
        at += got.nbytes
        return got

    base, width, starts, exc_start = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
    exceptions, pos = take("<u4", n_exc), take("u1", n_exc)
    words = np.append(take("<u8", int(starts[-1])), np.uint64(0))  # blocks without words point beyond the last one
    bits = width.astype(np.uint64)[:, None]
    word, shift = _places(starts[:-1], bits, size)
    low = words[word] >> shift
    over = np.nonzero(shift + bits > 64)
    low[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    v = low.astype(np.uint32) & _mask(bits)
    v[np.repeat(np.arange(blocks), np.diff(exc_start)), pos] = exceptions
    return (v + base[:, None]).reshape(-1)[:n].astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, append ``end_id`` and write the segments to ``path``.

    Documents are ranged by id over the shuffle partitions (texts move once, and
    are encoded where they arrive), and sorted inside; rows that share an id are
    ordered by text, null ids come first, null texts hold the end id alone.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, number, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        ids, sizes, parts = [], [], []

        def segment():
            nonlocal number, start, ids, sizes, parts
            tokens = np.frombuffer(b"".join(parts), "<u4")
            row = pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": number, "shard_start": start, "n_tokens": len(tokens), "first_doc": ids[0], "doc_ids": ids, "doc_tokens": sizes, "image": pack(tokens)}],
                schema=schema,
            )
            number, start, ids, sizes, parts = number + 1, start + len(tokens), [], [], []
            return row

        schema = pa.schema(
            [("shard", pa.int32()), ("segment", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("image", pa.binary())]
        )
        held = 0
        for b in small_batches(batches):
            for doc, raw in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist()), strict=True):
                ids.append(doc)
                sizes.append(len(raw) // 4 + 1)
                parts += [raw, end]
                held += sizes[-1]
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    held = 0
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(
        run, "shard int, segment long, shard_start long, n_tokens long, first_doc long, doc_ids array<long>, doc_tokens array<long>, image binary"
    ).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary) from the files: ``start`` counts the
    ids of all documents before. A row for each shard is summed and sent to all tasks, no
    more; the images stay where they are read."""
    segments = spark.read.parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("held"), F.min_by("first_doc", "segment").alias("first_doc"))
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(F.col("shard").alias("own"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    found = segments.join(F.broadcast(starts), segments.shard == starts.own).select((F.col("offset") + F.col("shard_start")).alias("at"), "doc_ids", "doc_tokens", "image")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, ids, sizes, image = (batch.column(k)[i].as_py() for k in range(4))
                raw, ends = memoryview(unpack(image).tobytes()), np.cumsum(sizes)
                for k in range(0, len(ids), 512):
                    own = slice(k, k + 512)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[own], pa.int64()),
                            pa.array([at + int(e) - s for e, s in zip(ends[own], sizes[own], strict=True)], pa.int64()),
                            pa.array(sizes[own], pa.int64()),
                            pa.array([bytes(raw[4 * (int(e) - s) : 4 * int(e)]) for e, s in zip(ends[own], sizes[own], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(binary: str = "ids"):
    return F.crc32(F.col(binary)).alias("ids_crc32")


def checksum(raw: bytes) -> int:
    return zlib.crc32(raw)
