"""Quality rules: plain counts of a text, and a suffix array that finds what it repeats.

The suffix array is built by prefix doubling: suffixes are sorted by their first
symbols, packed in 64 bits, and only groups that are still equal are sorted again by
the rank of what follows. Neighbours in it that differ in the symbol before them
cannot be extended to the left, nor to the right beyond their common prefix: they are
the occurrences of the maximal repeated substrings, and any other pair of equal
substrings lies inside the spans of such neighbours. So the longest common prefixes
of these pairs alone give the union of all repeated spans and the longest repeat.
Their lengths sum to O(n log n), so they are compared symbol by symbol.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches

#: Shortest repeat that counts, in code points; percent of a text's code points that repeats may cover,
#: and that the longest one may be; the longest repeat that never fails a text by its length alone.
LEAST, COVERED_PERCENT, LONGEST_PERCENT, LONGEST_FREE = 40, 45, 25, 200

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = 0x9E3779B97F4A7C15


def symbols(text: str) -> tuple[np.ndarray, int]:
    """The text's code points as numbers from 1, in the narrowest type, and how many fill 64 bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() < 255:
        return codes.astype(np.uint8) + np.uint8(1), 8
    alphabet, own = np.unique(codes, return_inverse=True)
    kind, per = (np.uint8, 8) if len(alphabet) < 255 else (np.uint16, 4) if len(alphabet) < 65535 else (np.uint32, 2)
    return (own + 1).astype(kind), per


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        own = np.full(n, base, np.uint64)
        own[0] = 1
        out.append(np.cumprod(own))
    return out[0], out[1]


def may_repeat(own: np.ndarray, least: int) -> bool:
    """False only if no two windows of ``least`` symbols are equal: their polynomial
    hashes, equal for equal windows, all differ. Most texts need no suffix array then."""
    n = len(own)
    up, down = _powers(1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(own * up[:n], out=sums[1:])
    hashes = (sums[least:] - sums[:-least]) * down[: n - least + 1]
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def _starts(key: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return new


def neighbours(own: np.ndarray, per: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of suffixes that are next to each other in the suffix array and share a
    prefix of some length up to ``least``, and that length. Suffixes that share no such
    prefix with any other are left where the sort by a part of it put them."""
    n, none = len(own), np.empty(0, np.int64)
    padded = np.concatenate([own, np.zeros(per, own.dtype)]).astype(own.dtype.newbyteorder(">"))
    key = np.ndarray(n, ">u8", padded.tobytes(), strides=own.itemsize).astype(np.uint64)
    order = np.argsort(key)
    new = _starts(key[order])
    first = np.nonzero(~new)[0]  # slots whose suffix shares ``h`` symbols with the one before
    if not len(first):
        return none, none, per
    alone = new & np.append(new[1:], True)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, h, shared = np.nonzero(~alone)[0], per, per
    while len(slots):
        at = order[slots]
        group, then = rank[at], rank[np.minimum(at + h, n)]
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[slots] = at
        new = _starts(group) | _starts(then)
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
        if h <= least:
            first, shared = slots[~new], h
            if not len(first):
                return none, none, shared
        slots = slots[~(new & np.append(new[1:], True))]
    return order[first - 1], order[first], shared


def common_prefixes(own: np.ndarray, a: np.ndarray, b: np.ndarray, shared: int, least: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, which is ``shared``
    at least; 0 where it is below ``least``."""
    n = len(own)
    out = np.zeros(len(a), np.int64)
    live = np.nonzero(np.maximum(a, b) + least <= n)[0]
    for step in range(shared, least):
        live = live[own[a[live] + step] == own[b[live] + step]]
    for i in live.tolist():  # few or short: slices that double
        p, q, size = int(a[i]) + least, int(b[i]) + least, 64
        while True:
            x, y = own[p : p + size], own[q : q + size]
            m = min(len(x), len(y))
            apart = np.nonzero(x[:m] != y[:m])[0]
            if len(apart) or m < size:
                out[i] = p + (int(apart[0]) if len(apart) else m) - a[i]
                break
            p, q, size = p + size, q + size, size * 2
    return out


def repeated_spans(text: str, least: int = LEAST) -> tuple[list[tuple[int, int]], int]:
    """The union of all spans of substrings of ``least`` code points or more that stand
    in the text twice, as ``(start, end)``, and the length of the longest such substring.
    Occurrences may overlap; all of them count, the first too."""
    if len(text) <= least:
        return [], 0
    own, per = symbols(text)
    if not may_repeat(own, least):
        return [], 0
    a, b, shared = neighbours(own, per, least)
    left = (a == 0) | (b == 0) | (own[a - 1] != own[b - 1])
    a, b = a[left], b[left]
    size = common_prefixes(own, a, b, shared, least)
    long = size >= least
    if not long.any():
        return [], 0
    starts, size = np.concatenate([a[long], b[long]]), np.tile(size[long], 2)
    depth = np.cumsum(np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + size, minlength=len(text) + 1))
    inside = np.concatenate([[False], depth[:-1] > 0, [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0].tolist()
    return list(zip(edges[::2], edges[1::2], strict=True)), int(size.max())


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the list holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if int(key.max()) + 1 > (1 << 62) // len(index):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(index) + ids[k : n + k]
    order = np.argsort(key)
    new = _starts(key[order])
    again = order[~(new & np.append(new[1:], True))]
    inside = np.zeros(len(words) + 1, np.int64)
    inside[again] += 1
    inside[again + width] -= 1
    return int(np.count_nonzero(np.cumsum(inside)))


def repeated_lines(text: str) -> int:
    """Lines (cut at line feeds) that hold a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def failed(words: int, repeat_words: int) -> bool:
    """The plain rule: fewer than 50 words, or more than half of them in repeated windows."""
    return words < 50 or 100 * repeat_words > 50 * words


_ROW = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("n_chars_repeated", pa.int64()), ("longest_repeat", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def measured(text: str, least: int = LEAST, covered: float = COVERED_PERCENT, longest: float = LONGEST_PERCENT, free: int = LONGEST_FREE) -> tuple:
    """The values of ``_ROW`` for one text."""
    words = WORD.findall(text)
    again = repeated_words(words)
    spans, most = repeated_spans(text, least)
    inside = sum(e - s for s, e in spans)
    bad = failed(len(words), again)
    kept = not bad and 100 * inside <= covered * len(text) and (most <= free or 100 * most <= longest * len(text))
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), repeated_lines(text), again, bad, kept, inside, most, [{"start": s, "end": e} for s, e in spans]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, covered: float = COVERED_PERCENT, longest: float = LONGEST_PERCENT, free: int = LONGEST_FREE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_chars_repeated, longest_repeat, spans.

    ``spans`` are the code points that substrings of ``least`` or more repeat (see
    ``repeated_spans``). A text is kept if the plain rule does not fail it, repeats
    cover at most ``covered`` percent of its code points, and the longest one is at
    most ``longest`` percent of them or ``free`` code points. Null and empty texts have
    no words, so the plain rule fails them. Rows are independent: repeated rows give
    repeated results, no shuffle, other columns are not read. A text is one task's, at
    some 60 bytes of memory a code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [measured(t or "", least, covered, longest, free) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in found], _ROW.field(i).type) for i in range(len(_ROW))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *_ROW.names])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    row = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_chars_repeated long, longest_repeat long, spans array<struct<start:long,end:long>>"
    return own.mapInArrow(run, f"doc_id {kind}, {row}")


def keep_varied(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    least, covered, longest, free = (limits.get(k, v) for k, v in (("least", LEAST), ("covered", COVERED_PERCENT), ("longest", LONGEST_PERCENT), ("free", LONGEST_FREE)))

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: measured(t or "", least, covered, longest, free)[6])

    return docs.where(good(F.col(text_col)))
