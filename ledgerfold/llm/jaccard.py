"""N-gram Jaccard join by universe partition and pigeonhole.

A document is the set of hashes of its word n-grams. Sizes are cut in bands, each
1 / threshold wide, so partners are in the same or the next band. For the pairs
whose larger set is in a band, the symmetric difference is at most H (from the
band's largest size), so the hash universe is cut in H + 1 segments: two sets of a
linked pair agree on at least one segment, and by the stronger pigeonhole for
rings, on one whose next segment differs in at most one element.

A document indexes its subset of each segment: one key is the cheapest allocation
that the bound admits. Segments that hold nothing are equal in many documents, so
there the allocation is dearer: the subset of the next segment and its one-deletion
neighbourhood go into the key as well. Which of the two a segment gets follows from
its subset alone, so partners agree on it.

Documents with equal sets are one class. Tasks sort the keys of many documents at
once and deal them in packed ranges of the key space, so a key costs no row; what
meets under a key is a group, and groups with the same classes are one. A key that
is hot where it is made leaves there as groups of its own, and only a representative
goes on to its range, so no task holds all of a hot key. Keys are dealt in ROUNDS, a
share of all keys in each, so no more than a share of them is on disk.

Classes of a group are compared with its smallest class, and survivors of a sound
size and histogram filter (a rough one first, so few whole histograms move) are
verified on their whole sets. Groups that are not yet
in one component are compared pair by pair if they are small, else with their most
central class.

Groups that are larger and still apart are compared in tiles, their main component
against the others, as long as that costs less than more keys would: up to LARGE
classes. Keys with more are frequent: a passage that many texts share. For their
classes the allocation is chosen anew: frequent subsets (and empty ones) are skipped,
the other segments get the subset and its one-deletion neighbourhood. Say a pair has
z of its m segments equal, all of them skipped, and e segments that differ in one
element but are skipped for their frequency. Differences add up to less than m, so if
2 z + e <= m one segment differs in exactly one element and is not skipped: there the
pair meets, a whole subset with a deletion. Each class bounds its own z and e; only
classes whose bound fails are compared with each other under their frequent keys, in
tiles. So no link between components is lost, and neither a group of near copies nor
a passage in all texts costs its square, unless the passage is most of each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import components, discard, fresh_name, materialize, scratch, shared_dir, shuffles_removed
from .common import mix64 as _mix
from .vectors import sorted_groups

N, PERCENT = 5, 80
#: Elements of a histogram bin on average, for sets beyond FINE and for smaller ones at most.
PER_BIN, FINE = 4, 512
#: Keys that a task sorts at once; how many of them make a key hot; classes of a
#: group in one row; groups compared pair by pair at once; groups, and tiles of larger
#: ones, that are compared in one task; ranges of the key space for each shuffle partition,
#: and rows for each range, whichever makes more ranges: a range passes a task whole; rounds of keys.
KEYS_AT_ONCE, HOT, TILE, SMALL, LARGE, RANGES, RANGE_ROWS, ROUNDS = 1 << 21, 64, 1024, 64, 4096, 4, 20_000, 2
_SEED = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes does both so)."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int = N) -> set[bytes]:
    own = words(text)
    if len(own) < n:
        return {b" ".join(own)} if own else set()
    return {b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 32


def hashed_all(texts: list[str | None], n: int = N, at_once: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Texts are laid end to end (about ``at_once`` bytes of them); a shingle's hash
    is a difference of prefix sums over the bytes, with white space made single.
    """
    out: list[np.ndarray] = []
    raws, size = [], 0
    for i, t in enumerate(texts):
        raws.append((t or "").encode())
        size += len(raws[-1]) + 1
        if size >= at_once or i == len(texts) - 1:
            out += _hashed(raws, n)
            raws, size = [], 0
    return out


def _hashed(raws: list[bytes], n: int) -> list[np.ndarray]:
    x = _PLAIN[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    y = x[keep]
    space = y == 32
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    # the document of each word: documents begin after the separators, in kept places
    begins = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])[:-1]
    kept = np.cumsum(keep)
    doc = np.searchsorted(kept[begins - 1], starts, "right") - 1
    count = np.bincount(doc, minlength=len(raws))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(len(raws)), made)
    nth = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(made)])[:-1], made)
    a = first[own] + nth
    s, e = starts[a], ends[a + np.minimum(count[own], n) - 1]
    up, down = _powers(len(y) + 1)
    sums = np.zeros(len(y) + 1, np.uint64)
    np.cumsum(_byte_values()[y] * up[: len(y)], out=sums[1:])
    h = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_SEED))
    for i, j in zip(np.cumsum(made) - made, np.cumsum(made), strict=True):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return np.split(h[new], np.cumsum(np.bincount(own[new], minlength=len(raws)))[:-1])


def hashed(text: str | None, n: int = N) -> np.ndarray:
    return hashed_all([text], n)[0]


def most_different(r: int | np.ndarray, s: int | np.ndarray, percent: int = PERCENT):
    """Largest symmetric difference of linked sets of these sizes."""
    return (r + s) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4)
def bands(percent: int = PERCENT) -> np.ndarray:
    """Largest size of each band: partners of a set of size n have at most n * 100 / percent elements."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append((out[-1] + 1) * 100 // percent)
    return np.array(out)


@dataclass
class _Segments:
    """Segments of many sets in one band each, end to end: whose they are, their number
    in their set, how many that has, size, end and subset, and a mark of band and number."""

    of: np.ndarray
    nth: np.ndarray
    m: np.ndarray
    size: np.ndarray
    edges: np.ndarray
    subset: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def without_one(self, which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Subsets of segments without their ``k``-th element, whole for 0."""
        first = self.edges[which] - self.size[which]
        gone = self.value[np.clip(first + k - 1, 0, len(self.value) - 1)]
        return self.subset[which] - np.where(k > 0, gone, np.uint64(0))


def _segments(sets: list[np.ndarray], percent: int) -> Iterator[_Segments]:
    """For the sets' own bands, then for the next ones. Bands so small that linked sets
    are equal have no segments."""
    n = np.array([len(h) for h in sets], np.int64)
    tops = bands(percent)
    own = np.searchsorted(tops, n)
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    whose = np.repeat(np.arange(len(sets)), n)
    value = _mix(h + np.uint64(_SEED))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    for band in (own, own + 1):
        m = np.where(n > 0, most_different(tops[band], tops[band], percent) + 1, 0)
        m[m < 2] = 0
        base, total = np.cumsum(m) - m, int(m.sum())
        # the hashes are spread evenly and sorted, so segments are ranges of them
        at = (h >> np.uint64(32)) * m[whose].astype(np.uint64) >> np.uint64(32)
        size = np.bincount((base[whose] + at.astype(np.int64))[m[whose] > 0], minlength=total)
        of = np.repeat(np.arange(len(sets)), m)
        skipped = np.cumsum(np.where(m > 0, 0, n))[of] if total else np.zeros(0, np.int64)  # elements of sets without segments
        edges = np.cumsum(size) + skipped
        nth = np.arange(total) - base[of]
        place = _mix(nth.astype(np.uint64) + (band[of].astype(np.uint64) << np.uint64(40)))
        yield _Segments(of, nth, m[of], size, edges, sums[edges] - sums[edges - size], place, value)


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows repeated ``sizes`` times, and a count from 0 within each."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def keys_of_all(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of sorted sets of hashes, whether each is a deletion key, and the
    place of its set: one key for each segment of the set's band and of the next one."""
    out = []
    for s in _segments(sets, percent):
        full, i = np.nonzero(s.size > 0)[0], np.nonzero(s.size == 0)[0]
        out.append((_mix(s.place[full] ^ s.subset[full]), np.zeros(len(full), bool), s.of[full]))
        j = np.where(s.nth[i] + 1 < s.m[i], i + 1, i + 1 - s.m[i])
        which, k = _each(1 + s.size[j])  # the next subset itself, then without each of its elements
        near = s.without_one(j[which], k)
        out.append((_mix(_mix(near + s.place[i][which] + np.uint64(_SEED)) + s.place[j][which]), k > 0, s.of[i][which]))
    k, d, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    return k.view(np.int64), d, owner


def keys(h: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    return keys_of_all([h], percent)[:2]


def near_keys(sets: list[np.ndarray], frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The allocation by frequency: keys of all segments, their flags (deletion, frequent,
    next band) and the places of their sets; and for each set and band, how much of
    ``2 z + e <= m`` is left for segments that turn out to be skipped."""
    out, room = [], []
    for step, s in enumerate(_segments(sets, percent)):
        plain = _mix(s.place ^ s.subset)
        hot = (s.size > 0) & np.isin(plain.view(np.int64), frequent)
        band = np.uint8(_NEXT * step)
        whole = np.nonzero(s.size > 0)[0]
        out.append((plain[whole], np.where(hot[whole], _SENT, 0).astype(np.uint8) | band, s.of[whole]))
        some = np.nonzero(s.size > 1)[0]
        which, k = _each(s.size[some])
        out.append((_mix(s.place[some][which] ^ s.without_one(some[which], k + 1)), np.full(len(which), _DELETED, np.uint8) | band, s.of[some][which]))
        count = lambda mask, of=s.of: np.bincount(of[mask], minlength=len(sets))
        skipped = count(hot | (s.size == 0))
        room.append(count(s.m > 0) - 2 * skipped - count(s.size == 1))
    k, f, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    return k.view(np.int64), f, owner, np.stack(room, 1)


def histogram(h: np.ndarray) -> bytes:
    """Elements in equal ranges of the universe: a bin for each element up to FINE of
    them, PER_BIN to a bin in large sets. Counts stop at 255, which only brings
    histograms closer together."""
    n = max(1, len(h))
    bits = int(np.ceil(np.log2(max(n / PER_BIN, min(n, FINE)))))
    bins = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return np.minimum(np.bincount(bins, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(hist: bytes, size: int) -> np.ndarray:
    """A histogram with fewer bins; their number is a power of two, so neighbours add up."""
    return np.frombuffer(hist, np.uint8).reshape(size, -1).sum(axis=1, dtype=np.int32)


def rough_histogram(hist: bytes, n: int) -> bytes:
    """A histogram with an eighth of the bins, of large sets a fourth: enough to part most
    sets that share little. Counts stop at 255 here too."""
    return np.minimum(folded(hist, max(1, len(hist) // (8 if n <= FINE else 4))), 255).astype(np.uint8).tobytes()


def _stacked(hists: pa.Array, size: int, to: int) -> np.ndarray:
    """Histograms of ``size`` bins as rows of ``to`` bins."""
    raw = np.frombuffer(b"".join(hists.to_pylist()), np.uint8).reshape(len(hists), to, -1)
    return raw.sum(axis=2, dtype=np.int32)


def _class(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


#: Flags of a key: of a one-deletion neighbour; stands for a group that left already, or is frequent; of the next band.
_DELETED, _SENT, _NEXT = 1, 2, 4
_MET_ROW = "doc_id long, n long, cls long, hist binary, key long, tile long, many boolean, s1 long, s2 long, n_whole int, members array<long>"
_DEALT = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("hist", pa.binary()), ("key", pa.int64()), ("tile", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("flags", pa.binary())]
)
_DEALT_ROW = "part int, doc_id long, n long, cls long, hist binary, key long, tile long, keys binary, owners binary, flags binary"
_MET = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("hist", pa.binary()), ("key", pa.int64()), ("tile", pa.int64()), ("many", pa.bool_()), ("s1", pa.int64()), ("s2", pa.int64()), ("n_whole", pa.int32()), ("members", pa.list_(pa.int64()))]
)


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(k)))


def _packed(k: np.ndarray, c: np.ndarray, f: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys, one row for each range of them."""
    part = ((k.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    starts, length = _runs(part)
    for at in np.array_split(np.arange(len(starts)), max(1, len(k) >> 20)):
        cuts = [slice(i, i + size) for i, size in zip(starts[at], length[at], strict=True)]
        packed = {name: [x[s].tobytes() for s in cuts] for name, x in (("keys", k), ("owners", c), ("flags", f))}
        yield _batch(_DEALT, len(cuts), part=part[starts[at]].astype(np.int32), **packed)


def _dealt(rows: DataFrame, n: int, percent: int, ranges: int, turn: int, rounds: int) -> DataFrame:
    """Rows of documents (``doc_id, n, cls, hist``; in the first round), of the round's
    packed keys (``keys, owners, flags``) and of groups of hot keys (``key, tile, owners,
    flags``), each with the range it goes to. A task indexes each class that it meets once."""

    def run(batches):
        from pyspark import TaskContext

        tile = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        held: list = []
        count = docs = 0

        def deal():
            nonlocal tile
            k, c, f = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k)
            k, c, f = k[order], c[order], f[order]
            keep = np.ones(len(k), bool)
            starts, length = _runs(k)
            for i, size in zip(starts[length >= HOT], length[length >= HOT], strict=True):
                own = i + np.lexsort((c[i : i + size], f[i : i + size]))
                for j in range(0, size, TILE):
                    at = own[j : j + TILE]
                    columns = {"owners": [c[at].tobytes()], "flags": [f[at].tobytes()], "key": [k[i]], "tile": [tile]}
                    yield _batch(_DEALT, 1, part=[tile % ranges], **columns)
                    tile += 1
                keep[i : i + size] = False
                keep[own[0]] = True
                f[own[0]] |= _SENT
            yield from _packed(k[keep], c[keep], f[keep], ranges)

        for b in small_batches(batches, 512):
            sets = hashed_all(b.column(1).to_pylist(), n)
            cls = [_class(h) for h in sets]
            if turn == 0:
                part = (docs + np.arange(len(sets))) % ranges
                docs += len(sets)
                yield _batch(_DEALT, len(sets), part=part.astype(np.int32), doc_id=b.column(0), n=[len(h) for h in sets], cls=cls, hist=[histogram(h) for h in sets])
            new = {c: h for c, h in zip(cls, sets, strict=True) if c not in seen and len(h)}
            seen.update(new)
            k, d, owner = keys_of_all(list(new.values()), percent)
            own = k.view(np.uint64) % np.uint64(rounds) == turn
            k, d, owner = k[own], d[own], owner[own]
            held.append((k, np.array(list(new), np.int64)[owner], d.astype(np.uint8)))
            count += len(k)
            if count >= KEYS_AT_ONCE:
                yield from deal()
                held, count = [], 0
        if count:
            yield from deal()

    return rows.mapInArrow(run, _DEALT_ROW)


def _keys_in(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = group.filter(group.column("keys").is_valid())
    return tuple(_unpacked(own.column(x), t) for x, t in (("keys", "<i8"), ("owners", "<i8"), ("flags", "u1")))


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid] or [np.zeros(0, kind)])


def _groups_of(k: np.ndarray, c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Groups of the classes that share a key, of which one at least has it whole.
    Of groups with the same classes one stays, unless others of its key left before."""
    order = np.argsort(k)
    k = k[order]
    same = k[1:] == k[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    k, own = k[shared], order[shared]
    c, f = c[own], f[own]
    order = np.lexsort((f & _DELETED, c, k))
    k, c, f = k[order], c[order], f[order]
    starts, length = _runs(k)
    many = np.repeat(np.bitwise_or.reduceat(f, starts) & _SENT > 0, length) if len(k) else np.zeros(0, bool)
    once = np.ones(len(k), bool)  # a class that has a key whole and by deletion has it whole
    once[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    k, c, f, many = k[once], c[once], f[once] & _DELETED, many[once]
    order = np.lexsort((c, f, k))
    c, f = c[order], f[order]
    starts, length = _runs(k)
    whole = np.add.reduceat(1 - f.astype(np.int64), starts) if len(k) else np.zeros(0, np.int64)
    mark = _mix(c.view(np.uint64) + f.astype(np.uint64))
    s1, s2 = (np.add.reduceat(x, starts) if len(k) else x for x in (mark, _mix(mark + np.uint64(_SEED))))
    good = (length > 1) & (whole > 0)
    single = np.nonzero(good & ~many[starts])[0] if len(k) else np.zeros(0, np.int64)
    order = single[np.lexsort((s2[single], s1[single]))]
    new = np.ones(len(order), bool)
    new[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    chosen = np.sort(np.concatenate([order[new], np.nonzero(good & many[starts])[0]])) if len(k) else order
    big = length[chosen] > TILE
    small = chosen[~big]
    for i in range(0, len(small), 8192):
        g = small[i : i + 8192]
        ends = np.cumsum(length[g])
        at = np.arange(ends[-1]) + np.repeat(starts[g] - ends + length[g], length[g])
        members = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(c[at]))
        yield _batch(_MET, len(g), key=k[starts[g]], tile=np.full(len(g), -1), many=many[starts[g]], s1=s1[g].view(np.int64), s2=s2[g].view(np.int64), n_whole=whole[g].astype(np.int32), members=members)
    for g in chosen[big]:
        for j in range(0, length[g], TILE):
            at = np.arange(starts[g] + j, starts[g] + min(j + TILE, length[g]))
            yield _fragment(int(k[starts[g]]), -2 - j, c[at], f[at])


def _fragment(key: int, tile: int, c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """One of the groups of a key that has many; smallest classes that have it whole come first."""
    order = np.lexsort((c, f & _DELETED))
    whole = int((f & _DELETED == 0).sum())
    return _batch(_MET, 1, key=[key], tile=[tile], many=[True], n_whole=[whole], members=[c[order]])


def _met(dealt: DataFrame) -> DataFrame:
    """Rows of documents as they were, and of groups: ``key, tile, many`` (other rows
    may have the same key), a signature of the classes, ``n_whole, members``."""

    def run(batches):
        for group in sorted_groups(batches, ["part"]):
            docs = group.filter(group.column("n").is_valid()).select(["doc_id", "n", "cls", "hist"])
            for b in docs.to_batches(1024):
                yield _batch(_MET, b.num_rows, **{name: b.column(name) for name in ("doc_id", "n", "cls", "hist")})
            hot = group.filter(group.column("key").is_valid()).select(["key", "tile", "owners", "flags"])
            for row in hot.to_pylist():
                yield _fragment(row["key"], row["tile"], np.frombuffer(row["owners"], np.int64), np.frombuffer(row["flags"], np.uint8))
            yield from _groups_of(*_keys_in(group))

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, _MET_ROW)


def _near_dealt(asked: DataFrame, n: int, percent: int, ranges: int) -> DataFrame:
    """Packed keys by the allocation by frequency of ``cls, keys, text`` (the class's
    frequent keys), and rows ``cls, n, doc_id``: what a class has left in a band (0, 1)."""

    def run(batches):
        held: list = []
        count = docs = 0

        def deal():
            k, c, f = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((f & _SENT == 0, k))
            k, c, f = k[order], c[order], f[order]
            starts, length = _runs(k)
            hot = np.repeat(f[starts] & _SENT > 0, length)  # frequent keys that are known to be so here stay here
            yield from _marks(_DEALT, c[hot & (f & _SENT == 0)], f[hot & (f & _SENT == 0)], ranges)
            keep = ~hot
            keep[starts] = True
            yield from _packed(k[keep], c[keep], f[keep], ranges)

        for b in small_batches(batches, 256):
            sets, cls = hashed_all(b.column("text").to_pylist(), n), np.asarray(b.column("cls"))
            frequent = np.unique(np.asarray(b.column("keys").flatten()))
            k, f, owner, room = near_keys(sets, frequent, percent)
            for band in (0, 1):
                yield _batch(_DEALT, len(cls), part=((docs + np.arange(len(cls))) % ranges).astype(np.int32), cls=cls, n=room[:, band], doc_id=np.full(len(cls), band))
            docs += len(cls)
            held.append((k, cls[owner], f))
            count += len(k)
            if count >= KEYS_AT_ONCE:
                yield from deal()
                held, count = [], 0
        if count:
            yield from deal()

    return asked.select("cls", "keys", "text").mapInArrow(run, _DEALT_ROW)


def _marks(schema: pa.Schema, c: np.ndarray, f: np.ndarray, ranges: int = 1) -> Iterator[pa.RecordBatch]:
    """One taken from what classes have left for each of their keys that are skipped."""
    for band in (0, 1):
        cls, times = np.unique(c[(f & _NEXT > 0) == band], return_counts=True)
        for i in range(0, len(cls), 65536):
            x = cls[i : i + 65536]
            more = {"part": (np.arange(len(x)) % ranges).astype(np.int32)} if "part" in schema.names else {}
            yield _batch(schema, len(x), cls=x, n=-times[i : i + 65536], doc_id=np.full(len(x), band), **more)


def _near_met(dealt: DataFrame) -> DataFrame:
    """``cls, n, doc_id`` as they come and for each key that is skipped, and groups of
    the few classes that have a key whole (``n_whole``) with those that have it by deletion."""

    def run(batches):
        for group in sorted_groups(batches, ["part"]):
            left = group.filter(group.column("n").is_valid()).select(["cls", "n", "doc_id"])
            for b in left.to_batches(65536):
                yield _batch(_MET, b.num_rows, **{name: b.column(name) for name in ("cls", "n", "doc_id")})
            k, c, f = _keys_in(group)
            order = np.lexsort((c, f & _DELETED, k))
            k, c, f = k[order], c[order], f[order]
            starts, length = _runs(k)
            if not len(k):
                continue
            sent = np.bitwise_or.reduceat(f, starts) & _SENT > 0
            whole = np.add.reduceat(((f & (_DELETED | _SENT)) == 0).astype(np.int64), starts)
            skipped = np.repeat(sent | (whole > SMALL), length) & (f & _SENT == 0)
            yield from _marks(_MET, c[skipped], f[skipped])
            good = np.nonzero(~sent & (whole <= SMALL) & (whole > 0) & (whole < length))[0]
            short = good[length[good] <= TILE]
            for i in range(0, len(short), 8192):
                g = short[i : i + 8192]
                ends = np.cumsum(length[g])
                at = np.arange(ends[-1]) + np.repeat(starts[g] - ends + length[g], length[g])
                members = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(c[at]))
                yield _batch(_MET, len(g), key=k[starts[g]], tile=np.full(len(g), -1), many=np.zeros(len(g), bool), n_whole=whole[g].astype(np.int32), members=members)
            for g in good[length[good] > TILE]:
                first = c[starts[g] : starts[g] + whole[g]]
                for j in range(whole[g], length[g], TILE):
                    rest = c[starts[g] + j : min(starts[g] + j + TILE, starts[g] + length[g])]
                    yield _batch(_MET, 1, key=[k[starts[g]]], tile=[j], many=[False], n_whole=[whole[g]], members=[np.concatenate([first, rest])])

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, _MET_ROW)


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False where sizes or histograms prove that a pair is no link."""
    if min(na, nb) * 100 < max(na, nb) * percent:
        return False
    size = min(len(a), len(b))
    return int(np.abs(folded(a, size) - folded(b, size)).sum()) <= most_different(na, nb, percent)


def _filtered(pairs: DataFrame, sets: DataFrame, percent: int, hist: str = "hist") -> DataFrame:
    """Pairs ``a, b`` of classes that sizes and histograms (``hist`` of ``sets``) allow."""
    for side in ("a", "b"):
        own = sets.select(F.col("cls").alias(f"c_{side}"), F.col("n").alias(f"n_{side}"), F.col(hist).alias(f"h_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col(f"c_{side}"))

    def run(batches):
        for b in batches:
            n_a, n_b = np.asarray(b.column("n_a")), np.asarray(b.column("n_b"))
            sizes = [np.asarray(pc.binary_length(b.column(k)), np.int64) for k in ("h_a", "h_b")]
            keep = np.zeros(b.num_rows, bool)
            for size in np.unique(np.stack(sizes, 1), axis=0).tolist():
                own = np.nonzero((sizes[0] == size[0]) & (sizes[1] == size[1]))[0]
                few = [_stacked(b.column(k).take(pa.array(own)), s, min(size)) for k, s in zip(("h_a", "h_b"), size, strict=True)]
                keep[own] = np.abs(few[0] - few[1]).sum(axis=1, dtype=np.int64) <= most_different(n_a[own], n_b[own], percent)
            keep &= np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
            yield b.filter(pa.array(keep)).select(["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(run, "a long, b long")


def _with_rough(sets: DataFrame) -> DataFrame:
    """``sets`` with a rough histogram beside ``hist``."""

    def run(batches):
        for b in batches:
            found = [rough_histogram(h, n) for h, n in zip(b.column("hist").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield b.append_column("rough", pa.array(found, pa.binary()))

    return sets.mapInArrow(run, "cls long, first long, n long, hist binary, rough binary")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose texts link, by their whole sets of hashes."""
    for side in ("b", "a"):  # pairs come out by their first class, whose text is then hashed once
        pairs = pairs.join(texts.select(F.col("cls").alias(f"c_{side}"), F.col("text").alias(f"t_{side}")), F.col(side) == F.col(f"c_{side}"))

    def run(batches):
        for b in small_batches(batches, 256):
            names, texts = ([x for k in pair for x in b.column(k).to_pylist()] for pair in (("a", "b"), ("t_a", "t_b")))
            once = dict(zip(names, texts, strict=True))
            found = dict(zip(once, hashed_all(list(once.values()), n), strict=True))
            keep = []
            for x, y in zip(names[: b.num_rows], names[b.num_rows :], strict=True):
                x, y = found[x], found[y]
                both = len(x) + len(y) - len(_union(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _union(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([x, y]))
    return both[np.concatenate([[True], both[1:] != both[:-1]])]


def _members(groups: DataFrame) -> DataFrame:
    each = groups.select("key", "tile", "many", "n_whole", F.posexplode("members").alias("pos", "cls"))
    return each.select("key", "tile", "many", "cls", (F.col("pos") >= F.col("n_whole")).alias("deleted"))


def _unlinked(members: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Rows ``key, tile, cls, deleted, label`` of the keys whose classes are in
    different components; keys of at most ``least`` classes in all are done."""
    named = members.join(labels, F.col("cls") == F.col("node"), "left").select("key", "tile", "many", "cls", "deleted", F.coalesce("component", "cls").alias("label"))
    seen = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("k"), F.bool_or("many").alias("m"), F.bool_and("deleted").alias("gone"))
    mixed = seen.where((F.col("l") < F.col("h")) & (F.col("m") | (F.col("k") > least)) & ~F.col("gone")).select(F.col("key").alias("of"))
    return named.drop("many").join(mixed, F.col("key") == F.col("of"), "left_semi")


def _sized(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select(F.col("cls").alias("own"), "n", "hist"), F.col("cls") == F.col("own")).drop("own")


def _grouped(rows: DataFrame, order: list[str], percent: int, pairs_of) -> DataFrame:
    """Distinct pairs that ``pairs_of`` finds within each group of ``order`` and the
    filter allows. ``pairs_of(side, deleted, hist)`` yields index arrays of pairs."""

    def run(batches):
        for group in sorted_groups(batches, order):
            side, cls, label, n = (np.asarray(group.column(k)) for k in ("tile", "cls", "label", "n"))
            deleted = np.asarray(group.column("deleted"))
            raw = group.column("hist").to_pylist()
            size = min(map(len, raw))  # sizes under one key are near each other
            hist = np.stack([folded(r, size) for r in raw]).astype(np.int16)
            rough = hist.reshape(len(raw), -1, min(8, size)).sum(axis=2, dtype=np.int16)
            for x, y in pairs_of(side, deleted, hist):
                apart = (label[x] != label[y]) & (cls[x] != cls[y]) & ~(deleted[x] & deleted[y])
                apart &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                x, y = x[apart], y[apart]
                step = max(256, (1 << 21) // size)
                for k in range(0, len(x), step):
                    p, q = x[k : k + step], y[k : k + step]
                    for h in (rough, hist):  # few pass the rough one
                        near = np.abs(h[p] - h[q]).sum(axis=1, dtype=np.int64) <= most_different(n[p], n[q], percent)
                        p, q = p[near], q[near]
                    if len(p):
                        p, q = cls[p], cls[q]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    grouped = rows.repartition(*order).sortWithinPartitions(*order, "cls")
    names = [*order, *(c for c in ("tile", "cls", "deleted", "label", "n", "hist") if c not in order)]
    return grouped.select(*names).mapInArrow(run, "a long, b long").distinct()


def _few_or_central(side, deleted, hist):
    """All pairs of a small group; in others, the class nearest to the mean histogram with each other one."""
    if len(hist) <= SMALL:
        yield np.triu_indices(len(hist), 1)
        return
    mean = hist.mean(axis=0)
    far = np.concatenate([np.abs(hist[i : i + 256] - mean).sum(axis=1) for i in range(0, len(hist), 256)])
    hub = int(np.argmin(np.where(deleted, np.inf, far))) if not deleted.all() else 0
    yield np.full(len(hist), hub), np.arange(len(hist))


def _across(side, deleted, hist):
    """Those that have the key whole with those that have it by deletion."""
    x, y = np.nonzero(~deleted)[0], np.nonzero(deleted)[0]
    yield np.repeat(x, len(y)), np.tile(y, len(x))


def _all_pairs(side, deleted, hist):
    """All pairs of a tile, or all between two tiles."""
    two = (side != side[0]).any()
    for i in range(0, len(hist), 256):
        block = np.arange(i, min(i + 256, len(hist)))
        x, y = np.nonzero((block[:, None] < np.arange(len(hist))[None, :]) & (not two or side[block][:, None] != side[None, :]))
        yield block[x], y


def _tiled(rest: DataFrame, large: int) -> DataFrame:
    """Each row once for each tile that its own meets: ``i`` is one tile of a key, ``j``
    the other. Tiles of the key's largest component (negative) meet those of all others,
    which meet each other; what is in one component already is not compared."""
    top = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("of")).agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("k"))
    met = rest.drop("tile").join(top, F.col("key") == F.col("of"))
    main = F.col("label") == F.col("top")
    mains, others = (F.greatest(F.lit(1), F.ceil(c / large)).cast("int") for c in (F.col("n_top"), F.col("k") - F.col("n_top")))
    one = F.col("k") <= large
    tile = F.when(one, 0).when(main, -1 - F.pmod(F.hash("cls"), mains)).otherwise(F.pmod(F.hash("cls"), others))
    there = F.when(one, F.array(F.lit(0))).when(main, F.sequence(F.lit(0), others - 1)).otherwise(F.sequence(-mains, others - 1)).cast("array<long>")
    each = met.select("key", tile.cast("long").alias("tile"), F.explode(there).alias("other"), "cls", "deleted", "label")
    return each.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cls", "deleted", "label")


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
    of distinct ``n``-word shingles (fewer words: all of them as one).
    ``component_id`` is the smallest doc_id that links reach. Texts that are null
    or without words have an empty set and are their own component. Rows that
    repeat an id are rows of their own; a null id is a component's smallest only
    where it has no other.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    with shuffles_removed(spark), scratch(spark) as tmp:
        met = [materialize(_met(_dealt(rows, n, percent, ranges, i, rounds)), f"{tmp}/met{i}") for i in range(rounds)]
        sets = met[0].where("n is not null")
        classes = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("hist").alias("hist"))
        classes = materialize(_with_rough(classes), f"{tmp}/classes")
        sets = materialize(sets.select("doc_id", "n", "cls"), f"{path}/sets")
        groups = reduce(DataFrame.union, met).where("key is not null").select("key", "tile", "many", "s1", "s2", "n_whole", "members")
        groups = materialize(groups.where("not many").dropDuplicates(["s1", "s2"]).union(groups.where("many")).drop("s1", "s2"), f"{tmp}/groups")
        for i in range(rounds):
            discard(spark, f"{tmp}/met{i}")
        stars = groups.where("n_whole > 0").select(F.element_at("members", 1).alias("hub"), F.explode("members").alias("cls")).where("cls <> hub")
        stars = stars.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        near = materialize(_filtered(stars, classes, percent, "rough"), f"{tmp}/roughly")
        near = materialize(_filtered(near, classes, percent), f"{tmp}/near")
        texts = materialize(_texts(rows, classes, near, n), f"{tmp}/texts")
        labels = components(materialize(_verified(near, texts, n, percent), f"{tmp}/links"))
        members, far = _members(groups), None
        for step, pairs_of in enumerate((_few_or_central, _across, _all_pairs)):
            if step == 0:
                rest, order = _unlinked(members, labels, 2), ["key", "tile"]
            elif step == 1:  # groups that are large and apart: allocation by frequency
                apart = materialize(_unlinked(members, labels, SMALL), f"{tmp}/large")
                huge = apart.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > large).select("of")
                middle = apart.join(huge, F.col("key") == F.col("of"), "left_anti")
                often = apart.join(huge, F.col("key") == F.col("of"), "left_semi")
                asked = often.groupBy("cls").agg(F.collect_set("key").alias("keys"))  # a class has as many as its text has segments
                wanted = _texts(rows, classes, asked.select(F.col("cls").alias("a"), F.col("cls").alias("b")), n)
                near_met = materialize(_near_met(_near_dealt(asked.join(wanted, "cls"), n, percent, ranges)), f"{tmp}/allocated")
                left = near_met.where("n is not null").groupBy("cls", "doc_id").agg(F.sum("n").alias("left"))
                far = often.join(left.where("left < 0").select("cls").distinct(), "cls", "left_semi").select(*middle.columns).union(middle)
                far = materialize(far.withColumn("many", F.lit(False)), f"{tmp}/far")
                rest = _unlinked(_members(near_met.where("key is not null")), labels, 1)
            else:  # what is not worth that allocation, or what it has no bound for
                rest, order = _tiled(materialize(_unlinked(far, labels, 1), f"{tmp}/rest"), large), ["key", "i", "j"]
            new = _grouped(_sized(rest, classes), order, percent, pairs_of)
            new = materialize(new.join(near, ["a", "b"], "left_anti"), f"{tmp}/near{step}")
            if not new.limit(1).count():
                continue
            near = near.union(new)
            texts = materialize(_texts(rows, classes, new, n), f"{tmp}/texts{step}")
            labels = _merged(labels, materialize(_verified(new, texts, n, percent), f"{tmp}/links{step}"))
            labels = materialize(labels, f"{tmp}/labels{step}")

        whole_labels = classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("component", "cls").alias("label"))
        whole_labels = materialize(whole_labels, f"{path}/whole")
    least = whole_labels.groupBy(F.col("label").alias("of")).agg(F.min("first").alias("component_id"))
    ids = whole_labels.join(least, F.col("label") == F.col("of")).select(F.col("cls").alias("own"), "component_id")
    out = sets.join(ids, (F.col("cls") == F.col("own")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those between the components so far name them anew."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(f"n_{side}"), F.col("component").alias(f"l_{side}"))
        links = links.join(own, F.col(side) == F.col(f"n_{side}"), "left").withColumn(f"l_{side}", F.coalesce(f"l_{side}", side))
    new = components(links.select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("is"))
    old = labels.join(new, F.col("component") == F.col("was"), "left").select("node", F.coalesce("is", "component").alias("component"))
    alone = new.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("is").alias("component"))
    return old.union(alone)


def _texts(rows: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``cls, text`` of the classes in ``pairs``, from a document of each; ids may repeat
    or be null, so the class of a text found by id is looked at again."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    of = classes.join(needed, "cls", "left_semi").select("cls", F.col("first").alias("of"))

    def run(batches):
        for b in small_batches(batches):
            own = [_class(hashed(t, n)) == c for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(own, pa.bool_()))

    found = rows.join(of, F.col("doc_id").eqNullSafe(F.col("of"))).select("cls", "text").mapInArrow(run, "cls long, text string")
    return found.groupBy("cls").agg(F.min("text").alias("text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id, with its
    columns. Rows that share an id stay or go together; rows with a null id go only
    where their group has an id."""
    found = join(docs, id_col=id_col, **options)
    name = fresh_name(docs, "gone")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]), "left_anti")
