"""A Merkle manifest of a table: one digest for all rows, and a proof for each.

Leaves are digests of rows. Each source is a tree over its leaves by id, and one more
tree stands over the sources' roots. A node is the digest of up to ``ARITY`` nodes
that follow each other, until one is left.

A tree of any size is cut in superblocks of ``ARITY ** HEIGHT`` leaves that follow
each other; what is reduced from a superblock is one leaf of the tree above, which is
cut again, so a superblock and its group are bounded however large a source is. Small
trees share a group. On the way down, each superblock's leaves are cogrouped with the
one outer node that stands for it and carries the siblings from there to the root:
the group finishes the local reduction, puts local and outer siblings together and
folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY, HEIGHT = 3, 8


@dataclass(frozen=True)
class Cut:
    """How trees are cut: levels of a superblock, and groups that small trees are dealt to."""

    height: int
    buckets: int

    @property
    def full(self) -> int:
        return ARITY**self.height


#: Columns of a row that its leaf covers.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")

#: A level of a proof: what stands before and behind the node in its run.
_LEVEL = "array<struct<before:string,behind:string>>"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value as UTF-8 byte count, colon and text; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    told = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def reduced(nodes: list[str], levels: int | None) -> Iterator[list[str]]:
    """The levels above ``nodes``: as many as are said, or until one node is left."""
    while len(nodes) > 1 if levels is None else levels > 0:
        nodes = [digest_of(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        levels = None if levels is None else levels - 1
        yield nodes


def local_proofs(nodes: list[str], levels: int | None) -> list[list[tuple[str, str]]]:
    """Siblings of every node, level by level: those before and those behind it in its run."""
    own: list[list[tuple[str, str]]] = [[] for _ in nodes]
    width, level = 1, nodes
    for above in reduced(nodes, levels):
        beside = []
        for i in range(len(level)):
            at = i - i % ARITY
            beside.append(("".join(level[at:i]), "".join(level[i + 1 : at + ARITY])))
        for i, path in enumerate(own):
            path.append(beside[i // width])
        width, level = width * ARITY, above
    return own


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, behind in path:
        node = digest_of([before, node, behind])
    return node


def positions(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Adds ``pos``, from 0, and ``size`` within each ``tree`` in a total order, written
    to shared storage. Rows are dealt by ranges of (tree, order), so that a tree with
    most rows is spread; a row for each tree and range says where it goes on."""
    by = [F.asc_nulls_first(tree), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_range", F.shiftright("_at", 33)))
    held = dealt.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    all_of, before = Window.partitionBy(tree), Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col(tree).alias("_of"), F.col("_range").alias("_in"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(all_of).alias("size"))
    placed = dealt.join(starts, F.col(tree).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return materialize(placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_of", "_in", "_shift"))


def _dealt(several: Column, block: Column, cut: Cut) -> Column:
    """What a superblock's group is named by: blocks of a tree that has several are
    groups of their own, trees of one block go together by hash."""
    together = F.pmod(F.xxhash64("tree"), F.lit(cut.buckets)) - F.lit(1 << 62)
    return F.when(several, F.xxhash64("tree", block)).otherwise(together).alias("deal")


def _with_deal(nodes: DataFrame, cut: Cut) -> DataFrame:
    block = F.floor(F.col("pos") / cut.full).cast("long")
    return nodes.select("*", block.alias("block"), _dealt(F.col("size") > cut.full, block, cut))


def _blocks(own: pd.DataFrame, cut: Cut) -> Iterator[tuple[tuple, int | None, pd.DataFrame]]:
    """The superblocks in a group, each in order: (tree, block), the levels to reduce it
    by (a block of a tree that has several: ``height``, a whole tree: to its root), rows."""
    own = own.sort_values(["tree", "pos"], kind="stable", na_position="first").reset_index(drop=True)
    keys = list(zip(own["tree"].where(own["tree"].notna(), None), own["block"], strict=True))
    starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        part = own.iloc[a:b]
        yield keys[a], cut.height if part["size"].iloc[0] > cut.full else None, part


def tops(nodes: DataFrame, cut: Cut) -> DataFrame:
    """``tree, pos, size, node`` of the tree above ``nodes``: a node for every superblock."""

    def reduce(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, block), levels, part in _blocks(own, cut):
            level = part["node"].tolist()
            for level in reduced(level, levels):
                pass
            out.append((tree, block, -(-int(part["size"].iloc[0]) // cut.full), level[0]))
        return pd.DataFrame(out, columns=["tree", "pos", "size", "node"])

    own = _with_deal(nodes.select("tree", "pos", "size", "node"), cut)
    return materialize(own.groupBy("deal").applyInPandas(reduce, "tree string, pos long, size long, node string"))


def _proofs(own: pd.DataFrame, above: pd.DataFrame, cut: Cut) -> Iterator[tuple[pd.DataFrame, str, list[list[tuple[str, str]]]]]:
    """Each superblock in a group, the root of its tree, and its nodes' siblings up to
    the root: those inside, then those of the outer node that stands for it."""
    trees = above["tree"].where(above["tree"].notna(), None)
    outer = {(t, p): (top, [(x["before"], x["behind"]) for x in path]) for t, p, top, path in zip(trees, above["pos"], above["top"], above["path"], strict=True)}
    for key, levels, part in _blocks(own, cut):
        top, outside = outer[key]
        yield part, top, [path + outside for path in local_proofs(part["node"].tolist(), levels)]


def _cogrouped(nodes: DataFrame, outer: DataFrame, join, schema: str, cut: Cut) -> DataFrame:
    """Each superblock's nodes and its outer node (tree, pos, size, top, path) in one group."""
    above = outer.select("tree", "pos", "top", "path", _dealt(F.col("size") > 1, F.col("pos"), cut))
    return _with_deal(nodes, cut).groupBy("deal").cogroup(above.groupBy("deal")).applyInPandas(join, schema)


def with_paths(nodes: DataFrame, outer: DataFrame, cut: Cut) -> DataFrame:
    """``nodes`` with ``top``, the root of their tree, and ``path``, their siblings up to
    the root of all. ``outer``: the same of the tree above."""

    def join(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, top, paths in _proofs(own, above, cut):
            told = [[{"before": x, "behind": y} for x, y in path] for path in paths]
            out.append(part[["tree", "pos", "size", "node"]].assign(top=top, path=told))
        return pd.concat(out)

    row = f"tree string, pos long, size long, node string, top string, path {_LEVEL}"
    return materialize(_cogrouped(nodes.select("tree", "pos", "size", "node"), outer, join, row, cut))


def _above(nodes: DataFrame, cut: Cut) -> list[DataFrame]:
    """``nodes`` and the trees above them, until each is one node."""
    layers = [nodes]
    while layers[-1].where("size > 1").limit(1).count():
        layers.append(tops(layers[-1], cut))
    return layers


def manifest(docs: DataFrame, covered: tuple[str, ...] = COVERED, id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None, with_proof: bool = False, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified, and with ``with_proof`` the proof itself (levels of siblings, from the leaf up).

    ``changed`` gives columns as they are now; the leaf of these is folded with the
    siblings of the table as it was, and ``verified`` says whether that is the root.
    Leaves of a source stand by id (null first), rows that share an id by their leaf;
    sources by their UTF-8 bytes, null first. Rows with equal values are leaves of their
    own. A table of one row has that leaf as root and no siblings; an empty one has no
    rows. A group holds one superblock of a large source
    (6,561 rows of a few digests), or small sources of about that many rows together.
    """
    now = leaf([(changed or {}).get(c, F.col(c)) for c in covered])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("tree"), leaf([F.col(c) for c in covered]).alias("node"), now.alias("now"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    cut = Cut(height, rows.count() // ARITY**height + 1)
    layers = _above(positions(rows, "tree", [F.asc_nulls_first("doc_id"), F.asc("node"), F.asc("row")]), cut)
    forest = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    roots = positions(forest, "tree", [F.asc_nulls_first("of")])
    over = _above(roots, cut)
    paths = over[-1].select("tree", "pos", "size", "node", F.col("node").alias("top"), F.array().cast(_LEVEL).alias("path"))
    root = materialize(over[-1].select(F.col("node").alias("root")))
    for nodes in over[-2::-1]:
        paths = with_paths(nodes, paths, cut)
    paths = roots.join(paths.select("pos", "path"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("size"), "node", F.col("node").alias("top"), "path")
    for nodes in layers[-2:0:-1]:
        paths = with_paths(nodes, paths, cut)

    def proved(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, top, found in _proofs(own, above, cut):
            done = part[["doc_id", "node"]].rename(columns={"node": "leaf"}).assign(subroot=top, proof_sha256=[digest_of([x for level in path for x in level]) for path in found])
            done["folded_root"] = [folded(n, path) for n, path in zip(part["now"], found, strict=True)]
            out.append(done.assign(proof=[[{"before": x, "behind": y} for x, y in path] for path in found]) if with_proof else done)
        return pd.concat(out)

    row = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string" + f", proof {_LEVEL}" * with_proof
    told = _cogrouped(layers[0].select("tree", "pos", "size", "node", "now", "doc_id"), paths, proved, row, cut)
    both = told.join(F.broadcast(root))  # one row
    return both.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["proof"] * with_proof)
