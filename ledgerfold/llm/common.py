"""Helpers that the corpus operators share: shared storage, tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes evenly (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs in local mode, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerfold-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage ends here and
    a lost executor costs no recomputation of what came before. Without ``path``, within
    ``scratch``, the table lasts as long as that."""
    spark = df.sparkSession
    path = path or _new_path(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


#: The folder of the innermost ``scratch`` block of this thread.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def _new_path(spark: SparkSession) -> str:
    own = _SCRATCH.get()
    return f"{own}/{uuid.uuid4().hex}" if own else shared_dir(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder for tables that are not needed once the block ends; it is deleted
    then, after failures too. What the block returns must be written elsewhere. Blocks of
    other threads have folders of their own."""
    path = shared_dir(spark)
    outer = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(outer)
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialized folder that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark deletes what an execution has shuffled as soon as it ends,
    not when the driver's collector comes by. For steps that each write a table."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column already, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (columns ``a``, ``b``: long).

    Returns ``node``, ``component`` (smallest node reachable) for each node that
    has an edge. Every round, each node takes the smallest label around it, roots
    hook to the smallest label seen by any of their members, and labels jump one
    pointer further, so the rounds grow with the logarithm of the diameter. Only
    hash aggregates and equi-joins move data; each round is written to shared
    storage. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    one = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    path = _new_path(spark)
    links = materialize(one, f"{path}/edges")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{path}/l0"
    )
    for i in range(max_rounds):
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        )
        seen = labels.join(near, labels.node == near.a).select(
            "node", "label", F.least("label", "near").alias("best")
        )
        seen = materialize(seen, f"{path}/s{i}")
        hooks = seen.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("to"))
        hooks = materialize(hooks, f"{path}/h{i}")
        jump = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.root"), "left").select(
            F.col("x.root").alias("root"), F.least(F.col("x.to"), F.col("y.to")).alias("to")
        )
        new = seen.join(jump, seen.label == jump.root).select("node", "label", F.least("best", "to").alias("new"))
        new = materialize(new, f"{path}/n{i}")
        moved = new.where("label <> new").limit(1).count()
        for old in (f"s{i}", f"h{i}", f"n{i - 1}" if i else "l0"):
            discard(spark, f"{path}/{old}")
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            discard(spark, f"{path}/edges")
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
