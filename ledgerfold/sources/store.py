"""The log on disk: events, snapshots and streams, appended batch by batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, folds, observe
from ..streaming.models import ReadModels, Table

TABLES = ("event", "snapshot", "stream")
_FACTS = ["event_id", "stream_id", "stream_seq", "seq", "type", "source", "fetcher_version", "observed_at", "source_published_at", "content_hash", "prev_content_hash"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which driver and executors
    share. Where that is unset, a temporary folder takes its place, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """``rows`` written once and read back, so what reads them several times does not make
    them again. ``folder``: where; a new folder under ``spark.checkpoint.dir`` without it."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else shared_folder(rows.sparkSession, "written")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class LogStore:
    """Append-only tables under ``path``, one folder for each batch, and what a batch has
    to know of those before it.

    A batch writes its snapshots and streams first and its events last, each by
    overwriting its own folder, then the state: the tail of each stream, the head of
    each chain, the known contents and streams in buckets, and the seq range of each
    batch. The state goes over from one batch to the next by one manifest, so a batch
    that failed half-way or comes again starts from the same state and writes the same
    rows to the same place. A batch reads and rewrites the buckets that its streams and
    contents fall in, and no events.
    """

    def __init__(self, spark: SparkSession, path: str, chain_key: str = "source", buckets: int = 64):
        self.spark, self.path, self.chain_key = spark, path, chain_key
        tables = {
            "tail": Table("rows", ("stream_id",), "next_seq"), "head": Table("rows", (chain_key,), "seq"), "content": Table("rows", ("content_hash",), "batch"), "stream": Table("rows", ("stream_id",), "batch"),
            "range": Table("rows", ("batch",), "batch", spread=("log",)),
        }
        self.state = ReadModels(spark, f"{path}/state", tables, lambda batch, folder: {}, buckets=buckets)

    def _batches(self, table: str, before: int | None = None) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = sorted(int(n.split("=")[1]) for n in found if n.startswith("batch="))
        return [f"{self.path}/{table}/batch={n}" for n in numbers if before is None or n < before]

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """All rows of a table, or those of the batches before one."""
        paths = self._batches(table, before)
        return self.spark.read.parquet(*paths) if paths else None

    def append(self, observations: DataFrame, batch_id: int) -> None:
        """For a job or ``foreachBatch``. ``observations``: event_id, stream_id, source,
        fetcher_version, observed_at, source_published_at, content_hash (null for an
        absence), payload."""
        observations = observations.persist()  # asked for keys, contents, streams and events
        try:
            narrow = observations.drop("payload")
            near = lambda table, keys: self.state.near(table, keys, batch_id)
            tail, offset = near("tail", narrow), self.state.offset(batch_id)
            found = observe.transitions(narrow, "stream_id", ["observed_at", "event_id"], "content_hash", tail)
            numbered = observe.global_sequence(found, ["observed_at", "event_id"], F.date_trunc("hour", "observed_at"), offset)
            contents = observations.where("content_hash is not null").select("content_hash", "payload")
            snapshots = self._write(observe.new_only(contents, "content_hash", near("content", contents)), "snapshot", batch_id)
            streams = self._write(observe.new_only(narrow.select("stream_id", "source"), "stream_id", near("stream", narrow)), "stream", batch_id)
            events = self._write(chain.append(numbered.select(*_FACTS), self.chain_key, near("head", narrow)), "event", batch_id)
            self._remember(events, snapshots, streams, tail, batch_id)
        finally:
            observations.unpersist()

    def _remember(self, events: DataFrame, snapshots: DataFrame, streams: DataFrame, tail: DataFrame | None, batch_id: int) -> None:
        """The state after a batch. A stream's last event tells its tail: a content that is
        gone is the one before it. ``batches``: those that have events of the stream."""
        number = F.lit(batch_id).cast("long")
        last = folds.latest(events, "stream_id", "stream_seq").select("stream_id", F.col("type").alias("last_type"), F.coalesce("content_hash", "prev_content_hash").alias("last_content"), (F.col("stream_seq") + 1).alias("next_seq"))
        before = F.array().cast("array<long>")
        if tail is not None:
            last = last.join(tail.select("stream_id", F.col("batches").alias("_before")), "stream_id", "left")
            before = F.coalesce("_before", before)
        last = last.withColumn("batches", F.concat(before, F.array(number))).drop("_before")
        span = events.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n"))
        parts = {
            "tail": last, "head": folds.latest(events.select(self.chain_key, "seq", "log_hash"), self.chain_key), "content": snapshots.select("content_hash", number.alias("batch")), "stream": streams.select("stream_id", number.alias("batch")),
            "range": span.select(F.lit("log").alias("log"), number.alias("batch"), "low", "high", "n").where("n > 0"),
        }
        self.state.put(parts, batch_id, events.agg(F.max("seq")).first()[0])

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> DataFrame:
        path = f"{self.path}/{table}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _events(self, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/event/batch={b}" for b in batches]) if batches else None

    def recent(self, n: int, before: int | None = None, where: Column | None = None) -> DataFrame | None:
        """The last ``n`` events before a seq that meet a condition, newest first. Batches
        are walked back by their seq ranges, each time twice as many, until the page is
        full: a page near the end of the log reads the last batches only."""
        ranges = self.state.read("range")
        if ranges is None:
            return None
        stored = ranges.collect()  # a row a batch
        known = sorted(((r.low, r.batch, r.n) for r in stored if before is None or r.low < before), reverse=True)
        own = (F.lit(True) if before is None else F.col("seq") < before) & (F.lit(True) if where is None else where)
        taken = 0
        while taken < len(known):
            taken, held = max(1, 2 * taken), 0
            while taken < len(known) and sum(k[2] for k in known[:taken]) < n:
                taken += 1
            rows = self._events([k[1] for k in known[:taken]]).where(own).orderBy(F.desc("seq")).limit(n)
            if where is None and before is None or taken >= len(known) or (held := rows.count()) >= n:
                return rows
        return self._events([r.batch for r in stored[:1]]).where(F.lit(False)) if stored else None

    def stream_events(self, stream_id: str) -> DataFrame | None:
        """All events of one stream: its tail, in one bucket, names the batches that have them."""
        own = F.col("stream_id") == stream_id
        tail = self.state.near("tail", self.spark.createDataFrame([(stream_id,)], "stream_id string"))
        found = None if tail is None else tail.where(own).first()
        return self._events(list(found.batches)).where(own) if found else None
