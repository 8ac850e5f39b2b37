"""Structured Streaming: change detection with state, and read models that fold as events come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators import folds
from .models import ReadModels, Table

EVENT = "stream_id string, at long, event_id long, type string, content_hash string, prev_content_hash string, stream_seq long"


class Transitions(StatefulProcessor):
    """Per stream: whether the last observation was there, the last content, and how many
    events there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", StructType([StructField("there", BooleanType()), StructField("content", StringType()), StructField("events", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What a stored log knows of the stream."""
        for r in initialState.itertuples():
            self.state.update((r.last_type != "vanished", r.last_content, int(r.next_seq) - 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        there, last, events = self.state.get() if self.state.exists() else (False, None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            now = r.content_hash if isinstance(r.content_hash, str) else None
            kind = None
            if now is None:
                kind = "vanished" if there else None
            elif last is None:
                kind = "observed"
            elif not there:
                kind = "restored"
            elif now != last:
                kind = "changed"
            if kind:
                events += 1
                out.append((key[0], r.at, r.event_id, kind, now, last, events))
            there, last = now is not None, now or last
        self.state.update((there, last, events))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def transitions(observations: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """Streaming twin of ``observe.transitions`` over ``stream_id, at, event_id,
    content_hash``. Rows of a batch are put in order; batches must come in order.
    ``tail`` (see ``observe.tail_state``, not a stream): what a stored log knows, from
    which the first batch goes on, so the events can be appended to that log. State is
    one small row a stream, without expiry; use the RocksDB store."""
    known = None if tail is None else tail.select("stream_id", "last_type", "last_content", "next_seq").groupBy("stream_id")
    return observations.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Transitions(), outputStructType=EVENT, outputMode="Append", timeMode="None", initialState=known)


class Fold(ReadModels):
    """A read model of one table. With ``children``, ``key`` is a parent whose rows are
    replaced together by those of its last event; ``heads`` gives the last event of every
    parent of a batch (those that ``derive`` found rows for, without it)."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], order: str = "seq", derive: Callable[[DataFrame], DataFrame] | None = None, children: bool = False, buckets: int = 64, heads: Callable[[DataFrame], DataFrame] | None = None):
        keys = (key,) if isinstance(key, str) else tuple(key)

        def parts(batch: DataFrame, _: str) -> dict[str, DataFrame]:
            rows = derive(batch) if derive else batch
            return {"rows": rows} | ({"heads": folds.heads(heads(batch) if heads else rows, keys[0], order)} if children else {})

        super().__init__(spark, path, {"rows": Table("children" if children else "rows", keys, order)}, parts, keys[0] if children else None, order, buckets)

    def _folders(self, version: int | None) -> dict[int, str]:
        return self._manifest(version)[0]["rows"]

    def read(self, table: str = "rows", version: int | None = None) -> DataFrame | None:
        return super().read(table, version)


def replay(spark: SparkSession, log_path: str, schema: StructType, path: str, key: str | list[str], checkpoint: str) -> DataFrame:
    """A read model from the whole log, in a new folder and a new checkpoint."""
    fold = Fold(spark, path, key)
    fold.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(log_path), checkpoint).awaitTermination()
    return fold.read()
