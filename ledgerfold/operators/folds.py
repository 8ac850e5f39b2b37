"""How events fold into read models: latest row, latest children, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` for a join whose sides both grow with the log: dealt by key, never sent
    whole through the driver. Spark takes rows for small by the files they were made
    from, with most columns cut; texts and hashes that a query makes are far larger."""
    return rows.hint("merge")


def latest(rows: DataFrame, key: str | list[str], order: str = "seq") -> DataFrame:
    """The last row of each key; one aggregate, no window."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")


def heads(events: DataFrame, parent: str, order: str = "seq") -> DataFrame:
    """``parent, order``: the last event of each parent, whether it has children or not."""
    return events.groupBy(parent).agg(F.max(order).alias(order))


def latest_children(children: DataFrame, parent: str, order: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """All rows of each parent's last event; rows of earlier ones are gone. ``heads`` (see
    above) tells the last events; a parent whose last one has no children then has none.
    Without it, only events that have children are known."""
    known = children.groupBy(parent).agg(F.max(order).alias(order)) if heads is None else heads
    last = known.select(F.col(parent).alias("_p"), F.col(order).alias("_last"))
    return children.join(dealt(last), (F.col(parent) == F.col("_p")) & (F.col(order) == F.col("_last")), "left_semi")


def spans(rows: DataFrame, key: list[str], attributes: list[str], order: str = "seq") -> DataFrame:
    """First and last seq of each key, attributes of the last row."""
    return rows.groupBy(*key).agg(F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), *[F.max_by(a, order).alias(a) for a in attributes])


def merged(stored: DataFrame | None, batch: DataFrame, key: str | list[str], order: str = "seq") -> DataFrame:
    """Upsert: stored rows and a batch, the last of each key. The same batch twice changes nothing."""
    return latest(batch if stored is None else stored.unionByName(batch), key, order)


def replaced_children(stored: DataFrame | None, batch: DataFrame, parent: str, order: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """Stored children and a batch: each parent keeps the rows of its last event.
    ``heads``: the last events of what is stored and of the batch (see ``merged``)."""
    return latest_children(batch if stored is None else stored.unionByName(batch), parent, order, heads)


def overtaken(stored: DataFrame, batch_heads: DataFrame, parent: str, order: str = "seq") -> DataFrame:
    """Stored children that no event of a batch replaces: those of other parents, and of
    later events. An event that comes again replaces its own rows."""
    new = batch_heads.select(F.col(parent).alias("_p"), F.col(order).alias("_new"))
    return stored.join(dealt(new), (F.col(parent) == F.col("_p")) & (F.col(order) <= F.col("_new")), "left_anti")


def replaced_scope(stored: DataFrame, rows: DataFrame, scope: str | Column, values: DataFrame | None = None) -> DataFrame:
    """A table that several producers share: theirs stay, and a producer's rows give way
    to ``rows``. ``scope`` is a condition on stored rows (a stream's prefix), or a column
    whose values are those of ``values``, so a producer without new rows has none left;
    without ``values``, those of ``rows`` are meant."""
    if isinstance(scope, Column):
        rest = stored.where(~F.coalesce(scope, F.lit(False)))
    else:
        rest = stored.join((rows if values is None else values).select(scope).distinct(), scope, "left_anti")
    return rest.select(*stored.columns).unionByName(rows)


def merged_spans(stored: DataFrame, batch: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Spans (see ``spans``) of what is stored and of a batch as one: the first seq that
    was seen stays, the last is the greater, attributes are those of the last."""
    both = stored.unionByName(batch)
    return both.groupBy(*key).agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), *[F.max_by(a, "last_seq").alias(a) for a in attributes])


def by_page(rows: DataFrame, page: str, key: str, order: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """The latest rows of each page (see ``latest_children``), then the last page that has a key."""
    return latest(latest_children(rows, page, order, heads), key, order)


def last_writer(rows: DataFrame, page: str, key: str, heads: DataFrame, order: str = "seq") -> DataFrame:
    """Pages applied one after the other, in ``order``: a page's rows are deleted, then
    its new ones take their keys over from other pages. So a key has the last row that
    any page gave it, and none if that page has come again without it, even where an
    older page still lists it. ``rows``: of all events, not of the latest only."""
    return latest_children(latest(rows, key, order), page, order, heads)


def fingerprint(rows: DataFrame) -> DataFrame:
    """Count and order-free hash of a table, for equality of replays."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def ordered_fingerprint(rows: DataFrame, order: list[str], block: int = 4096) -> str:
    """One digest over all rows in their order, for equality of replays.

    Rows are dealt by ranges and numbered; ``block`` rows that follow each other give a
    digest, as many digests give one again, until one is left: no task holds more.
    """
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    dealt = rows.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], text.alias("text"))
    by = [*[f"_o{i}" for i in range(len(order))], "text"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("text", F.monotonically_increasing_id().alias("at")).persist()
    try:
        at = F.col("at")
        sizes = dealt.groupBy(F.shiftright(at, 33).alias("part")).count()
        before = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        numbered = dealt.join(F.broadcast(before), F.shiftright(at, 33) == F.col("of"))  # a row a range
        level, n = numbered.select((at.bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("n"), "text"), dealt.count()
        while True:
            level = level.groupBy(F.floor(F.col("n") / block).cast("long").alias("n")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n"), 256).alias("text"))
            if n <= block:
                return level.first()["text"] if n else ""
            n = -(-n // block)
    finally:
        dealt.unpersist()
