"""Mixing sources to target weights, with DataFrame functions only.

Documents get a hash-random key, are laid out by key within their source in
buckets (ranges of the key), token counts are summed per bucket, then prefix sums
over buckets and inside buckets give each document's place in its source. Whole
epochs repeat every document; the rest of the budget is cut at its exact word.
A bucket holds about the square root of its source's documents, so neither the
prefix over buckets nor the one inside a bucket meets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def target_table(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From ``source, source_size`` (one row a source): the target of each source.

    Weights repeat over the sources by code point, null last. Where a source's
    share of the total is above ``max_epochs`` times its size, it stops there and
    the excess goes to the others by weight. In order of cap over weight, the
    capped sources come first, so one prefix sum finds them all: source k is
    capped if the level that its predecessors leave is above its own ratio. The
    first that is not capped has the level; those after it would have a lower one.
    Sources are a few numbers each and meet in one task: millions of them will do.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = placed.select(
        "source", "source_size", "place", w.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(after).alias("left"),
    ).withColumn("lambda", (F.col("all") - F.col("spent")) / F.col("left"))
    free = F.col("lambda") * F.col("weight") <= F.col("cap")
    first = F.max(F.when(free, F.col("lambda"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return level.select(
        "source",
        "source_size",
        F.when(F.col("all") == 0, 0.0).otherwise(F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken.

    ``taken`` is the number of words the mix takes from the document, repeats
    counted: ``floor(target / source_size)`` whole epochs, then documents in key
    order up to the exact rest; the document at the cut gives its first words.
    Null texts have size 0 and give nothing; null sources are one source; rows
    that repeat an id share a key and are taken in order of size. Reruns agree.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")
        )
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = target_table(sums.select("source", "source_size"), weights, max_epochs)
    plan = materialize(
        targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select(
            "t.source",
            "t.source_size",
            "t.target",
            F.greatest(F.lit(1), F.sqrt("s.n").cast("long")).alias("buckets"),
            F.when(F.col("t.source_size") > 0, F.floor(F.col("t.target") / F.col("t.source_size"))).otherwise(0).cast("long").alias("epochs"),
        ).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    )
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("buckets")).cast("long")
    laid = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.key", "p.source_size", "p.target", "p.epochs", "p.rest", bucket.alias("bucket")
    )
    per = laid.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = placed.alias("d").join(
        starts.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))
    )
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("bucket_start") - F.col("inner")))
    return both.select(
        "d.doc_id", "d.size", "d.source_size", "d.target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs`` with every document repeated as often as it is taken
    in full, plus, at the one cut of each source, a row that ends at the cut.

    The columns stay as they are. Ids are expected to be unique; rows that share
    an id each follow what the first of them (by size) is given.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).where("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    names = docs.columns
    size = word_count(F.col(text_col))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), size.alias("own_size"))
    rows = own.join(taken, (F.col("own_id").eqNullSafe(F.col("doc_id"))) & (F.col("own_size") == F.col("size")))
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = rows.select("row", "size", "taken", F.explode(copies).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    text = F.col(f"row.`{text_col}`")
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    cut = F.concat(head, F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1), F.lit(1), words.cast("int")), ""))
    return each.select(
        *[(F.when(words < F.col("size"), cut).otherwise(text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names]
    )
