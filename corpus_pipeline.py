"""The corpus pipeline: what is kept, cleaned, mixed and encoded for training.

Each stage works on all that the stage before it kept. ``run`` applies them to
``documents``; stages can as well be written and reread one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import bpe, jaccard, mixing, pii, quality
from ledgerfold.llm.common import materialize, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; trusted ones are labelled."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return _measured(pii.redact(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; each source's last one ends at the cut."""
    return _measured(mixing.mixed(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, _tokenizer(), with_ids=True, keep_units=False)


STAGES = [("quality", keep_good), ("near duplicates", keep_one), ("personal data", redact), ("mix", mix), ("encode", encode)]

#: The classifier and the tokenizer are out of SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
