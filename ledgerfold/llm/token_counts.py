"""Token counts without ids: each distinct pre-token is counted once and joined to
the pre-token frequencies of the documents.

A pre-token here is a stretch that the tokenizer's own pre-tokens never leave: cut
at each space that a non-space follows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .bpe import encoder


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null texts have 0 bytes and 0 tokens. Special strings in texts count as one
    token each. Rows that share an id are counted each on their own.
    """
    if not encoder(tokenizer).cut:
        raise ValueError("this tokenizer's pre-tokens are not known to end at spaces")

    def keys_of():
        enc = encoder(tokenizer)

        def find(text: str):
            after: Counter[str] = Counter()
            first, special = [], 0
            for units, end in enc.segments(text):
                special += end is not None
                after.update(units[1:])
                if units[0]:
                    first.append(units[0])
            return first + [" " + u for u in after], [1] * len(first) + list(after.values()), special

        return find

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = chunks.chunked(rows, keys_of)

    def value_of():
        enc = encoder(tokenizer)
        return lambda pieces: [len(x) / 4 for x in enc.encode_pieces(pieces)]

    counts = chunks.valued(held, value_of)
    n = F.col("own") + F.col("total").cast("long")
    return chunks.summed(held, counts).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
