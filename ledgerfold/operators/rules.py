"""Data-quality rules: what a table must keep, counted in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the log and the read models, as SQL.
RULES = {
    "event": {
        "vanished_has_no_content": "(type = 'vanished') = (content_hash is null)",
        "known_type": "type in ('observed', 'changed', 'vanished', 'restored')",
        "positive_seq": "stream_seq > 0",
    },
    "snapshot": {"payload_or_reference": "payload is not null or external_ref is not null"},
    "change": {"known_class": "classification in ('substantive', 'administrative')", "known_confidence": "class_confidence in ('high', 'medium', 'low')"},
    "seat": {"pr_has_no_district": "is_pr = (district_code is null)"},
    "source": {"positive_rate": "rate_seconds > 0"},
}


def violations(df: DataFrame, rules: dict[str, str], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """``rule, violations``: rows for which a rule is false (unknown passes), and keys that repeat."""
    counts = df.agg(*[F.count_if(~F.expr(sql)).cast("long").alias(name) for name, sql in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    out = counts.select(F.inline(pairs))
    for name, key in (unique or {}).items():
        out = out.union(df.groupBy(*key).count().where("count > 1").agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations")))
    return out
