"""Deterministic encoding of an event's facts, and its hash, as column expressions.

Protocol Buffers' wire form: fields in order, zero and empty ones left out, so the
same facts always have the same bytes. Each event can be checked on its own,
because the hash of the event before it is one of its facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import content_ref, utc_seconds

GENESIS = "0" * 64
# Numbers of the event types, 0 for none.
TYPE_NUMBERS = {"observed": 1, "changed": 2, "vanished": 3, "restored": 4}


def varint(n: Column) -> Column:
    """Seven bits a byte, low ones first, the top bit set on all but the last; hex.

    Numbers of one or two bytes are written out; longer ones, which are rare, go through
    arrays. So little code is made for a field that the code of a whole event is compiled."""
    n = n.cast("long")
    groups = F.floor((F.length(F.bin(n)) + 6) / 7).cast("int")

    def byte(i: Column) -> Column:
        part = F.call_function("shiftrightunsigned", n, i * 7).bitwiseAND(127)
        return F.lpad(F.hex(F.when(i < groups - 1, part + 128).otherwise(part)), 2, "0")

    two = F.hex(F.shiftleft(n.bitwiseAND(127) + 128, 8) + F.shiftright(n, 7))
    long = F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), byte), "")
    return F.when(n.between(0, 127), F.lpad(F.hex(n), 2, "0")).when(n.between(128, 16383), two).otherwise(long)


def text_field(number: int, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{number << 3 | 2:02x}"), varint(F.octet_length(value)), F.hex(value.cast("binary")))).otherwise("")


def number_field(number: int, value: Column) -> Column:
    return F.when(value != 0, F.concat(F.lit(f"{number << 3:02x}"), varint(value))).otherwise("")


def facts_prefix() -> Column:
    """Hex of fields 1 to 10 from the event columns; all that does not depend on the chain."""
    kind = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), TYPE_NUMBERS.items(), F).otherwise(0)
    parts = [
        text_field(1, F.col("event_id")),
        text_field(2, F.col("stream_id")),
        number_field(3, F.col("stream_seq")),
        number_field(4, kind),
        text_field(5, F.col("source")),
        text_field(6, F.col("fetcher_version")),
        text_field(7, utc_seconds(F.col("observed_at"))),
        text_field(8, utc_seconds(F.col("source_published_at"))),
        text_field(9, content_ref(F.col("content_hash"))),
        text_field(10, content_ref(F.col("prev_content_hash"))),
    ]
    return F.lower(F.concat(*parts))


def wire_hex() -> Column:
    return F.lower(F.concat(facts_prefix(), text_field(11, F.col("log_prev_hash"))))


def verdict_prefix() -> Column:
    """Hex of the facts of a review verdict but the hash before it, in the same form."""
    parts = [
        text_field(1, F.col("event_id")),
        text_field(2, F.col("type")),
        number_field(3, F.col("observation_seq")),
        text_field(4, F.col("actor")),
        text_field(5, utc_seconds(F.col("decided_at"))),
        text_field(6, F.col("payload")),
    ]
    return F.lower(F.concat(*parts))


def chained(prefix: Column) -> Column:
    """Hash of facts and of the hash before them."""
    return F.sha2(F.unhex(F.concat(prefix, text_field(11, F.col("log_prev_hash")))), 256)


def log_hash() -> Column:
    return F.sha2(F.unhex(wire_hex()), 256)
