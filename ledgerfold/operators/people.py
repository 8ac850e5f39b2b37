"""People, groups and memberships, conservatively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import identity_confidence, is_person, name_key, or_empty, organization_id, person_id, trimmed


def spoken(speeches: DataFrame) -> DataFrame:
    """Speeches of people, with person and organization ids. ``speeches``: issue_id,
    seq, speech_order, speaker, speaker_yomi, speaker_group."""
    own = speeches.where(is_person(F.col("speaker")))
    named = F.trim(or_empty(F.col("speaker_group"))) != ""
    return own.select(
        "*",
        person_id(F.col("speaker"), F.col("speaker_yomi")).alias("person_id"),
        name_key(F.col("speaker")).alias("name_key"),
        identity_confidence(F.col("speaker"), F.col("speaker_yomi")).alias("identity_confidence"),
        F.when(named, organization_id(F.col("speaker_group"))).alias("org_id"),
        F.struct("seq", "speech_order").alias("at"),
    )


#: Fixed value: what every group of members is.
PARLIAMENTARY_GROUP = "parliamentary_group"


def people(speeches: DataFrame) -> DataFrame:
    """person_id with name, reading and confidence, and the span of seq it was seen in.
    Within a meeting the first spelling counts, then the latest meeting."""
    once = spoken(speeches).groupBy("person_id", "seq").agg(F.min_by(F.struct(trimmed(F.col("speaker")).alias("name"), trimmed(F.col("speaker_yomi")).alias("yomi"), "identity_confidence"), "at").alias("first"))
    return once.groupBy("person_id").agg(F.max_by("first", "seq").alias("now"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select("person_id", "now.*", "first_seq", "last_seq")


def organizations(speeches: DataFrame) -> DataFrame:
    return spoken(speeches).where("org_id is not null").groupBy("org_id").agg(F.max_by(trimmed(F.col("speaker_group")), "at").alias("name"), F.lit(PARLIAMENTARY_GROUP).alias("classification"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def memberships(speeches: DataFrame) -> DataFrame:
    """Spans in which a person spoke for a group, and the role: the first one named in the
    latest meeting, null if that is empty. Speeches without ``speaker_position`` have none."""
    own = spoken(speeches if "speaker_position" in speeches.columns else speeches.withColumn("speaker_position", F.lit(None).cast("string")))
    role = F.nullif(trimmed(F.col("speaker_position")), F.lit(""))
    once = own.where("org_id is not null").groupBy("person_id", "org_id", "seq").agg(F.min_by(role, "at").alias("role"))
    return once.groupBy("person_id", "org_id").agg(F.max_by("role", "seq").alias("role"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def resolved(votes: DataFrame, speeches: DataFrame, strict: bool = False) -> DataFrame:
    """Adds person_id to votes by the name key within the meeting. The last speaker of
    a name wins; with ``strict``, namesakes give null instead."""
    who = spoken(speeches).groupBy("issue_id", F.col("name_key").alias("voter_name")).agg(F.max_by("person_id", "at").alias("person_id"), F.min("person_id").alias("low"), F.max("person_id").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("person_id")) if strict else F.col("person_id")
    return votes.join(who.select("issue_id", "voter_name", one.alias("person_id")), ["issue_id", "voter_name"], "left")
