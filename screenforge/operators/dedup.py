"""One application per role and email: the first stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.text import email_key
from screenforge.operators.joins import is_small

# The filter of a large delivery's keys has so many places: at most 4 M numbers of 8 bytes are broadcast.
FILTER_BITS = 22


def slot_key() -> Column:
    """Email key, or a key of its own for a row without email.

    Email keys are stripped, so one that starts with a blank cannot equal any. Giving such rows
    distinct keys also spreads them over all partitions.
    """
    return F.coalesce(email_key(F.col("email")), F.concat(F.lit(" "), F.col("application_id").cast("string")))


def dedup_first(df: DataFrame) -> DataFrame:
    """First application per (role, email) by time, then id.

    The limit on the row number is applied in each input partition before the shuffle, so a key
    with very many rows sends one row per task.
    """
    window = Window.partitionBy("role", "_slot").orderBy("applied_at", "application_id")
    return (
        df.withColumn("_slot", slot_key())
        .withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") == 1)
        .drop("_slot", "_place")
    )


def _known_of(incoming: DataFrame, existing: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    keyed = incoming.withColumn("_slot", slot_key())
    slots = keyed.select("role", "_slot").distinct()
    stored = existing.select("role", email_key(F.col("email")).alias("_slot")).where(F.col("_slot").isNotNull())
    if is_small(slots, max_rows):
        # A small delivery against a long history: filter the history where it lies, shuffle only hits.
        return keyed, stored.join(F.broadcast(slots), ["role", "_slot"], "left_semi").distinct()
    return keyed, _possible(stored, slots).distinct()


def _possible(stored: DataFrame, slots: DataFrame) -> DataFrame:
    """Stored keys that may be among ``slots``: a Bloom filter of one probe, applied where the history lies.

    The places of the delivery's keys are broadcast, 2 ** FILTER_BITS numbers at most, whatever the size of the
    delivery. A key that is in it always passes; of the others as many as the filter is full.
    """
    place = F.shiftrightunsigned(F.xxhash64("role", "_slot"), 64 - FILTER_BITS)
    places = slots.select(place.alias("_place")).distinct()
    return stored.withColumn("_place", place).join(F.broadcast(places), "_place", "left_semi").drop("_place")


def new_applications(incoming: DataFrame, existing: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Incoming rows whose (role, email) is not stored yet. A row without email always passes."""
    keyed, known = _known_of(incoming, existing, max_rows)
    return keyed.join(known, ["role", "_slot"], "left_anti").select(*incoming.columns)


def registered_applications(incoming: DataFrame, existing: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Incoming rows whose (role, email) is stored already."""
    keyed, known = _known_of(incoming, existing, max_rows)
    return keyed.join(known, ["role", "_slot"], "left_semi").select(*incoming.columns)


def append_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both by column name; a column only one side has is null in the other."""
    return stored.unionByName(new, allowMissingColumns=True)
