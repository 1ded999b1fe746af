"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenforge.llm.common import attach, filled, power_of, shuffle_width, text_key, without
from screenforge.session import materialize

FAN = 4


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text_key) of every row; a null text counts as empty. The texts are read once, here."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), text_key().alias("text_key"))


def merge_runs(runs: DataFrame, rounds: int) -> DataFrame:
    """One row per digest from the sorted runs of ``FAN ** rounds`` sources.

    In every round the holders of ``FAN`` neighbouring sources exchange runs: each takes over one
    more base-``FAN`` digit of the digests' slots and gives up one of the source number. It
    sorts and merges what it got (a sort aggregate over a struct) and keeps the wanted identifier
    per digest, so a digest that all sources hold is met ``FAN`` rows at a time. After the last
    round a holder has one slot of the digests, from all sources. Beside the digest a second hash
    of the text must agree before two rows count as one.
    """
    width = FAN**rounds
    runs = runs.withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(width)))
    for r in range(1, rounds + 1):
        runs = runs.withColumn("source", F.floor(F.col("source") / FAN))
        holder = (F.floor(F.col("slot") / FAN ** (rounds - r)) * FAN ** (rounds - r) + F.col("source")).cast("long")
        runs = runs.withColumn("holder", holder).repartition(width, "holder")
        runs = runs.groupBy("holder", "source", "slot", "digest", "text_key").agg(
            F.max("best").alias("best"), F.sum("group_size").alias("group_size")
        ).drop("holder")
    return runs.select("digest", "text_key", F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays.
    Ties (the same doc_id and text more than once): one of these rows is ``kept``, all have the
    same keep_id. A null doc_id is smaller than any other; if a group has no other, its keep_id is
    null and one row is kept. Other columns of ``docs`` are not looked at. An empty table gives
    no rows. ``partitions``: how many runs there are, the shuffle width if not given.
    """
    spark = docs.sparkSession
    rounds = power_of(FAN, partitions or shuffle_width(spark))
    table = materialize(digests(docs), "digests")
    source = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(FAN**rounds))
    runs = table.groupBy(source.alias("source"), "digest", "text_key").agg(
        F.max(F.struct("doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    several = merge_runs(runs, rounds).filter("group_size > 1")
    rows = attach(table, several, ["digest", "text_key"], source)
    again = F.row_number().over(W.partitionBy("digest", "text_key", "doc_id", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(FAN**rounds))).orderBy("doc_id"))
    rows = rows.withColumn("_alone", F.col("group_size").isNull()).withColumn("_again", F.when(F.col("_alone"), 1).otherwise(again))
    keep_id = F.when(F.col("_alone"), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep_id.eqNullSafe(F.col("doc_id")) & (F.col("_again") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all columns.

    Of rows that repeat both doc_id and text one stays, whichever.
    """
    groups = materialize(exact_groups(docs), "exact-groups")
    keys = ["doc_id", "text_key"]
    rest = without(docs, groups.groupBy(*keys).agg(F.max("kept").alias("kept")).filter("NOT kept"))
    repeated = groups.groupBy(*keys).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept > 0 AND n > 1")
    if repeated.isEmpty():
        return rest
    once = docs.join(repeated.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_text")), "left_semi")
    first = once.groupBy("doc_id", text_key().alias("_key")).agg(F.first(F.struct(*[once[f"`{c}`"] for c in docs.columns])).alias("_row"))
    return without(rest, repeated).unionByName(first.select("_row.*"))
