"""Continuous intake with the accepted keys in the stream's own state instead of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from screenforge.operators.dedup import slot_key
from screenforge.operators.joins import shuffle_width
from screenforge.plans.intake import clean_applications
from screenforge.schemas import CANDIDATE
from screenforge.session import give_memory_back

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Rows held before they are cut to one per key.
HELD_ROWS = 100_000
_ORDER = [("role", "ascending"), ("_slot", "ascending"), ("applied_at", "ascending"), ("application_id", "ascending")]


def _firsts(rows: pa.Table) -> pa.Table:
    """The first row of every role and slot by time, then id; absent values come first."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=_ORDER, null_placement="at_start")).combine_chunks()
    if rows.num_rows < 2:
        return rows
    new = pa.array([False] * (rows.num_rows - 1))
    for name in ("role", "_slot"):
        key = rows[name].dictionary_encode(null_encoding="encode").combine_chunks()
        key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).indices
        new = pc.or_(new, pc.not_equal(key[1:], key[:-1]))
    return rows.filter(pa.concat_arrays([pa.array([True]), new]))


def _first_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a task's rows, of which it holds the firsts and some more."""
    held, kept = [], 0
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > kept + max(HELD_ROWS, kept):
            held = _firsts(pa.Table.from_batches(held)).to_batches()
            kept = sum(b.num_rows for b in held)
    if held:
        yield from _firsts(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)
    give_memory_back()


def first_applications(applications: DataFrame) -> DataFrame:
    """The candidates of a stream of applications: cleaned, first per role and email over the whole stream.

    Spark's own streaming deduplication keeps the keys, and nothing besides them; there is no watermark, as an old email
    must still block. Rows of a micro-batch compete by time, then id, as in a batch job: each task cuts its rows, so that a
    key with very many rows sends few of them, then the keys are brought together and one row of each goes on to the state.
    A row without email passes by and leaves no state.
    """
    rows = clean_applications(applications).withColumn("_slot", slot_key())
    keyless = F.col("_slot").startswith(" ")
    some = rows.where(~keyless).mapInArrow(_first_of_part, rows.schema)
    firsts = some.repartition(shuffle_width(rows.sparkSession), "role", "_slot").mapInArrow(_first_of_part, rows.schema)
    return firsts.dropDuplicates(["role", "_slot"]).unionByName(rows.where(keyless)).drop("_slot")


def start_state_intake(stream: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write :func:`first_applications` of a stream to ``table``, one folder per batch, as ``read_intake`` reads it.

    The keys lie in a RocksDB store below the checkpoint, spread over the shuffle partitions the stream began with. No
    earlier row is read again; a restart goes on from the checkpoint.
    """
    spark = stream.sparkSession

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.select(*CANDIDATE.fieldNames()).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = first_applications(stream).writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
