"""What the operators share: row keys, batches of text as bytes, joining results back without hot tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.operators.joins import attach, is_small, shuffle_width
from screenforge.session import bound_batches, give_memory_back

__all__ = ["attach", "bound_batches", "chunks", "filled", "freeing", "is_held_out", "mixed", "power_of", "ragged", "shuffle_width", "text_key", "without"]


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker that lives on gives the memory it no longer uses back to its machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_memory_back()

    return wrapped


def filled(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id this tells rows apart: rows that share both have equal results."""
    return F.xxhash64(filled(column))


def is_held_out(column: str = "doc_id") -> Column:
    """True for the rows from which no label may be learned: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def power_of(base: int, least: int) -> int:
    """How often ``base`` is multiplied with itself to reach ``least``; one time at least."""
    return max(1, math.ceil(math.log(max(2, least), base) - 1e-9))


def without(docs: DataFrame, losers: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose id and text are in ``losers`` (doc_id, text_key), all columns as they were.

    Up to ``max_rows`` losers (16 bytes each) are broadcast and the texts stay where they are; more are
    joined by shuffle.
    """
    lost = losers.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct()
    if is_small(lost, max_rows):
        lost = F.broadcast(lost)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), text_key().alias("_key"))
    match = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))
    return packed.join(lost, match, "left_anti").select("_row.*")


def chunks(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string column without nulls: first row, last row + 1, their UTF-8 bytes, their offsets in these.

    A piece has about ``most`` bytes and ``rows`` rows at most, or one row if that is longer.
    """
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        high = min(high, low + rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every (start, length) one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-stirred bits of each 64-bit number (the finisher of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
